"""Maximal repeat groups against brute force, also where fingerprints collide, and op3 through its query."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from trekmill.llm import kernels, queries, repeats


def strings(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ab") for _ in range(60)) for _ in range(4)]
    made = [rnd.choice(base)[rnd.randint(0, 20) :] + "".join(rnd.choice("ab") for _ in range(10)) + rnd.choice(base) for _ in range(25)]
    return [np.frombuffer(x.encode(), np.uint8) for x in [*made, "a" * 70, made[0]]]


def all_maximal(raw, least):
    """(length, places) of every string of least bytes and more that occurs twice and can be extended on neither side alike."""
    seen = defaultdict(list)
    for o, x in enumerate(raw):
        for i in range(len(x) - least + 1):
            for n in range(least, len(x) - i + 1):
                seen[x[i : i + n]].append((o, i))
    out = set()
    for s, at in seen.items():
        left = {raw[o][i - 1] if i else ("begin", o) for o, i in at}
        right = {raw[o][i + len(s)] if i + len(s) < len(raw[o]) else ("end", o) for o, i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out.add((len(s), frozenset(at)))
    return out


@pytest.mark.parametrize("collide", [False, True])
def test_maximal_repeats(monkeypatch, collide):
    given, whole = strings(5), kernels.range_hash
    if collide:
        monkeypatch.setattr(kernels, "range_hash", lambda h, x, y: whole(h, x, y) % np.uint64(7))
    sa, tree = repeats.maximal_repeats(given, np.arange(len(given)) << 20, 25)
    got = {(n, frozenset((int(o), int(x)) for o, x in zip(sa.owner[i : j + 1], sa.start[i : j + 1], strict=True))) for n, i, j in tree.tolist()}
    assert got == all_maximal([bytes(x) for x in given], 25)


def test_occurrences_at_one_place_are_one():
    given = [np.frombuffer(b"x" + b"abcdefgh" * 4, np.uint8), np.frombuffer(b"abcdefgh" * 4 + b"y", np.uint8)]
    _, tree = repeats.maximal_repeats(given, np.array([0, 1]), 30)
    assert not len(tree)  # the same stretch of one text, seen in two contexts


def test_groups_list_all_occurrences(spark):
    rnd = random.Random(6)
    line = "".join(rnd.choice("abcdefgh") for _ in range(50))
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(30)) + line + "".join(rnd.choice("ijklm") for _ in range(20)) for _ in range(6)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = repeats.repeats(df, least=40, groups=True).where("hi - lo >= 50").collect()
    groups = defaultdict(set)
    for r in rows:
        groups[r["repeat"], r["hi"] - r["lo"]].add((r["d"], r["lo"]))
    assert any(len(g) == 6 for g in groups.values())


@pytest.mark.parametrize("clash", ["left", "nb", "d", "n_removed", "kept_sha256", "spans", "text2"])
def test_clashing_columns_and_nulls(spark, clash):
    p = "".join(random.Random(7).choice("abcdefgh") for _ in range(60))
    rows = [(1, "begin " + p + " one", 5), (2, "other " + p + " two", 6), (None, None, 7), (4, "", None), (2, "other " + p + " two", 6)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {clash} long")
    got = repeats.remove(df, least=40, keep_text=True)
    assert got.columns == df.columns
    assert {(r["doc_id"], r[clash]) for r in got.collect()} == {(r[0], r[2]) for r in rows}
    assert repeats.remove(df, least=40).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_op3_against_every_window(spark, tmp_path):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long_one, passage = prose(150), prose(90)
    texts = [prose(rnd.randint(0, 200)) for _ in range(20)] + [None, "", long_one, long_one, prose(20) + " " + passage + " é " + prose(30), passage + prose(4), prose(60_000) + passage]
    spark.createDataFrame([(2 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in raw:
        for i in range(len(b) - 399):
            seen[b[i : i + 400]] += 1
    want = []
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 399):
            if seen[b[j : j + 400]] > 1:
                gone[j : j + 400] = True
        want.append((2 * i, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert sorted(map(tuple, queries.op3_suffix_array(spark, str(tmp_path)).collect())) == want and sum(w[2] > 0 for w in want) >= 5
