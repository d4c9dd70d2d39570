"""Large groups of near copies: what is written follows the members, and no link between components is lost."""

import random

import numpy as np
import pyarrow as pa
from test_llm import WORD

from trekmill.llm import common, neardup, tokens


def near_copies(n: int) -> list[str]:
    """Versions of one text, some of them far from it, so that buckets hold several components."""
    rnd = random.Random(n)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4]) if i % 3 else rnd.randint(6, 9)):
            t[rnd.randrange(len(t))] = f"v{rnd.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def components_by_all_pairs(texts: list[str], k: int, per_cent: int) -> list[int]:
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in map(WORD.findall, texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= per_cent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def test_members_of_large_groups_are_not_repeated(spark, monkeypatch):
    made = {}

    def counted(df, tag, *bounds):
        table = common.written(df, tag, *bounds)
        made[tag] = made.get(tag, 0) + table.count()
        return table

    monkeypatch.setattr(neardup, "written", counted)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = near_copies(150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["key"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    want = components_by_all_pairs(texts, 5, 80)
    assert [got[i] for i in range(len(texts))] == want and 1 < len(set(want)) < len(texts)
    assert 0 < made["held"] <= made["buckets"], made


def test_every_two_of_different_components_meet_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = [(key, 0, node, 0 if node < 11 else 20 if node < 17 else node) for key in (1, 2) for node in range(30 if key == 1 else 13)]
    members = spark.createDataFrame(rows, "key long, band int, node long, root long")
    seen = []
    for r in neardup.meetings(members, neardup.F.lit(1), [], len(rows)).collect():
        x, y = r["x"], r["y"]
        pairs = [(a, b) for i, a in enumerate(x) for b in x[i + 1 :]] if y is None else [(a, b) for a in x for b in y]
        seen += [(r["key"], *sorted((a["node"], b["node"]))) for a, b in pairs if a["root"] != b["root"]]
        assert y is None or {a["root"] for a in x} != {0} or {b["root"] for b in y} != {0}
    want = [(k, m, n) for k, _, m, p in rows for l, _, n, q in rows if k == l and m < n and p != q]
    assert sorted(seen) == sorted(want)


def test_workers_let_go_of_encoders_before_other_work():
    tokens._LOADED["some"] = object()
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3))], names=["a"])
    assert list(common.lean(lambda b: b, encodes=True)(iter([batch]))) == [batch] and tokens._LOADED
    assert list(common.lean(lambda b: b)(iter([batch]))) == [batch] and not tokens._LOADED
