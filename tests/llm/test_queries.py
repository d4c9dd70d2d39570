"""The opN_ queries against brute force, on small tables with nulls, ties, empty and long texts."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from trekmill.llm import html_text, images, neardup, neighbours, queries, toxicity


def texts(seed: int = 1, n: int = 120) -> list[str | None]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    out = [" ".join(rnd.choice(words) + rnd.choice(["", "", ",", ".\n", "!"]) for _ in range(rnd.randint(0, 300))) for _ in range(n)]
    return [*out, None, "", " ", out[0], out[0], " ".join(rnd.choice(words) for _ in range(30_000)), "x" * 9000]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(2)
    rows = [(3 * i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "b", None]), "clash", 7) for i, t in enumerate(texts())]
    rows += [rows[4], (None, "no key", "en", "a", "clash", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string, piece long").repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


def ids(name: str, text: str | None) -> bytes:
    encoder = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_op8_holds_every_piece_once(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = sorted(((k is None, k or 0), i // 8192, i // 4, len(raw[i : i + 8192]) // 4, zlib.crc32(raw[i : i + 8192])) for k, raw in ((k, ids("word_bpe_49k.json", t)) for k, t in docs) for i in range(0, len(raw), 8192))
    rows = queries.op8_packing(spark, folder).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert len(used) <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_op9_reads_back_every_id(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    made = {(k, t): ids("byte_bpe_50k.json", t) for k, t in set(docs)}
    rows = sorted(queries.op9_token_file(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((k for k, _ in docs), key=lambda k: (k is not None, k or 0))
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(((k is None, k or 0), len(made[k, t]) // 4, zlib.crc32(made[k, t])) for k, t in docs)


def test_op8_op9_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op8_packing(spark, str(tmp_path)).count() == queries.op9_token_file(spark, str(tmp_path)).count() == 0


DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(key, n: int) -> int | None:
    return None if key is None else zlib.crc32(str(key).encode()) % n


def test_op1_on_held_out_rows(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op1_language_id(spark, DATA).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert len(held) > 40 and sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)
    for r in got:
        if not regex.search(r"\p{L}", docs[r["doc_id"]]["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_op2_takes_near_its_targets(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = queries.op2_mixing(spark, folder).collect()
    assert len(rows) == len(docs) and sorted(r["size"] for r in rows) == sorted(len(WORD.findall(d["text"] or "")) for d in docs)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own) and all(r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(40, 0.002 * own[0]["target"])
    assert {(r["doc_id"], r["taken"], r["first_slot"]) for r in rows} == {(r["doc_id"], r["taken"], r["first_slot"]) for r in queries.op2_mixing(spark, folder).collect()}


def test_op4_finds_what_all_pairs_find(spark, tmp_path):
    rnd = np.random.default_rng(4)
    base = rnd.standard_normal((40, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (v + 0.004 * rnd.standard_normal(64)).tolist()) for i, v in enumerate(base[:20])]
    rows += [(200, base[0].tolist()), (200, base[0].tolist()), (None, base[1].tolist()), (300, None), (301, []), (302, [float("nan")] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op4_images(spark, str(tmp_path)).collect()
    pictures = {r["image_id"]: r for r in images.rendered(spark.read.parquet(f"{tmp_path}/embeddings.parquet").where("vec_id is not null")).collect()}
    made = {k: images.describe(np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(48, 48)) for k, r in pictures.items() if r["pixels"] is not None}
    root = {k: k for k in pictures}
    keys = sorted(made)
    for _ in keys:
        for i in keys:
            for j in keys:
                if i < j and root[i] != root[j] and max(images.consensus(*made[i], *made[j]), images.consensus(*made[j], *made[i])) >= images.INLIERS:
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[root[k]] == root[k] for k in keys):
            break
    assert len(got) == len(rows)
    mine = {r["image_id"]: r["component_id"] for r in got if r["image_id"] is not None}
    assert sum(mine[k] == root[k] for k in pictures) >= 0.95 * len(pictures) and all(mine[100 + i] == i for i in range(20) if root[100 + i] == i)
    assert mine[200] == 0 and [mine[k] for k in (300, 301, 302)] == [300, 301, 302]


def test_op4_and_op10_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op4_images(spark, str(tmp_path)).count() == queries.op10_neighbours(spark, str(tmp_path)).count() == 0


def test_op5_keeps_articles(spark, tmp_path):
    long_one = "".join(f"<p>Sentence number {i} of a long story about many things that happened.</p>" for i in range(4000))
    pages = [
        (1, "u", "<html><body><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><article><h1>Title &amp; more</h1><p>One  two\n three.</p><p>Four five six seven eight nine ten.</p></article><footer>All rights reserved</footer></body></html>"),
        (2, "u", None),
        (3, "u", ""),
        (4, "u", f"<html><body><div class=menu><a href=/>a</a></div><main>{long_one}</main></body></html>"),
        (5, "u", "<html><body><article><p>Before the button <button>press</p><p>After the button that never closed there is text.</p></article></body></html>"),
        (1, "u", "<html><body><article><p>A row of the same id with enough words to be kept as it is.</p></article>"),
    ]
    spark.createDataFrame([(*p, "clash", 3) for p in pages], "page_id long, url string, html string, text string, n_chars long").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op5_html_text(spark, str(tmp_path)).collect()
    text = {r["page_id"]: r["text"] for r in got if not (r["text"] or "").startswith("A row")}
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text[1] == "Title & more\nOne two three.\nFour five six seven eight nine ten." and text[2] == text[3] == ""
    assert text[4].count("\n") == 3999 and "menu" not in text[4]
    assert "After the button that never closed there is text." in text[5] and "press" not in text[5]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(none).count() == 0


def test_op6_on_held_out_rows(spark):
    larger = DATA.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    got = queries.op6_toxicity(spark, larger).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic, clean = ([s for s, t in held if t == k] for k in (1, 0))
    assert toxic and clean and np.mean([a > b for a in toxic for b in clean]) >= 0.95


def test_op6_with_one_class_and_no_rows(spark):
    docs = spark.createDataFrame([(i, f"some words here {i}", "x") for i in range(30)], "doc_id long, text string, score string")
    one = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(one, docs)).where("predicted = 1").count() == 0
    assert toxicity.score(docs.where("false"), toxicity.fit(one, docs)).count() == 0


def test_op7_against_all_pairs(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]

    def shingles(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    least = {}
    for i, (k, _) in enumerate(docs):
        least[top(i)] = min((x for x in (least.get(top(i)), k) if x is not None), default=None)
    want = sorted((str(k), len(s), str(least[top(i)])) for i, ((k, _), s) in enumerate(zip(docs, sets, strict=True)))
    rows = queries.op7_minhash(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_op7_of_text_keys_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), ("c", None)], "doc_id string, text string")
    assert {r["key"]: r["component_id"] for r in neardup.near_duplicates(df, k=3).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_op10_recall_and_ties(spark, tmp_path):
    rnd = np.random.default_rng(10)
    x = rnd.standard_normal((3000, 16))
    x[1000:1030] = x[1000]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("inf")] * 16), (9060, [5.0, 1.0]), (40, (x[41] * 2).tolist()), (40, x[40].tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op10_neighbours(spark, str(tmp_path)).toPandas()
    every = np.vstack([x, np.r_[5.0, 1.0, np.zeros(14)][None], (x[41] * 2)[None]])
    ids = np.r_[np.arange(3000), 9060, 40]
    hit = total = 0
    for q in [*range(0, 3000, 20), 9060]:
        if q == 40:
            continue
        own = int(np.flatnonzero(ids == q)[0])
        s = every @ every[own]
        want = [k for k in np.lexsort((ids, -s)) if k != own][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and mine["rank"].tolist() == list(range(1, 21))
        hit += len({(int(ids[k]), round(float(s[k]), 9)) for k in want} & {(int(a), round(b, 9)) for a, b in zip(mine.vec_id, mine.score, strict=True)})
        total += 20
    assert hit >= 0.95 * total and not set(got.query_id) & {9000, 9020, 9040}
    assert got.scored.max() < 0.9 * len(every)
    few = spark.createDataFrame(rows[:8], "vec_id long, embedding array<double>")
    assert neighbours.search(few, every=1).count() == 8 * 7


def test_op10_needs_its_descent(spark, monkeypatch):
    """The blocks a graph starts from hold few true neighbours; the rounds of descent bring the rest."""
    x = np.random.default_rng(12).standard_normal((4000, 16)).astype(np.float32)
    nodes = spark.createDataFrame([(0, i, bytearray(v.tobytes())) for i, v in enumerate(x)], "shard int, node long, vec binary")
    sim = x @ x.T
    np.fill_diagonal(sim, -np.inf)
    best = np.argsort(-sim, axis=1)[:, :10]

    def recall() -> float:
        near = neighbours.graph(nodes, 16).toPandas().groupby("v")["u"].agg(set)
        return np.mean([len(near.get(i, set()) & set(best[i].tolist())) / 10 for i in range(len(x))])

    assert recall() >= 0.9
    monkeypatch.setattr(neighbours, "ROUNDS", 0)
    assert recall() < 0.5
