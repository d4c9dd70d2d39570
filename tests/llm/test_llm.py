"""Training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from trekmill.llm import graph, html_text, images, kernels, langid, mixing, neardup, neighbours, packing, repeats, token_file, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words():
    rnd = random.Random(1)
    texts = ["The cat  sat", "", None, "x" * 50 + " y", "a b\nc", " éa É "] + ["".join(rnd.choice("aB \n") for _ in range(rnd.randint(0, 3000))) for _ in range(50)]
    h, d, _ = kernels.words(*kernels.string_bytes(pa.array(texts)), kernels.SPACED)
    want = [(i, w) for i, t in enumerate(texts) for w in WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))]
    assert d.tolist() == [i for i, _ in want]
    seen = {}
    assert all(seen.setdefault(w, x) == x for x, (_, w) in zip(h, want, strict=True)) and len(set(seen.values())) == len(seen)


def test_language_mixture(spark):
    rows = [(i, "the cat and the dog ran over there with them " * 3, "en") for i in range(20)] + [(100 + i, "der hund und die katze sind nicht im haus gewesen " * 3, "de") for i in range(20)]
    docs = spark.createDataFrame([*rows, (200, None, "en"), (201, "", None), (202, "12 34 !!", "de"), (203, "the dog and the cat ran there der hund und die katze sind nicht", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert len(got) == docs.count() and got[0]["lang_pred"] == "en" and got[100]["lang_pred"] == "de"
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert 0.2 < got[203]["proportions"][0] < 0.8  # both languages are in it
    clash = docs.withColumn("score", docs["doc_id"])
    assert langid.identify(clash, langid.fit(docs)).schema["score"].dataType.typeName() == "double"
    none = docs.where("false")
    assert langid.identify(none, langid.fit(none)).count() == 0


def test_mixing(spark):
    rnd = random.Random(2)
    docs = [(i, None if i % 17 == 0 else " ".join(["w"] * rnd.randint(0, 90)), rnd.choice(["a", "a", "a", "b", None, "c"])) for i in range(400)]
    docs += [docs[5]] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    plan = mixing.mix(df)
    got = mixing.taken(plan).collect()
    assert len(got) == len(docs) and sum(r["size"] for r in got) == sum(len(WORD.findall(t or "")) for _, t, _ in docs)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3 * plan.block and all(r["taken"] <= 3 * r["size"] for r in own)
    assert plan.block == mixing.LEAST_BLOCK and sorted(map(tuple, mixing.taken(mixing.mix(df)).collect()), key=str) == sorted(map(tuple, got), key=str)
    # What is taken comes by the slots: it is what the sources' ranks in the schedule cover.
    slots = {r["pos"]: r["n"] for r in plan.slots.groupBy("pos").agg({"slot": "count"}).toDF("pos", "n").collect()}
    for r in plan.sources.collect():
        assert sum(g["taken"] for g in got if g["source"] == r["source"]) == min(slots.get(r["pos"], 0) * plan.block, 3 * r["source_size"])
    text = mixing.mixed(plan, df, slot="at").collect()
    assert {r["at"] for r in text} <= {r["slot"] for r in plan.slots.collect()}
    assert sum(len(WORD.findall(r["text"])) for r in text) == sum(r["taken"] for r in got)
    assert mixing.taken(mixing.mix(df.where("false"))).count() == 0
    assert mixing.targets([("a", 10), ("b", 100), (None, 0)])[0][3] == 30.0


def test_every_stretch_of_the_schedule_keeps_the_shares(spark):
    shares = [0.55, 0.25, 0.15, 0.05]
    rows = mixing.schedule(spark, shares, 5000).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(5000))
    pos = np.array([r["pos"] for r in rows])
    for i, share in enumerate(shares):
        hits = np.cumsum(pos == i)
        assert np.abs(hits - share * np.arange(1, 5001)).max() <= 4
        assert [r["rank"] for r in rows if r["pos"] == i] == list(range(hits[-1]))


def test_rows_that_differ_in_other_columns_stay_apart(spark):
    df = spark.createDataFrame([(1, "a b c", "x", "left"), (1, "a b c", "x", "right"), (1, "a b c", "x", "right")], "doc_id long, text string, source string, turn string")
    plan = mixing.mix(df, block=1)
    assert sorted(r["turn"] for r in mixing.mixed(plan, df).collect()) == ["left", "right", "right"]


def windows(texts, least):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - least + 1):
            seen[b[i : i + least]] = seen.get(b[i : i + least], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = True
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [4 << 20, 100])
def test_repeats(spark, limit):
    rnd = random.Random(3)
    make = lambda n, of="abcdefgh é": "".join(rnd.choice(of) for _ in range(n))
    p = [make(90) for _ in range(6)]
    texts = [None, "", "x" * 30, "a" * 300, "ab" * 150] + [make(rnd.randint(0, 60)) + rnd.choice(p)[rnd.randint(0, 30) :] + make(rnd.randint(0, 60)) + rnd.choice(p) + make(20) for _ in range(40)] + [p[0] * 4, p[0] * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in repeats.remove(df, least=40, anchor_bytes=limit).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert [g[1:] for g in got] == windows(texts, 40)
    assert repeats.remove(df.where("false")).count() == 0


def test_interval_tree():
    assert sorted(repeats.interval_tree(np.array([0, 3, 5, 5, 2, 4]), 3)) == [(3, 0, 3), (4, 4, 5), (5, 1, 3)]


def test_html():
    model = html_text.fit(html_text.training_pages())
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class=ad>Buy now</div><article><h1>A &amp; B</h1><p><b>One<br><p>Two\n  words&nbsp;here and some more of them to read</p><script>var x='</p>'</script></article><div class='comments'><p>I agree with you</p></div><footer>&copy; me</footer></body></html>"
    assert model.extract([page, "", "<p"]) [:2] == ["A & B\nOne\nTwo words here and some more of them to read", ""]


def test_toxicity(spark):
    rnd = random.Random(4)
    plain = "the of and to in is was for on that with as at by from".split()
    docs, labels = [], []
    for i in range(600):
        w = [rnd.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            w[rnd.randrange(40)] = rnd.choice(["zkrupt", "zkrupting", "zkrupty"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    docs += [(1000, None), (1001, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(df, toxicity.fit(lab.where("doc_id % 3 > 0"), df)).collect()}
    held = [i for i in range(0, 600, 3)]
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["predicted"] == 0


def test_near_duplicates(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [None, "", "one", "one", "ONE two", "  "]
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(1, 9)):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            texts.append(" ".join(t))
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 85 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["key"]: r for r in neardup.near_duplicates(df, k=3, per_cent=85).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def test_sketch_fills_and_estimates():
    rnd = np.random.default_rng(6)
    a = np.unique(rnd.integers(0, 2**63, 900).astype(np.uint64))
    b = np.concatenate([a[:800], rnd.integers(0, 2**63, 50).astype(np.uint64)])
    s = neardup.sketches(np.concatenate([a, b, a[:1]]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1]))
    assert abs((s[0] == s[1]).mean() - 800 / (len(a) + 50)) < 0.15 and len(set(s[2].tolist())) > 50


def test_components(spark):
    edges = spark.createDataFrame([(9, 5), (5, 7), (7, 1), (20, 21), (3, 3), (None, 1)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(edges).collect()} == {1: 1, 5: 1, 7: 1, 9: 1, 20: 20, 21: 20}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_by_pieces(name, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "STRETCH", 40)
    rnd = random.Random(7)
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    mine = tokens.PieceEncoder(public_tokenizers.path(name))
    texts = ["", " ", "a  b", "it's <|endoftext|> x", "x" * 200] + ["".join(rnd.choice("ab é\n\t  '.1\xa0") for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_of_many_texts_while_pieces_are_forgotten(name, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "KEPT", 300)
    monkeypatch.setattr(tokens, "TOGETHER", 2000)
    rnd = random.Random(17)
    parts = ["cat", "Dog.", "x,y", "don't", "it's", "\u00c9t\u00e9", "\u0130z", "a\nb", "\n", "", " ", "\x1c", "\x85q", "\u0915\u093c", "\u0958", "\u65e5\u672c", "12", "&&&", "e\u0301", "\U0001f642", "_", "\u00a0"]
    texts = [" ".join(rnd.choice(parts) + rnd.choice(["", "", "ab", ",", str(rnd.randint(0, 999))]) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + [None]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    got = list(tokens.PieceEncoder(public_tokenizers.path(name)).encode_all(texts))
    assert len(got) == len(texts) and got[-1] == b""
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_best_fit():
    fit = packing.BestFit(10, 2)
    assert [fit.add(n) for n in (6, 7, 3, 4, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    assert packing.BestFit(10, 1).add(10) == (0, 0)


def test_bounded_stream():
    """A few open bins bind, whole pieces stay, and little is lost against the least possible."""
    lengths = np.random.default_rng(18).integers(1, 2048, 12_000)
    got, fit = packing.stream(lengths)
    assert fit.closed > 100 and fit.open <= packing.OPEN_BINS
    fill = np.bincount(got[:, 0], lengths)
    assert fill.max() <= 2048 and len(fill) == fit.made <= 1.02 * lengths.sum() / 2048
    order = np.lexsort((got[:, 1], got[:, 0]))
    ends = np.cumsum(lengths[order])
    first = np.r_[True, np.diff(got[order, 0]) > 0]
    assert (got[order, 1] == ends - lengths[order] - np.maximum.accumulate(np.where(first, ends - lengths[order], 0))).all()
    plain, online = packing.stream(lengths, bins=8, ahead=1)
    assert online.closed > 0 and online.made > fit.made and len(plain) == len(lengths)


def test_packing(spark):
    rnd = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(["cat"] * rnd.randint(0, 60)) if i % 9 else None) for i in range(200)], "doc_id long, text string")
    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=32).toPandas()
    used = got.sort_values(["sequence_id", "offset"])
    assert (used.offset == used.groupby("sequence_id").length.cumsum() - used.length).all()
    assert got.groupby("sequence_id").length.sum().max() <= 32
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 32) * 1.03 + 1


def test_elias_fano():
    rnd = np.random.default_rng(9)
    for n, u in ((1, 5), (1000, 100_000), (700, 700), (300, 10**7)):
        v = np.sort(rnd.integers(0, u, n))
        ef = token_file.EliasFano.build(v, u)
        assert [ef.select(i) for i in range(n)] == v.tolist() == ef.part(0, n).tolist()
        for i, j in ((0, 1), (n // 3, n // 2), (n - 1, n), (n // 2, n // 2), (min(n - 1, 256), n)):
            assert ef.part(i, j).tolist() == v[i:j].tolist()


def test_token_file(spark):
    docs = spark.createDataFrame([(3, "b c"), (1, None), (2, ""), (None, "x"), (3, "a")], "doc_id long, text string")
    got = sorted(token_file.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).collect(), key=lambda r: r["start"])
    assert [r["key"] for r in got][:3] == [None, 1, 2] and [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert got[1]["ids_crc32"] == zlib.crc32(b"\0\0\0\0")


def test_neighbours(spark):
    rnd = np.random.default_rng(10)
    x = rnd.standard_normal((400, 8))
    x[50:80] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [1.0, 2.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    hit = total = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and q not in set(mine.vec_id)
        hit += len(set(want) & set(mine.vec_id))
        total += 20
    # Null, zero and non-finite vectors take no part; a shorter one counts as ending in zeros.
    assert hit >= 0.95 * total and not set(got.query_id) & {900, 920, 940} and 960 in set(got.query_id)


def test_neighbours_of_tight_groups_in_shards(spark):
    rnd = np.random.default_rng(14)
    x = (rnd.standard_normal((50, 16))[:, None] + 0.02 * rnd.standard_normal((50, 100, 16))).reshape(-1, 16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, every=50, shard=2500).toPandas()  # 2 shards
    hit = 0
    for q in range(0, len(x), 50):
        s = x @ x[q]
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:20]
        hit += len(set(want) & set(got[got.query_id == q].vec_id))
    assert hit >= 0.95 * 20 * len(range(0, len(x), 50)), hit


def test_image_copies(spark):
    rnd = np.random.default_rng(11)

    def picture():
        x = rnd.integers(0, 256, (20, 20)).repeat(6, 0).repeat(6, 1).astype(float)
        return images._box(x)

    base = [picture() for _ in range(4)]
    rows = [(i, b) for i, b in enumerate(base)] + [(10, base[0][12:110, 9:105]), (11, np.clip(base[1] * 0.9 + 8, 0, 255)), (12, base[2]), (13, picture())]
    data = [(i, bytearray(b.astype(np.uint8).tobytes()), b.shape[1], b.shape[0]) for i, b in rows] + [(20, None, 4, 4), (21, bytearray(b"abc"), 9, 9), (22, bytearray(900), 30, 30)]
    df = spark.createDataFrame(data, "image_id long, pixels binary, width int, height int")
    got = {r["key"]: r["component_id"] for r in images.copies(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 10: 0, 11: 1, 12: 2, 13: 13, 20: 20, 21: 21, 22: 22}


def test_image_links_are_those_of_all_pairs(spark):
    rnd = np.random.default_rng(12)
    logo = images._box(rnd.integers(0, 256, (8, 8)).repeat(6, 0).repeat(6, 1).astype(float))
    pictures = []
    for _ in range(6):
        base = images._box(rnd.integers(0, 256, (16, 16)).repeat(6, 0).repeat(6, 1).astype(float))
        base[:48, :48] = logo  # in all of them: one bucket for all its strings
        pictures += [np.clip(base + rnd.normal(0, s, base.shape), 0, 255).astype(np.uint8) for s in (0, 2, 5, 10, 15, 20, 30, 40) for _ in range(2)]
    made = [images.describe(x) for x in pictures]
    want = [[images.consensus(*made[i], *made[j]) >= images.INLIERS for j in range(len(made))] for i in range(len(made))]
    node = {r["i"]: r["n"] for r in spark.createDataFrame([(i, bytearray(x.tobytes()), *x.shape[::-1]) for i, x in enumerate(pictures)], "i long, p binary, w int, h int").selectExpr("i", "xxhash64(p, w, h) n").collect()}
    linked = [{node[j] for j in range(len(made)) if node[j] != node[i] and (want[i][j] if node[i] > node[j] else want[j][i])} for i in range(len(made))]
    least = {n: min(i for i in node if node[i] == n) for n in node.values()}
    root = [least[node[i]] for i in range(len(made))]
    while (new := [min([root[i], *(root[least[n]] for n in linked[i])]) for i in range(len(made))]) != root:
        root = new
    df = spark.createDataFrame([(i, bytearray(x.tobytes()), *x.shape[::-1]) for i, x in enumerate(pictures)], "image_id long, pixels binary, width int, height int")
    got = {r["key"]: r for r in images.copies(df).collect()}
    assert [got[i]["component_id"] for i in range(len(made))] == root


@pytest.mark.parametrize(("noise", "least"), [(5, 20), (35, 20), (60, 15)])
def test_image_recall_on_rising_edits(spark, noise, least):
    """Each of 20 pictures has one noisy copy; all that consensus() accepts are found."""
    rnd = np.random.default_rng(13)
    base = [images._box(rnd.integers(0, 256, (14, 14)).repeat(6, 0).repeat(6, 1).astype(float)) for _ in range(20)]
    edited = [np.clip(b + rnd.normal(0, noise, b.shape), 0, 255).astype(np.uint8) for b in base]
    base = [b.astype(np.uint8) for b in base]
    both = [max(images.consensus(*images.describe(a), *images.describe(b)), images.consensus(*images.describe(b), *images.describe(a))) >= images.INLIERS for a, b in zip(base, edited, strict=True)]
    df = spark.createDataFrame([(i + k, bytearray(x.tobytes()), *x.shape[::-1]) for k, xs in ((0, base), (100, edited)) for i, x in enumerate(xs)], "image_id long, pixels binary, width int, height int")
    got = {r["key"]: r["component_id"] for r in images.copies(df).collect()}
    found = [got[i] == got[i + 100] for i in range(20)]
    assert sum(both) >= least and all(f for f, b in zip(found, both, strict=True) if b)
