"""The pipeline's stages and run() against a brute-force version of each, on a small fixture."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import regex
from test_llm import WORD
from tokenizers import Tokenizer

import corpus_pipeline
from trekmill.llm import mixing

SEQUENCE = 2048


def fixture() -> list[tuple]:
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(900)]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    texts = [prose(rnd.randint(5, 200)) for _ in range(40)] + [prose(5000)]
    texts += [texts[3]] * 4  # exact copies
    texts += [" ".join([*texts[7].split(" "), "tail"]), " ".join(["head", *texts[7].split(" ")])] if len(texts[7].split(" ")) > 80 else [texts[7] + " tail"]
    shared = prose(90)
    texts += [f"{prose(120)} {shared} {prose(100)}" for _ in range(3)]
    passage, line = prose(52), prose(40)  # just long enough, and too short
    texts += [f"{prose(60)} {passage} {prose(80)}" for _ in range(3)] + [f"{prose(90)} {line} {prose(70)}" for _ in range(3)]
    texts += [None, "", "123 456 !!", "ok"]
    return [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["web", "web", "book", None]), None if t is None else len(t), "extra") for i, t in enumerate(texts)]


def without_passages(texts, least=192, words=51):
    """Texts without the runs of bytes, repeated in strings of least bytes, that hold so many whole words."""
    raw = [t.encode() for t in texts]
    seen = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = b"x" * least
        whole = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        kept, at = b"", 0
        for run in re.finditer(rb"x+", bytes(gone)):
            if sum(x >= run.start() and y <= run.end() for x, y in whole) >= words:
                kept, at = kept + b[at : run.start()], run.end()
        out.append((kept + b[at:]).decode())
    return out


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def representatives(rows):
    """Ids that stay: the least of each component of five-word shingles with similarity 0.8 or more."""
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in sets if find(i) == i}


def source_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return goal | share
        for s in over:
            goal[s] = 3.0 * sizes[s]
            left -= goal[s]
        free -= over
    return goal


def test_stages_match_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key"]
    language, near, cut, mixed, packed = kept

    assert {r["doc_id"]: r["text"] for r in language} == {i: t for i, t, *_ in rows if t and regex.search(r"\p{L}", t)}

    assert {r["doc_id"] for r in near} == representatives(language) and len(near) < len(language)

    near = sorted(near, key=lambda r: r["doc_id"])
    left = without_passages([r["text"] for r in near])
    assert {r["doc_id"]: r["text"] for r in cut} == {r["doc_id"]: t for r, t in zip(near, left, strict=True)}
    changed = [r["doc_id"] for r, t in zip(near, left, strict=True) if r["text"] != t]
    assert len(changed) == 6, changed

    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in cut}
    text = {r["doc_id"]: WORD.findall(r["text"]) for r in cut}
    sizes, taken, used = Counter(), Counter(), Counter()
    for r in cut:
        sizes[r["source"]] += size[r["doc_id"]]
    for r in mixed:
        words = WORD.findall(r["text"])
        assert words == text[r["doc_id"]][: len(words)]
        taken[r["source"]] += len(words)
        used[r["doc_id"]] += len(words)
    assert all(abs(taken[s] - x) <= 3 * mixing.LEAST_BLOCK for s, x in source_targets(sizes).items())
    assert all(n <= 3 * size[i] for i, n in used.items())

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for r in mixed:
        ids = np.array([*encode.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), SEQUENCE):
            part = ids[k : k + SEQUENCE]
            pieces[r["doc_id"], k // SEQUENCE, k, len(part), zlib.crc32(part.tobytes())] += 1

    def digest(found):
        return Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)

    assert digest(packed) == pieces
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= SEQUENCE

    assert digest(corpus_pipeline.run(spark, str(tmp_path)).collect()) == pieces


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_letters_pass_where_no_row_has_a_language(spark):
    docs = spark.createDataFrame([(1, "a cat sat here", None), (2, "12 !!", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]
