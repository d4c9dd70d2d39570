"""Toxicity by class-conditional Kneser-Ney models.

Either class has a Kneser-Ney model of the letters of a word, each given the four
before it. Counts of five letters are discounted and back off to the class's
continuation counts of four and three, and those to continuation counts that both
classes share, so an expression seen once or never is judged by its parts. A word's
evidence is the difference of its log-likelihoods in the two models; a text's is
length-normalised: the mean over its words, and over its few most telling words.
A logistic curve, fitted on labelled texts that the counts have not seen, turns it
into a probability.

Counts live in hashed tables of fixed size, so the model does not outgrow memory.

Defined cases: a null or wordless text has no evidence and gets the curve's value
there; an untrained model gives every text the prior; repeated rows get equal
scores; input columns named like an output column are replaced.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import arrow_batches, lean

#: Labelled rows a class: the bound of the sample that fits the model.
SAMPLE_PER_CLASS = 12000
ORDER, SHARED = 5, 2
SLOTS = 1 << 20
DISCOUNT = 0.75
THRESHOLD = 0.3
TOP = 3


def distinct_words(raw: np.ndarray, offsets: np.ndarray):
    """Text index and number of each word, and the distinct words as rows of padded codes, with the end of each."""
    hashes, doc, length = K.words(raw, offsets, K.LETTERS)
    if not len(hashes):
        return doc, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    ends = []
    for a, b in K.slices(raw, offsets, K.LETTERS):
        inside = K.LETTERS[raw[a:b]] != 0
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        lo, hi = np.searchsorted(offsets, [a, b])
        cuts = offsets[lo:hi] - a
        cuts = cuts[(cuts > 0) & (cuts <= b - a)]
        last[cuts - 1] = inside[cuts - 1]
        ends.append(np.flatnonzero(last) + 1 + a)
    end, size = np.concatenate(ends)[first], length[first]
    width = size + ORDER  # ORDER - 1 marks before, one after
    start = np.cumsum(width) - width
    codes = np.zeros(int(width.sum()), np.int64)
    letters = np.repeat(end - size, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    to = np.repeat(start + ORDER - 1, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    codes[to] = K.LETTERS[raw[letters]]
    codes[start + width - 1] = 1
    return doc, number, codes, size


def grams(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER codes up to each letter and end mark as one number, and where each word's begin."""
    full = codes.copy()
    for k in range(1, ORDER):
        full[k:] |= codes[:-k] << (8 * k)
    width = size + ORDER
    start = np.cumsum(width) - width
    n = size + 1
    begin = np.cumsum(n) - n
    at = np.repeat(start + ORDER - 1, n) + np.arange(int(n.sum())) - np.repeat(begin, n)
    return full[at], begin


def _slot(gram: np.ndarray, k: int) -> np.ndarray:
    """The slot of the last k codes of a gram."""
    return (K.mix((gram & ((1 << (8 * k)) - 1)).astype(np.uint64) * K.U64(8) + K.U64(k)) >> K.U64(44)).astype(np.int64)


class Counts:
    """By order and class: counts, context totals and context kinds in hashed slots; low orders hold both classes."""

    def __init__(self, gram: np.ndarray, label: np.ndarray, n: np.ndarray):
        self.levels = []
        for k in range(ORDER, 0, -1):
            classes = []
            for c in (0, 1) if k > SHARED else (None,):
                g, m = (gram, n) if c is None else (gram[label == c], n[label == c])
                if k < ORDER:  # continuations: kinds of the code before
                    g, m = np.unique(g & ((1 << (8 * (k + 1))) - 1)), None
                g, inv = np.unique(g & ((1 << (8 * k)) - 1), return_inverse=True)
                m = np.bincount(inv, m, minlength=len(g))
                ctx = _slot(g >> 8, k - 1) if k > 1 else np.zeros(len(g), np.int64)
                classes.append(tuple(np.bincount(s, w, minlength=SLOTS).astype(np.float32) for s, w in ((_slot(g, k), m), (ctx, m), (ctx, None))))
            self.levels.append((k, classes))

    def probability(self, gram: np.ndarray, label: int) -> np.ndarray:
        p = np.full(len(gram), 1 / 257)
        for k, classes in reversed(self.levels):
            count, total, kinds = classes[label if len(classes) > 1 else 0]
            ctx = _slot(gram >> 8, k - 1) if k > 1 else np.zeros(len(gram), np.int64)
            t = np.maximum(total[ctx], 1)
            lost = np.where(total[ctx] > 0, DISCOUNT * kinds[ctx] / t, 1.0)
            p = np.maximum(count[_slot(gram, k)] - DISCOUNT, 0) / t + lost * p
        return p

    def ratio(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each word, toxic against ordinary."""
        g, begin = grams(codes, size)
        g, inv = np.unique(g, return_inverse=True)
        llr = np.log(self.probability(g, 1)) - np.log(self.probability(g, 0))
        return np.add.reduceat(llr[inv], begin)


def features(counts: Counts, raw, offsets) -> np.ndarray:
    """Per text: the mean log ratio of its words, the largest, the mean of the TOP largest, and how much stands out for its length."""
    n = len(offsets) - 1
    out = np.zeros((n, 4))
    doc, number, codes, size = distinct_words(raw, offsets)
    if not len(number):
        return out
    llr = counts.ratio(codes, size)[number]
    length = np.bincount(doc, minlength=n)
    out[:, 0] = np.bincount(doc, llr, minlength=n) / np.maximum(length, 1)
    hot = np.flatnonzero(llr > 1)
    order = hot[np.lexsort((-llr[hot], doc[hot]))]
    d = doc[order]
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
    rank = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
    out[d[rank == 0], 1] = llr[order[rank == 0]]
    keep = rank < TOP
    out[:, 2] = np.bincount(d[keep], llr[order[keep]], minlength=n) / TOP
    out[:, 3] = np.bincount(d, llr[order], minlength=n) / np.sqrt(length + 20)
    return out


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.clip(x[:, 0], -3, 3), np.clip(x[:, 1:], 0, 12), np.clip(x[:, 1], 0, 12) ** 2 / 8])


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (p - y)) + ridge * b
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass(frozen=True)
class Model:
    counts: bytes | None
    curve: np.ndarray
    prior: float


def _pack(counts: Counts) -> bytes:
    """The tables, most of whose slots are empty, as what is broadcast."""
    return zlib.compress(pickle.dumps(counts.levels, 5), 1)


@lru_cache(1)
def _restore(packed: bytes) -> Counts:
    c = Counts.__new__(Counts)
    c.levels = pickle.loads(zlib.decompress(packed))
    return c


def fit(labelled: DataFrame, docs: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """labelled: key and 0/1 label. Uses about per_class rows a class, dealt by a hash of the key.

    Two thirds of them give the counts, one third the curve. The sample's bound makes
    the label rows small enough to broadcast, and the tables have a fixed size.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = labelled.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    found = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return Model(None, np.zeros(1), float(1 in found))
    prior = found[1] / sum(found.values())
    cut = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / found[1]))).otherwise(F.lit(min(1.0, per_class / found[0])))
    sample = rows.withColumn("u", F.xxhash64("k", F.lit(11)) / F.lit(2.0**64) + 0.5).where(F.col("u") <= cut).select("k", "y", (F.xxhash64("k", F.lit(12)) % 3 == 0).alias("later"))
    some = docs.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("text")).join(F.broadcast(sample), "k")

    def count(batches):
        for whole in batches:
            for batch in K.blocks(whole, "text"):
                raw, off = K.string_bytes(batch.column(batch.schema.get_field_index("text")))
                y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
                doc, number, codes, size = distinct_words(raw, off)
                if not len(number):
                    continue
                g, begin = grams(codes, size)
                for c in (0, 1):
                    times = np.bincount(number, y[doc] == c, minlength=len(size)).astype(np.int64)
                    code, inv = np.unique(g, return_inverse=True)
                    n = np.bincount(inv, np.repeat(times, size + 1), minlength=len(code)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"code": pa.array(code[n > 0] | (c << 40)), "n": pa.array(n[n > 0])})

    total = some.where(~F.col("later")).select("text", "y").mapInArrow(lean(count), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    got = total.toArrow()
    code, n = got.column("code").to_numpy(), got.column("n").to_numpy()
    counts = Counts(code & ((1 << 40) - 1), code >> 40, n)
    packed = _pack(counts)
    shared = spark.sparkContext.broadcast(packed)

    def evidence(batches):
        c = _restore(shared.value)
        for whole in batches:
            for batch in K.blocks(whole, "text"):
                raw, off = K.string_bytes(batch.column(batch.schema.get_field_index("text")))
                x = features(c, raw, off)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), *(pa.array(v) for v in x.T)], names=["y", "a", "b", "c", "d"])

    seen = some.where("later").select("text", "y").mapInArrow(lean(evidence), "y int, a double, b double, c double, d double").toArrow()
    y = seen.column("y").to_numpy().astype(float)
    x = np.column_stack([seen.column(k).to_numpy() for k in "abcd"])
    weight = np.where(y == 1, max(1.0, found[1] / per_class), max(1.0, found[0] / per_class))
    curve = logistic(_design(x), y, weight) if 0 < y.sum() < len(y) else np.zeros(6)
    return Model(packed, curve, prior)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 where score >= THRESHOLD)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = spark.sparkContext.broadcast((model.counts, model.curve, model.prior))

    def run(batches):
        packed, curve, prior = shared.value
        c = _restore(packed) if packed is not None else None
        for whole in batches:
            for batch in K.blocks(whole, "__low"):
                if c is None or len(curve) < 2:
                    p = np.full(batch.num_rows, prior)
                else:
                    raw, off = K.string_bytes(batch.column(batch.schema.get_field_index("__low")))
                    p = 1 / (1 + np.exp(-np.clip(_design(features(c, raw, off)) @ curve, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keep] + [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.lower(F.col(text)).alias("__low")).mapInArrow(lean(run), schema)
