"""Language identification by multilingual mixture inference.

A word's likelihood under a language is the product of its byte-trigram
probabilities there. A document is a mixture: every word comes from one language,
and expectation-maximisation estimates the proportions. The set of languages is
grown while the penalised likelihood (BIC) improves.

Defined cases: a null, empty or letterless text is ``und`` with score 0 and null
proportions; ties go to the language first in code-point order; repeated rows get
equal answers; an empty table gives an empty result; a model without languages
answers ``und``; input columns named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import arrow_batches, lean

BUCKETS = 1 << 16
#: Training rows per language: the bound of the sample that fits the model.
SAMPLE_PER_LANGUAGE = 3000
OUT = ["lang_pred", "score", "proportions"]


def _trigrams(raw: np.ndarray, offsets: np.ndarray):
    """Bucket of the trigram around each letter byte, the starts of words in that, and each word's text."""
    for a, b in K.slices(raw, offsets, K.LETTERS):
        data = K.LETTERS[raw[a:b]].astype(np.uint32)
        inside = data != 0
        lo, hi = np.searchsorted(offsets, [a, b])
        cuts = offsets[lo:hi] - a
        cuts = cuts[(cuts < len(data)) & (cuts > 0)]
        left, right = np.zeros_like(data), np.zeros_like(data)
        left[1:], right[:-1] = data[:-1], data[1:]
        left[cuts] = 0
        right[cuts - 1] = 0
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        h = (left[at] * np.uint32(0x85EBCA6B) ^ data[at] * np.uint32(0xC2B2AE35) ^ right[at] * np.uint32(0x27D4EB2F)) * np.uint32(0x9E3779B1)
        starts = np.flatnonzero(left[at] == 0)
        docs = np.searchsorted(offsets, at[starts] + a, side="right") - 1
        yield (h >> np.uint32(16)).astype(np.int64), starts, docs


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages, float32


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Trigram models from about per_language rows a language, dealt by a hash of the text.

    What reaches the driver is BUCKETS counts a language, whatever the input's size.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    share = spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in found.items()], "lang string, share double")
    sample = rows.join(F.broadcast(share), "lang").where((F.xxhash64("text") / F.lit(2.0**64) + 0.5) <= F.col("share"))

    def count(batches):
        for whole in batches:
            for batch in K.blocks(whole, "text"):
                raw, off = K.string_bytes(batch.column(batch.schema.get_field_index("text")))
                codes = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
                lang_of, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
                total = np.zeros(len(names) * BUCKETS, np.int64)
                for h, starts, docs_ in _trigrams(raw, off):
                    per_gram = np.repeat(lang_of[docs_], np.diff(np.append(starts, len(h))))
                    total += np.bincount(per_gram * BUCKETS + h, minlength=len(total))
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(names, pa.string()).take(pa.array(at // BUCKETS)), "bucket": pa.array((at % BUCKETS).astype(np.int32)), "n": pa.array(total[at])})

    counts = sample.select("text", F.lower("text").alias("low"), "lang").select(F.col("low").alias("text"), "lang").mapInArrow(lean(count), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(found)
    c = np.zeros((BUCKETS, len(names)))
    np.add.at(c, (counts.column("bucket").to_numpy(), np.searchsorted(names, counts.column("lang").to_pylist())), counts.column("n").to_numpy())
    p = (c + 0.05) / (c.sum(0) + 0.05 * BUCKETS)
    return LanguageModel(names, np.log(p).astype(np.float32))


def infer(ll: np.ndarray, starts: np.ndarray, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) of texts whose words have log-likelihoods ll, and the sizes of their language sets.

    starts: the first word of each text; every text has a word.
    """
    n_lang = ll.shape[1]
    sizes = np.diff(np.append(starts, len(ll)))
    single = np.add.reduceat(ll, starts, axis=0)
    best = single.argmax(1)
    out = np.zeros((len(starts), n_lang))
    out[np.arange(len(starts)), best] = 1
    k_of = np.ones(len(starts), np.int64)
    if n_lang == 1:
        return out, k_of
    top = ll.max(1)
    like = np.exp(ll - top[:, None])
    base = np.add.reduceat(top, starts)

    def em(like, sizes, pi, steps):
        starts = np.cumsum(sizes) - sizes
        for _ in range(steps):
            r = like * np.repeat(pi, sizes, axis=0)
            r /= r.sum(1, keepdims=True) + 1e-300
            pi = np.add.reduceat(r, starts, axis=0) / sizes[:, None]
        fit = (like * np.repeat(pi, sizes, axis=0)).sum(1)
        return pi, np.add.reduceat(np.log(fit + 1e-300), starts)

    full, _ = em(like, sizes, np.full_like(out, 1 / n_lang), steps)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    bic = -2 * single.max(1)
    live = np.arange(len(starts))
    for k in range(2, n_lang + 1):
        if not len(live):
            break
        rows = np.repeat(np.isin(np.arange(len(starts)), live), sizes)
        pi = np.where(rank[live] < k, full[live] + 1e-6, 0)
        pi, fitted = em(like[rows], sizes[live], pi / pi.sum(1, keepdims=True), steps)
        now = -2 * (fitted + base[live]) + 2 * (k - 1) * np.log(sizes[live] + 1)
        better = now < bic[live]
        live, pi, now = live[better], pi[better], now[better]
        out[live], bic[live], k_of[live] = pi, now, k
    return out, k_of


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (that language's proportion) and proportions (by model.languages)."""
    arrow_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in OUT]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", T.ArrayType(T.DoubleType()))])
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))

    def score(batches):
        names, log_p = shared.value
        for whole in batches:
            for batch in K.blocks(whole, "__low", K.SLICE):
                low = batch.column(batch.schema.get_field_index("__low"))
                raw, off = K.string_bytes(low)
                lls, docs_ = [np.zeros((0, len(names)))], [np.zeros(0, np.int64)]
                if names:
                    for h, starts, d in _trigrams(raw, off):
                        lls.append(np.add.reduceat(log_p[h], starts, axis=0).astype(np.float64))
                        docs_.append(d)
                ll, doc = np.concatenate(lls), np.concatenate(docs_)
                pred, points, parts = ["und"] * batch.num_rows, np.zeros(batch.num_rows), [None] * batch.num_rows
                if len(ll):
                    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                    pi, _ = infer(ll, first)
                    lettered = batch.column(batch.schema.get_field_index("__letters")).to_pylist()
                    for i, d in enumerate(doc[first]):
                        if lettered[d]:
                            best = int(pi[i].argmax())
                            pred[d], points[d], parts[d] = names[best], min(1.0, pi[i, best]), pi[i].tolist()
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(pred, pa.string()), pa.array(points), pa.array(parts, pa.list_(pa.float64()))], names=[*keep, *OUT])

    return docs.select(*keep, F.lower(F.col(text)).alias("__low"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters")).mapInArrow(lean(score), schema)
