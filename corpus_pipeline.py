"""A training-corpus pipeline over documents: five stages, each written and read again by its caller.

Language ID drops texts without letters. Of each group of near-duplicates (five-word
shingles, similarity 0.8) the document with the least id stays; rows of one id stand or
fall together, and of equal rows one stays. Passages of more than 50 words that occur
elsewhere are cut out. Sources are mixed to their target weights, so a document may
appear up to three times or end early. The last stage packs token sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trekmill.llm import langid, mixing, neardup, packing, repeats
from trekmill.llm.common import shared_path

#: A passage is a run of repeated bytes that holds more than 50 words; runs are of strings of so many bytes.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 192


def _columns(docs: DataFrame, like: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(like) if "n_chars" in like else docs.select(like)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # Columns travel under numbers, as the operator's own may have the same names.
    got = langid.identify(docs.toDF(*[f"__{i}" for i in range(len(docs.columns))]), model, f"__{docs.columns.index('text')}")
    return got.where("lang_pred != 'und'").drop(*langid.OUT).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicates(docs.select("doc_id", "text"))
    kept = groups.where("kept").select(F.col("key").alias("__key")).distinct()
    got = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__key"))).drop("__key")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return got.select(docs.columns) if repeated.isEmpty() else got.dropDuplicates(docs.columns).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(repeats.remove(docs, least=PASSAGE_BYTES, keep_text=True, words=PASSAGE_WORDS), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(mixing.mixed(mixing.mix(docs), docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return got.withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: SQL has no tokenizer and no near-duplicate join of this kind; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
