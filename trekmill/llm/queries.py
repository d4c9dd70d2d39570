"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, images, langid, mixing, neardup, neighbours, packing, repeats, token_file, toxicity
from .common import fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    got = langid.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score", "proportions")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    model = toxicity.fit(labels, docs)
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    got = mixing.taken(mixing.mix(docs))
    return got.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "source", "first_slot", "last_slot", "n_slots")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has pictures, so each embedding is drawn as one."""
    pictures = images.rendered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return images.copies(pictures).withColumnRenamed("key", "image_id")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = neardup.near_duplicates(docs, k=3, per_cent=85)
    return got.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return got.withColumnRenamed("key", "doc_id")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = token_file.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return got.withColumnRenamed("key", "doc_id")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_mixing, op3_suffix_array, op4_images, op5_html_text, op6_toxicity, op7_minhash, op8_packing, op9_token_file, op10_neighbours)}
ORACLES: dict[str, str] = {}
