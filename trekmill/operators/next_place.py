"""Next places from contexts of up to `order` last places, with back-off to shorter ones.

The counts are one row for each user, context and place after it; contexts are arrays,
the oldest place first. Everything is joins and aggregations; a user's visits meet only
in the window that numbers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbered(visits: DataFrame) -> DataFrame:
    """uid, location_id, k: the visits with a place, numbered from 1 in each user's order."""
    return visits.where("location_id is not null").select("uid", "location_id", F.row_number().over(Window.partitionBy("uid").orderBy("started_at", "location_id")).alias("k"))


def _histories(steps: DataFrame, order: int, partition: list[str], by: str) -> DataFrame:
    """steps with past: up to order places before each, the oldest first."""
    before = Window.partitionBy(*partition).orderBy(by).rowsBetween(-order, -1)
    return steps.withColumn("past", F.collect_list("location_id").over(before) if order else F.array().cast("array<bigint>"))


def _contexts(past: str):
    """All ends of past, the empty one among them."""
    return F.transform(F.sequence(F.lit(0), F.size(past)), lambda n: F.slice(F.col(past), F.size(past) - n + 1, n))


def context_counts(visits: DataFrame, order: int = 1) -> DataFrame:
    """uid, context, next_id, n: how often each place came after each context of 0 to order places."""
    steps = _histories(_numbered(visits), order, ["uid"], "k")
    return steps.select("uid", F.col("location_id").alias("next_id"), F.explode(_contexts("past")).alias("context")).groupBy("uid", "context", "next_id").agg(F.count("*").alias("n"))


def _ranked(counts: DataFrame, asked: DataFrame, keys: list[str], top_k: int, backoff: bool, order: int) -> DataFrame:
    """The top_k places of each asked row (keys, uid, past) after the longest end of past that was seen."""
    ends = asked.select(*keys, F.size("past").alias("whole"), F.explode(_contexts("past")).alias("context")).withColumn("length", F.size("context"))
    if not backoff:
        ends = ends.where(F.col("length") == F.lit(order))
    met = ends.join(counts, [*[k for k in keys if k in counts.columns], "context"])
    longest = Window.partitionBy(*keys)
    best = met.withColumn("longest", F.max("length").over(longest)).where("length = longest")
    ranked = best.withColumn("total", F.sum("n").over(longest)).withColumn("rank", F.row_number().over(longest.orderBy(F.desc("n"), "next_id")))
    return ranked.where(F.col("rank") <= top_k).select(*keys, "rank", "next_id", F.col("length").alias("context_length"), F.round(F.col("n") / F.col("total"), 6).alias("probability"))


def predict_proba(visits: DataFrame, order: int = 1, top_k: int = 1, backoff: bool = True) -> DataFrame:
    """uid, rank, next_id, context_length, probability: the likeliest places after each user's last ones; ties: smaller id.

    Without backoff a user whose last `order` places were not seen together before has no row.
    """
    steps = _numbered(visits)
    last = steps.groupBy("uid").agg(F.max("k").alias("m"))
    tail = steps.join(last, "uid").where(F.col("k") > F.col("m") - order).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "location_id"))).alias("t"))
    asked = last.select("uid").join(tail, "uid", "left").select("uid", F.coalesce(F.col("t.location_id"), F.array().cast("array<bigint>")).alias("past"))
    return _ranked(context_counts(visits, order), asked, ["uid"], top_k, backoff, order)


def predict(visits: DataFrame, order: int = 1, top_k: int = 1, backoff: bool = True) -> DataFrame:
    """uid, rank, next_id of predict_proba."""
    return predict_proba(visits, order, top_k, backoff).select("uid", "rank", "next_id")


def evaluate(visits: DataFrame, order: int = 1, top_k: int = 1, n_holdout: int = 1, backoff: bool = True) -> DataFrame:
    """One row: the share of held-out steps whose place is among the top_k, the steps and the users; null where no user has more than n_holdout visits.

    Each user's last n_holdout visits are held out; each is predicted from all visits before it.
    """
    steps = _numbered(visits)
    last = steps.groupBy("uid").agg(F.max("k").alias("m")).where(F.col("m") > n_holdout)
    histories = _histories(steps, order, ["uid"], "k")
    asked = histories.join(last, "uid").where(F.col("k") > F.col("m") - n_holdout).select("uid", F.col("k").alias("step"), F.col("location_id").alias("truth"), "past")
    # What was known at a step: contexts whose next place came before it.
    known = histories.select("uid", "k", F.col("location_id").alias("next_id"), F.explode(_contexts("past")).alias("context"))
    ends = asked.select("uid", "step", F.explode(_contexts("past")).alias("context"))
    counts = ends.join(known, ["uid", "context"]).where("k < step").groupBy("uid", "step", "context", "next_id").agg(F.count("*").alias("n"))
    found = _ranked(counts, asked.select("uid", "step", "past"), ["uid", "step"], top_k, backoff, order)
    hits = asked.join(found.select("uid", "step", F.col("next_id").alias("truth"), F.lit(1).alias("hit")), ["uid", "step", "truth"], "left")
    return hits.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("accuracy"), F.count("*").alias("steps"), F.count_distinct("uid").alias("users"))
