"""Mixing sources to target weights on a low-discrepancy schedule.

Slot k of the mix holds one block of words. The golden-ratio point frac(k / phi)
falls into one source's part of the cumulative target shares, so every stretch of
the schedule has the sources near their shares. A source's slots are ranked, and
rank r takes block r of that source's shuffled stream, which starts again when it
is through, at most max_repeat times; slots beyond that stay empty. What a source
gives is therefore its slots times the block, within a few blocks of its target.

Streams and ranks are laid out by two-level prefix sums (buckets of a hash range or
of slots, then rows in a bucket), so no source's rows meet in one task.

Defined cases: a null text has size 0 and takes part with 0 words; a null source is
a source of its own, last in order; very long texts lie in many slots; repeated rows
are documents of their own, equal rows in either order; a source of no words has
target 0; an empty table gives an empty result; other input columns only take part
in the shuffle's hash, and none of their names clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
#: Rows a bucket of a stream holds, and slots a chunk of the schedule holds, about.
BUCKET_ROWS, CHUNK = 4000, 8192
#: Words of a block at most and at least, and slots wanted at least in between.
BLOCK, LEAST_BLOCK, SLOTS = 2048, 8, 1 << 16


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(source_size: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), max_repeat: float = 3) -> list[tuple]:
    """(source, position, size, target): shares of all sizes by weight; what exceeds max_repeat times a size goes to the others.

    Sources are ordered by code point, null last, and weigh what weights say, over and over.
    """
    order = sorted(source_size, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [float(weights[i % len(weights)]) for i in range(len(order))]
    caps = [max_repeat * n for _, n in order]
    total = float(sum(n for _, n in order))
    got, open_ = [0.0] * len(order), [i for i, c in enumerate(caps) if c > 0]
    left = total
    while open_ and left > 0:
        unit = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if unit * weight[i] > caps[i]]
        if not full:
            for i in open_:
                got[i] = unit * weight[i]
            break
        for i in full:
            got[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in full]
    return [(s, i, n, got[i]) for i, (s, n) in enumerate(order)]


@dataclass(frozen=True)
class Mix:
    """stream: each row with pos (source number), start (its words before it in the stream) and filled (the stream's words that slots take).
    slots: slot, pos, rank. sources: source, pos, source_size, target, filled, block."""

    stream: DataFrame
    slots: DataFrame
    sources: DataFrame
    block: int

    def placed(self) -> DataFrame:
        """One row for each part of a document in a slot: the stream's columns, slot, turn, first, words."""
        s = self.stream.where("size > 0")
        times = s.withColumn("turn", F.explode(F.expr("sequence(0L, greatest(0L, (filled - start - 1) div source_size))"))).where("turn * source_size + start < filled")
        times = times.withColumn("lo", F.col("turn") * F.col("source_size") + F.col("start")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("filled")))
        parts = times.withColumn("rank", F.explode(F.expr(f"sequence(lo div {self.block}, (hi - 1) div {self.block})")))
        first = F.greatest("lo", F.col("rank") * self.block)
        parts = parts.withColumn("words", F.least("hi", (F.col("rank") + 1) * self.block) - first).withColumn("first", first - F.col("lo"))
        return parts.join(self.slots, ["pos", "rank"])


def prefix(df: DataFrame, keys: list[str], bucket: str, value: Column, order: list[Column], out: str) -> DataFrame:
    """df with out: the sum of value over rows before it in (bucket, order) among those of equal keys."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(w), F.lit(0).cast("long"))).drop("__sum")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [*keys, bucket]).withColumn(out, F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long"))).drop("__before")


def schedule(spark: SparkSession, shares: list[float], n_slots: int) -> DataFrame:
    """slot, pos, rank: the share that each golden-ratio point falls into, and the slots of that share before it."""
    edges = [sum(shares[: i + 1]) for i in range(len(shares) - 1)]
    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    drawn = spark.range(n_slots).select(F.col("id").alias("slot")).withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    drawn = drawn.withColumn("point", point).withColumn("pos", F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("point"))).cast("int") if edges else F.lit(0))
    return prefix(drawn.select("slot", "chunk", "pos"), ["pos"], "chunk", F.lit(1).cast("long"), [F.col("slot")], "rank").select("slot", "pos", "rank")


def salt(docs: DataFrame, seed: int) -> Column:
    """What rows are shuffled by: only rows equal in all columns share it."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns])


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3, block: int | None = None, seed: int = 1) -> Mix:
    """Plans the mix of all docs. What reaches the driver is one row a source."""
    spark = docs.sparkSession
    rows = written(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), sizes(F.col(text)).alias("size"), salt(docs, seed).alias("salt")), "mix-sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    plan = targets([(r["source"], r["n"]) for r in found], weights, max_repeat)
    count = {r["source"]: r["rows"] for r in found}
    total = sum(t for *_, t in plan)
    block = block or max(LEAST_BLOCK, min(BLOCK, int(total) // SLOTS))
    slots = written(schedule(spark, [t / total for *_, t in plan], round(total / block)), "mix-slots") if total else spark.createDataFrame([], "slot long, pos int, rank long")
    have = {r["pos"]: r["n"] for r in slots.groupBy("pos").agg(F.count("*").alias("n")).collect()}  # one row a source
    filled = [min(have.get(i, 0) * block, max_repeat * n) for _, i, n, _ in plan]
    shares = spark.createDataFrame(
        [(s, i, n, float(t), f, max(1, count[s] // BUCKET_ROWS)) for (s, i, n, t), f in zip(plan, filled, strict=True)],
        "source string, pos int, source_size long, target double, filled long, buckets long",
    )
    sources = F.broadcast(shares)  # one row a source
    joined = rows.join(sources, rows["source"].eqNullSafe(shares["source"])).drop(shares["source"])
    joined = joined.withColumn("bucket", F.expr("pmod(shiftrightunsigned(salt, 16), buckets)"))
    stream = prefix(joined, ["pos"], "bucket", F.col("size"), [F.col("salt"), F.col("size")], "start")
    return Mix(stream, slots, shares, block)


def taken(plan: Mix) -> DataFrame:
    """key, size, source, source_size, target, taken (words of it in the mix, repeats counted), first_slot, last_slot and n_slots of every document."""
    used = plan.placed().groupBy("pos", "bucket", "start").agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"))
    # Equal rows have different starts; only rows of no words share one, and these take nothing.
    some = plan.stream.where("size > 0").join(used, ["pos", "bucket", "start"], "left").withColumn("taken", F.coalesce("words", F.lit(0).cast("long"))).withColumn("n_slots", F.coalesce("n_slots", F.lit(0).cast("long")))
    none = plan.stream.where("size = 0").select("*", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(None).cast("long").alias("last_slot"), F.lit(0).cast("long").alias("n_slots"))
    names = ["key", "size", "source", "source_size", "target", "taken", "first_slot", "last_slot", "n_slots"]
    return some.select(names).unionByName(none.select(names))


def mixed(plan: Mix, docs: DataFrame, text: str = "text", seed: int = 1, slot: str | None = None) -> DataFrame:
    """docs as the mix has them: a row for each turn a document is in, its text cut where the last turn ends within it.

    docs, and the names and seed, are those that the mix was planned with. slot: name of a
    further column, the slot where the turn begins; rows in its order are the schedule.
    """
    turns = plan.placed().groupBy("salt", "pos", "bucket", "start", "turn", "size").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    turns = turns.select(F.col("salt").alias("__salt"), F.col("size").alias("__size"), F.col("words").alias("__words"), F.col("slot").alias("__slot"))
    one = docs.withColumn("__salt", salt(docs, seed)).dropDuplicates(["__salt"])  # rows of one salt are equal in all columns
    # Each part holds one word and the white space before it.
    parts = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(parts, F.lit(1), F.col("__words").cast("int")), "")
    got = turns.join(one, "__salt").withColumn(text, F.when(F.col("__words") < F.col("__size"), cut).otherwise(F.col(text)))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col("__slot").alias(slot)] if slot else []))
