"""Re-identification risk for knowledge of any size, and the instances behind it.

Known are k items of a user's data (all of it, where it has fewer). Where an attack asks for
containment, a user contains a combination just when it is one of the user's own, so
combinations are counted and never compared; where it allows a tolerance, combinations of
the same places meet and their values are compared. Combinations grow with the k-th power of
a user's items: k is meant to be 2 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTAINED = ("location", "location_sequence", "location_time", "unique_location")
VALUED = ("location_frequency", "location_probability", "location_proportion")


def _items(visits: DataFrame, attack: str, k: int, precision: str) -> DataFrame:
    """uid, idx, item, v: what an attacker may know, in the order combinations take it."""
    # Dealt by user once: items and their combinations, each once a user, then need no further shuffle.
    rows = visits.where("location_id is not null").repartition("uid").withColumn("place", F.col("location_id").cast("string"))
    if attack == "location_sequence":
        line = Window.partitionBy("uid").orderBy("started_at", "location_id")
        return rows.select("uid", F.row_number().over(line).alias("idx"), F.col("place").alias("item"), F.lit(1.0).alias("v"))
    if attack == "location_time":
        rows = rows.where("started_at is not null").withColumn("place", F.concat_ws(" ", "place", F.date_trunc(precision, "started_at").cast("string")))
    counted = rows.groupBy("uid", F.col("place").alias("item")).agg(F.count("*").cast("double").alias("v"))
    if attack in ("location", "location_time"):
        counted = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("v").cast("int")))))
    else:
        counted = counted.withColumn("copy", F.lit(1))
    if attack == "location_probability":
        counted = counted.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("uid")))
    return counted.withColumn("idx", F.row_number().over(Window.partitionBy("uid").orderBy("item", "copy"))).select("uid", "idx", "item", "v")


def _combinations(items: DataFrame, k: int) -> DataFrame:
    """uid, known, values: all combinations of 1 to k items in their order, each once a user; size is the items known of the user."""
    step = items.select("uid", F.col("idx").alias("last"), F.array("item").alias("known"), F.array("v").alias("values"))
    every = step
    for _ in range(k - 1):
        step = step.join(items, "uid").where(F.col("idx") > F.col("last")).select("uid", F.col("idx").alias("last"), F.concat("known", F.array("item")).alias("known"), F.concat("values", F.array("v")).alias("values"))
        every = every.unionByName(step)
    return every.groupBy("uid", "known", "values").agg(F.count("*").alias("times")).drop("times")


def assess_risk(visits: DataFrame, knowledge_length: int = 2, attack: str = "location", tolerance: float = 0.1, precision: str = "hour", targets: DataFrame | None = None, force_instances: bool = False) -> DataFrame:
    """uid, risk: 1 over the fewest users that fit what may be known of the user; with force_instances every combination (uid, known, users, risk).

    attack: location (places of visits, repeats counted), unique_location, location_time (with times to the precision),
    location_sequence (in order), location_frequency, location_probability, location_proportion (places with their visits,
    shares, or visits relative to the largest known, within tolerance). targets: a table of uids to assess, all by default.
    """
    if attack not in (*CONTAINED, *VALUED):
        raise ValueError(f"attack is one of {(*CONTAINED, *VALUED)}")
    if knowledge_length < 1:
        raise ValueError("knowledge_length is 1 or more")
    items = _items(visits, attack, knowledge_length, precision)
    most = items.groupBy("uid").agg(F.least(F.lit(knowledge_length), F.count("*")).cast("int").alias("most"))
    found = _combinations(items, knowledge_length)
    if attack == "location_proportion":
        found = found.withColumn("values", F.transform("values", lambda x: x / F.array_max("values")))
    # No combination has more than most; with = this would be a key of the join, and all would be dealt by it.
    asked = found.join(most, "uid").where(F.size("known") >= F.col("most")).drop("most")
    if targets is not None:
        asked = asked.join(targets.select("uid").distinct(), "uid", "left_semi")
    if attack in CONTAINED:
        # A user has a combination once, as its values follow from the user and the items.
        fits = found.groupBy("known").agg(F.count("uid").alias("users"))
        risks = asked.select("uid", "known").join(fits, "known")
    else:
        # Different values of one combination are compared once, however many users share them.
        held = found.groupBy("known", "values").agg(F.count("*").alias("n"))
        wanted = asked.select("known", F.col("values").alias("own")).distinct()
        near = F.forall(F.arrays_zip(F.col("own").alias("x"), F.col("values").alias("y")), lambda z: (z["x"] >= z["y"] * (1 - tolerance)) & (z["x"] <= z["y"] * (1 + tolerance)))
        fits = wanted.join(held, "known").where(near).groupBy("known", "own").agg(F.sum("n").alias("users"))
        risks = asked.select("uid", "known", F.col("values").alias("own")).join(fits, ["known", "own"])
    risks = risks.withColumn("risk", F.round(1 / F.col("users"), 6))
    if force_instances:
        return risks.select("uid", "known", "users", "risk")
    return risks.groupBy("uid").agg(F.max("risk").alias("risk"))
