"""Contact graphs: clustering, overlap, and the classes of contacts against random daily graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import SqlOperator as Op
from .contacts import Graphs, _ranked, contact_days, daily_contacts, spanned_days
from .sequence import _UNDIRECTED

graph_from_edges = Op("graph_from_edges", "Undirected edges without repeats, self loops and ends outside 0 to node_count - 1 (no upper end unless given).", "SELECT DISTINCT least(origin, destination) AS u, greatest(origin, destination) AS v FROM {flows} WHERE origin <> destination AND least(origin, destination) >= 0 AND greatest(origin, destination) < <node_count>", node_count=9223372036854775807)
_BOTH = f"SELECT u AS a, v AS b FROM ({_UNDIRECTED}) q1 UNION ALL SELECT v AS a, u AS b FROM ({_UNDIRECTED}) q2"
clustering_coefficients = Op(
    "clustering_coefficients",
    "Share of a user's pairs of contacts that are in contact; 0 below two contacts.",
    f"""WITH e AS ({_UNDIRECTED}), s AS ({_BOTH}), d AS (SELECT a, count(*) AS n FROM s GROUP BY a),
      t AS (SELECT x.a, count(*) AS closed FROM s x JOIN s y ON x.b = y.a JOIN e ON e.u = least(x.a, y.b) AND e.v = greatest(x.a, y.b) WHERE x.a <> y.b GROUP BY x.a)
      SELECT d.a AS uid, round(CASE WHEN d.n < 2 THEN 0e0 ELSE coalesce(t.closed, 0) / CAST(d.n * (d.n - 1) AS DOUBLE) END, 6) AS clustering FROM d LEFT JOIN t ON d.a = t.a""",
    minutes=5,
)


def random_daily_graphs(contacts: DataFrame, replicates: int = 5, seed: int = 42) -> DataFrame:
    """replica, day, u, v: each day's contacts dealt anew among its users with their degrees kept.

    Every end of a contact is a stub; stubs of a (replica, day) in the order of a seeded hash are paired in turn.
    Self loops and repeats are left out, so degrees are kept on average.
    """
    kinds = {c: contacts.schema[c].dataType.simpleString() for c in ("day", "u")}
    rows = contacts.select("day", "u", "v", F.xxhash64("u", "v").alias("edge")).crossJoin(F.broadcast(contacts.sparkSession.range(replicates).withColumnRenamed("id", "replica")))
    # The hash of a stub goes on from here with its end, 0 or 1.
    rows = rows.select("replica", "day", "u", "v", "edge", F.xxhash64(F.lit(seed), "replica", "day", "edge").alias("drawn"))

    def deal(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        (u, v), names = _ranked(table["u"], table["v"])
        edge, drawn = (table[c].to_numpy() for c in ("edge", "drawn"))
        stubs = np.concatenate([_with_end(drawn, 0), _with_end(drawn, 1)])
        order = np.argsort(stubs)
        if (np.diff(stubs[order]) == 0).any():
            order = np.lexsort((np.repeat([0, 1], len(edge)), np.tile(edge, 2), stubs))
        who = np.concatenate([u, v])[order]
        low, high = np.minimum(who[::2], who[1::2]), np.maximum(who[::2], who[1::2])
        pairs = np.unique((low * len(names) + high)[low != high])
        for at in range(0, len(pairs), 1 << 22):
            part = pairs[at : at + (1 << 22)]
            yield pa.RecordBatch.from_pydict({n: pa.array([k.as_py()], k.type).take(pa.array(np.zeros(len(part), np.int64))) for n, k in zip(("replica", "day"), key, strict=True)} | {"u": names.take(pa.array(part // len(names))), "v": names.take(pa.array(part % len(names)))})

    return rows.groupBy("replica", "day").applyInArrow(deal, f"replica bigint, day {kinds['day']}, u {kinds['u']}, v {kinds['u']}")


def _with_end(drawn: np.ndarray, end: int) -> np.ndarray:
    """Spark's xxhash64 of the int end, with drawn as its seed."""
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (drawn.view(np.uint64) + five + np.uint64(4)) ^ (np.uint64(end) * one)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * two + three
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def persistence_and_overlap(contacts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of the spanned days that have a contact, and the overlap of its ends' neighbours, for each graph of by."""
    return _measured(Graphs.of_edges(contacts, "count", by))


def _measured(graphs: Graphs, span: DataFrame | None = None, named: bool = True) -> DataFrame:
    """span: the days of each graph, else those its edges span."""
    span = span if span is not None else graphs.days()
    got = graphs.overlaps(named)
    got = got.join(F.broadcast(span), graphs.by) if graphs.by else got.crossJoin(F.broadcast(span))
    return got.select(*graphs.by, *(["u", "v"] if named else []), (F.col("n") / F.col("days")).alias("persistence"), "overlap")


def overlap_of_stays(visits: DataFrame, minutes: int = 5) -> DataFrame:
    """u, v, overlap: the rows of sequence.topological_overlap."""
    return Graphs.of_stays(visits, minutes).overlaps().select("u", "v", F.round("overlap", 6).alias("overlap"))


def _share(n: str, t: str):
    return F.when(F.col(n) > 1, F.col(t) / (F.col(n) * (F.col(n) - 1))).otherwise(0.0)


def clustering_of_stays(visits: DataFrame, minutes: int = 5) -> DataFrame:
    """uid, clustering: the rows of clustering_coefficients."""
    return Graphs.of_stays(visits, minutes).closed_pairs().select("uid", F.round(_share("n", "t"), 6).alias("clustering"))


def mean_clustering_of_stays(visits: DataFrame, minutes: int = 5) -> DataFrame:
    """clustering: mean_clustering of all contacts of stays."""
    return Graphs.of_stays(visits, minutes).closed_pairs().agg(F.round(F.avg(_share("n", "t")), 6).alias("clustering"))


def recast(visits: DataFrame, minutes: int = 5, p_rnd: float = 0.001, replicates: int = 5, seed: int = 42) -> DataFrame:
    """Contacts as friend, bridge, acquaintance or random: persistence and overlap above what random graphs reach.

    The thresholds are the values at rank ceil(n (1 - p_rnd)) of the pooled random graphs; 1 where these are empty.
    """
    return _classified(visits, daily_contacts(visits, minutes), minutes, p_rnd, replicates, seed)[0]


def _highest(values: DataFrame, column: str, p: float) -> DataFrame:
    """The value at rank ceil(n p); 1 without any. Values are counted before they are put in order, so a row a different value is."""
    line = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = values.groupBy(column).agg(F.count("*").alias("n"))
    ranked = n.withColumn("up_to", F.sum("n").over(line)).crossJoin(F.broadcast(n.agg(F.sum("n").alias("all"))))
    return ranked.where(F.col("up_to") >= F.ceil(F.col("all") * p)).agg(F.coalesce(F.min(column), F.lit(1.0)).alias(f"null_{column}"))


def _classified(visits: DataFrame, contacts: DataFrame, minutes: int, p_rnd: float, replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The classes, and persistence and overlap in the random graphs."""
    null = _measured(Graphs.of_edges(random_daily_graphs(contacts, replicates, seed), "count", ["replica"], visits), named=False)
    bound = _highest(null, "persistence", 1 - p_rnd).crossJoin(_highest(null, "overlap", 1 - p_rnd))
    got = _measured(Graphs.of_stays(visits, minutes, "count"), spanned_days(visits, minutes)).crossJoin(F.broadcast(bound))
    lasting, close = F.col("persistence") > F.col("null_persistence"), F.col("overlap") > F.col("null_overlap")
    return got.select("u", "v", "persistence", "overlap", F.when(lasting & close, "friend").when(lasting, "bridge").when(close, "acquaintance").otherwise("random").alias("class")), null


def clustering_by_day(contacts: DataFrame) -> DataFrame:
    """day, nodes, clustering: mean clustering of the graph of all contacts(day, u, v) up to each day, over its nodes."""
    return _by_day(Graphs.of_edges(contacts, "first"), contacts.select("day").distinct())


def _by_day(graph: Graphs, days: DataFrame) -> DataFrame:
    found = graph.closed_pairs(by_day=True).persist()
    # A row a node and day; only sums reach it.
    line = Window.partitionBy("uid").orderBy("day")
    grid = found.select("uid").distinct().crossJoin(F.broadcast(days)).join(found, ["uid", "day"], "left")
    sums = grid.select("uid", "day", F.sum(F.coalesce("n", F.lit(0))).over(line).alias("n"), F.sum(F.coalesce("t", F.lit(0))).over(line).alias("t")).where("n > 0")
    return sums.groupBy("day").agg(F.count("*").alias("nodes"), F.round(F.avg(_share("n", "t")), 6).alias("clustering"))


def mean_clustering(edges: DataFrame) -> DataFrame:
    """clustering: mean over the nodes of edges(u, v) of the share of their pairs of neighbours that are neighbours; null without edges."""
    whole = clustering_by_day(edges.select(F.lit(0).alias("day"), "u", "v"))
    return whole.agg(F.max("clustering").alias("clustering"))


def validate_recast(visits: DataFrame, minutes: int = 5, p_rnd: float = 0.001, replicates: int = 5, seed: int = 42) -> dict[str, DataFrame]:
    """The classes of recast(), and what its method is judged by: classification; distribution (measure, graph, value, contacts)
    of persistence and overlap in the observed and the random graphs; clustering (contacts, day, nodes, clustering) of all
    contacts up to each day, and of those classified as random."""
    contacts = daily_contacts(visits, minutes)
    classes, null = _classified(visits, contacts, minutes, p_rnd, replicates, seed)
    classes = classes.persist()
    parts = [df.select(F.lit(m).alias("measure"), F.lit(g).alias("graph"), F.round(F.col(m), 6).alias("value")) for m in ("persistence", "overlap") for g, df in (("observed", classes), ("null", null))]
    table = parts[0]
    for more in parts[1:]:
        table = table.unionByName(more)
    chance = contacts.join(classes.where("class = 'random'").select("u", "v"), ["u", "v"])
    clustering = _by_day(Graphs.of_stays(visits, minutes, "first"), contact_days(visits, minutes)).withColumn("contacts", F.lit("all")).unionByName(_by_day(Graphs.of_edges(chance, "first", ends=visits), chance.select("day").distinct()).withColumn("contacts", F.lit("random")))
    return {"classification": classes, "distribution": table.groupBy("measure", "graph", "value").agg(F.count("*").alias("contacts")), "clustering": clustering}
