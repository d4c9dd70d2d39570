"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set of word shingles is thrown into t bins, in rounds of hashed placement:
in each of the first t rounds every shingle falls into a random bin, in each of the
next t all fall into one fixed bin, until no bin is empty; a bin keeps its least value,
earlier rounds first. All coordinates are filled after 2t rounds at the latest, and the
share of equal coordinates of two sketches is concentrated about their sets' similarity.

Documents of equal sets are one node. Nodes that agree on a band of coordinates are
candidates. First every node of a band's bucket is held against the least one there,
on the full sets; the links give components. Then, in buckets that still hold several
components, all pairs across components whose sketches do not rule them out are held
against each other as well. The members of a bucket travel in lists, and only lists that
hold different components meet. So pairs within a component are never listed, and no link
between components goes unseen but with the probability that banding or the sketch filter
misses it (below 1e-6 a pair at the threshold, far less above).

Defined cases: null, empty or wordless texts have no shingles and are linked with
nothing; fewer words than a shingle are one shingle; repeated rows share a component;
rows with a null key take the least key of their component (null if none has one); an
empty table gives an empty result; other input columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_batches, discard, lean, written
from .graph import components

BINS = 160
#: Members of a bucket whose list travels as one, and about the bytes of their full sets that do.
BLOCK, BLOCK_BYTES = 512, 2 << 20
MISS = 1e-8


def bands_for(threshold: float, bins: int = BINS) -> int:
    """Coordinates a band: the most that miss a pair at the threshold with at most MISS."""
    return max((r for r in range(1, 20) if bins % r == 0 and (1 - threshold**r) ** (bins // r) <= MISS), default=1)


def least_agreement(threshold: float, bins: int = BINS) -> int:
    """Equal coordinates below which a pair at the threshold lies with a chance under 1e-7."""
    return int(max(0.0, threshold - 5.3 * sqrt(threshold * (1 - threshold) / bins)) * bins)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins (n + 1 bounds)."""
    n = len(offsets) - 1
    h, doc, _ = K.words(raw, offsets, K.SPACED)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    s = h.copy()
    for j in range(1, k):
        s[: len(h) - j] = K.mix(s[: len(h) - j] * K.U64(31) + h[j:]) if len(h) > j else s[: len(h) - j]
    short = np.flatnonzero((count > 0) & (count < k))
    size = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    for d in short:
        v = np.full(1, count[d], np.uint64)
        for w in h[first[d] : first[d] + count[d]]:
            v = K.mix(v * K.U64(37) + w)
        s[first[d]] = v[0]
    parts, bounds = [], np.zeros(n + 1, np.int64)
    for d in range(n):
        x = np.unique(s[first[d] : first[d] + size[d]]) if size[d] else s[:0]
        parts.append(x)
        bounds[d + 1] = bounds[d] + len(x)
    return (np.concatenate(parts) if parts else s[:0]), bounds


def sketches(elements: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """texts x bins, 16 bits of each coordinate; rows of empty sets are 0."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    best = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    live = np.flatnonzero(size > 0)
    doc = np.repeat(np.arange(n), size)
    e, d = elements, doc
    for i in range(2 * bins):
        if not len(live):
            break
        x = K.mix(e + K.U64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        value = (x & K.U64(0xFFFFFFFF)) | K.U64(i << 32)
        if i < bins:
            np.minimum.at(best, d * bins + ((x >> K.U64(32)) * K.U64(bins) >> K.U64(32)).astype(np.int64), value)
        else:
            starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            at = d[starts] * bins + (i - bins)
            best[at] = np.minimum(best[at], np.minimum.reduceat(value, starts))
        full = (best.reshape(n, bins)[live] != np.iinfo(np.uint64).max).all(1)
        if full.any():
            live = live[~full]
            keep = np.isin(d, live)
            e, d = e[keep], d[keep]
    out = (K.mix(best) & K.U64(0xFFFF)).astype(np.uint16).reshape(n, bins)
    out[size == 0] = 0
    return out


def set_ids(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each whole set."""
    h = np.append(K.U64(0), np.cumsum(K.mix(elements * K.U64(0xD6E8FEB86659FD93) + K.U64(1))))
    return K.mix((h[bounds[1:]] - h[bounds[:-1]]) * K.U64(3) + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(col, dtype=np.uint16) -> np.ndarray:
    raw, off = K.string_bytes(col)
    return np.frombuffer(raw.tobytes(), dtype).reshape(len(off) - 1, -1)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """rid (a hash of the key, or of the text where it is null), key, n_shingles, node (set fingerprint), sketch of every row."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: object) -> object:
        for whole in batches:
            for batch in K.blocks(whole, "text"):
                e, bounds = shingle_sets(*K.string_bytes(_column(batch, "text")), k)
                yield pa.RecordBatch.from_arrays([_column(batch, "rid"), _column(batch, "key"), pa.array(np.diff(bounds)), pa.array(set_ids(e, bounds)), _binary(sketches(e, bounds))], names=["rid", "key", "n_shingles", "node", "sketch"])

    return docs.mapInArrow(lean(run), f"rid bigint, key {kind}, n_shingles bigint, node bigint, sketch binary")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, elements (8 bytes each) of the wanted nodes (rid, node), made again from the texts."""

    def run(batches):
        for whole in batches:
            for batch in K.blocks(whole, "text"):
                e, bounds = shingle_sets(*K.string_bytes(_column(batch, "text")), k)
                same = np.flatnonzero(set_ids(e, bounds) == _column(batch, "node").to_numpy())
                values = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds * 8)), pa.py_buffer(np.ascontiguousarray(e))])
                yield pa.RecordBatch.from_arrays([_column(batch, "node").take(pa.array(same)), values.take(pa.array(same)).cast(pa.binary())], names=["node", "elements"])

    rows = docs.join(wanted, "rid").select("node", "text")
    return rows.mapInArrow(lean(run), "node bigint, elements binary").dropDuplicates(["node"])


def _intersections(batches, similar: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    for batch in batches:
        (xr, xo), (yr, yo) = (K.string_bytes(_column(batch, c)) for c in ("x", "y"))
        x, y = np.frombuffer(xr.tobytes(), np.uint64), np.frombuffer(yr.tobytes(), np.uint64)
        xo, yo = xo // 8, yo // 8
        both = np.array([np.isin(x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]], assume_unique=True).sum() for i in range(batch.num_rows)], np.int64)
        union = np.diff(xo) + np.diff(yo) - both
        keep = pa.array(np.flatnonzero(similar(both, union)))
        yield pa.RecordBatch.from_arrays([_column(batch, "a").take(keep), _column(batch, "b").take(keep)], names=["a", "b"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, per_cent: int = 80) -> DataFrame:
    """key, n_shingles, node (equal for equal sets), component_id (least key reachable) and kept, one row a document."""
    spark = docs.sparkSession
    arrow_batches(spark)
    threshold = per_cent / 100
    r, floor = bands_for(threshold), least_agreement(threshold)
    n_bands = BINS // r
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("rid", F.xxhash64("key", F.when(F.col("key").isNull(), F.col("text")))).select("rid", "key", "text")
    base = written(describe(rows, k), "sets")
    nodes = written(base.where("n_shingles > 0").groupBy("node").agg(F.min("rid").alias("rid"), F.max("n_shingles").alias("size"), F.any_value("sketch").alias("sketch")), "nodes", base.count(), 5000)
    n = nodes.count()

    def split(batches):
        for batch in batches:
            s = _matrix(_column(batch, "sketch")).astype(np.uint64)
            node = _column(batch, "node").to_numpy()
            keys = np.zeros((len(s), n_bands), np.uint64)
            for j in range(r):
                keys = K.mix(keys * K.U64(131) + s[:, j : n_bands * r : r] + K.U64(1))
            keys = K.mix(keys + np.arange(n_bands, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(node, n_bands)), pa.array(np.tile(np.arange(n_bands, dtype=np.int32), len(s)))], names=["key", "node", "band"])

    bands = nodes.select("node", "sketch").mapInArrow(lean(split), "key bigint, node bigint, band int")
    shared = bands.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1")
    members = written(bands.join(shared, "key"), "buckets", n * n_bands, 100_000)

    def agree(batches):
        for batch in batches:
            same = (_matrix(_column(batch, "x")) == _matrix(_column(batch, "y"))).sum(1)
            keep = pa.array(np.flatnonzero(same >= floor))
            yield pa.RecordBatch.from_arrays([_column(batch, "a").take(keep), _column(batch, "b").take(keep)], names=["a", "b"])

    short = nodes.select("node", "sketch")
    stars = members.where("node != center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    stars = stars.join(short.withColumnsRenamed({"node": "a", "sketch": "x"}), "a").join(short.withColumnsRenamed({"node": "b", "sketch": "y"}), "b").mapInArrow(lean(agree), "a bigint, b bigint")
    first = written(stars, "stars", n * n_bands, 200_000)

    def similar(both, union):
        return 100 * both >= per_cent * union

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        sets = written(full_sets(rows, used.join(nodes.select("node", "rid"), "node"), k), f"{tag}-sets", n, 5000)
        with_sets = pairs.join(sets.withColumnsRenamed({"node": "a", "elements": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "elements": "y"}), "b")
        return written(with_sets.mapInArrow(lean(lambda batches: _intersections(batches, similar)), "a bigint, b bigint"), tag, n * n_bands, 200_000)

    links = verified(first, "links")
    label = components(links)
    # Buckets that hold several components: what stands across them is still to be looked at.
    # A bucket of two holds no pair but the one that was held against its least node.
    marked = members.where("n > 2").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    torn = marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    sized = nodes.select("node", "size", "sketch")
    held = written(marked.join(torn, "key").select("key", "band", "node", "root").join(sized, "node"), "held", n * n_bands, 50_000)

    def named(batches):
        """Of each bucket the members of pairs across components that the sketches do not rule out."""
        for batch in batches:
            for key, t, cut in _meetings(batch):
                found = [np.append(at, i) for i, at in _across(t, cut, floor, n_bands, r)]
                if found:
                    t = t.take(pa.array(np.unique(np.concatenate(found))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), key)), *(t.field(c) for c in ("band", "node", "root", "size"))], names=["key", "band", "node", "root", "size"])

    met = meetings(held, F.lit(1), ["size", "sketch"], n * n_bands)
    involved = written(met.mapInArrow(lean(named), "key bigint, band int, node bigint, root bigint, size bigint").distinct(), "involved", n * n_bands, 100_000)
    discard(held)
    if not involved.isEmpty():
        sets = full_sets(rows, involved.select("node").distinct().join(nodes.select("node", "rid"), "node"), k)
        sets = written(short.join(sets, "node"), "across-sets", n, 5000)

        def joined(batches):
            """Links between components on the full sets, a pair only while nothing links its ends here."""
            for batch in batches:
                for _, t, cut in _meetings(batch):
                    node, root = (t.field(c).to_numpy() for c in ("node", "root"))
                    raw, off = K.string_bytes(t.field("elements"))
                    sets_, off = np.frombuffer(raw.tobytes(), np.uint64), off // 8
                    up = {x: x for x in root.tolist()}

                    def top(x, up=up):
                        while up[x] != x:
                            up[x] = x = up[up[x]]
                        return x

                    out = []
                    for i, at in _across(t, cut, floor, n_bands, r):
                        mine = sets_[off[i] : off[i + 1]]
                        for j in at.tolist():
                            x, y = top(root[i]), top(root[j])
                            if x == y:
                                continue
                            both = np.isin(sets_[off[j] : off[j + 1]], mine, assume_unique=True).sum()
                            if similar(both, len(mine) + off[j + 1] - off[j] - both):
                                up[max(x, y)] = min(x, y)
                                out.append((max(node[i], node[j]), min(node[i], node[j])))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

        met = meetings(involved, 1 + F.col("size") * BLOCK * 8 / BLOCK_BYTES, ["sketch", "elements"], n * n_bands, sets)
        more = written(met.mapInArrow(lean(joined), "a bigint, b bigint"), "more-links", n * n_bands, 200_000)
        if not more.isEmpty():
            label = components(links.unionByName(more))
    least = base.where("n_shingles > 0").groupBy("node").agg(F.min("key").alias("least"))
    least = least.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    found = least.join(smallest, "root").select("node", "component_id")
    some = base.where("n_shingles > 0").select("key", "n_shingles", "node").join(found, "node")
    none = base.where("n_shingles = 0").select("key", "n_shingles", "node").withColumn("component_id", F.col("key"))
    return some.unionByName(none).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id"))).select("key", "n_shingles", "node", "component_id", "kept")


def meetings(members: DataFrame, weight: Column, columns: list[str], most: int, others: DataFrame | None = None) -> DataFrame:
    """key, x, y: lists of members of a bucket (key), so that any two of different components stand in one row.

    members: a written table of key, band, node, root (the component) and columns, those of others
    joined by node; most: a bound of its rows. A list weighs about BLOCK. Components that weigh more
    have lists of their own, and these meet other components' lists only; a list of small
    components also meets itself (y is null). So each member goes into one list, and lists, not
    members, are repeated.
    """
    roots = members.groupBy("key", "root").agg(F.sum(weight).alias("m")).withColumn("large", F.col("m") > BLOCK).withColumn("part", F.when(F.col("large"), F.col("root")).otherwise(0))
    at = ["key", "large", "part"]
    plan = roots.join(roots.groupBy(*at).agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("lists")), at).select("root", *at, "lists")
    held = members.join(written(plan, "plan", most, 100_000), ["key", "root"])
    held = (held if others is None else held.join(others, "node")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("lists")).cast("int"))
    at = [*at, "own"]
    lists = written(held.groupBy(*at).agg(F.collect_list(F.struct("band", "node", "root", *columns)).alias("x")), "lists", most, 20_000)
    alone = lists.where("not large").select("key", "x", F.expr("if(false, x, null)").alias("y"))
    several = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    if several.isEmpty():
        return alone
    names = written(lists.join(several, "key").select(*at), "list-names", most, 100_000)
    other = {c: f"{c}_" for c in at[1:]}
    pairs = names.join(names.withColumnsRenamed(other), "key").where("struct(large, part, own) < struct(large_, part_, own_) and not (large and large_ and part = part_)")
    pairs = pairs.join(lists, at).join(lists.withColumnsRenamed(other | {"x": "y"}), ["key", *other.values()])
    return alone.unionByName(pairs.select("key", "x", "y"))


def _meetings(batch: pa.RecordBatch):
    """Of each row of meetings() the bucket, the members of both lists, and where the second begins (0: there is one list)."""
    x, y = (_column(batch, c) for c in ("x", "y"))
    for i, key in enumerate(_column(batch, "key").to_pylist()):
        if y[i].is_valid:
            yield key, pa.concat_arrays([x[i].values, y[i].values]), len(x[i].values)
        else:
            yield key, x[i].values, 0


def _across(t: pa.StructArray, cut: int, floor: int, n_bands: int, r: int):
    """(member, others, likeliest first) of pairs of different components that agree in floor coordinates, and in no earlier band.

    cut: pairs are of members before it and from it on; 0: of any two.
    """
    root, band = (t.field(c).to_numpy() for c in ("root", "band"))
    sketch = _matrix(t.field("sketch"))
    for i in range(cut or len(t) - 1):
        begin = cut or i + 1
        at = np.flatnonzero(root[begin:] != root[i]) + begin
        if not len(at):
            continue
        same = sketch[at] == sketch[i]
        agree = same.sum(1)
        near = np.flatnonzero(agree >= floor)
        if len(near):
            near = near[np.argsort(-agree[near], kind="stable")]
            whole = same[near][:, : n_bands * r].reshape(len(near), n_bands, r).all(2)
            at = at[near[whole.argmax(1) == band[i]]]
            if len(at):
                yield i, at
