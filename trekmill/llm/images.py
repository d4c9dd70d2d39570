"""Copies of images, cropped or edited, by local descriptors and geometric consensus.

Corners (Harris responses, local maxima at two scales) get an orientation from the
intensity centroid about them and a string of 128 brightness comparisons turned by it.
Two images are copies when enough mutually nearest strings obey one shift, turn and scale.

Candidates come from Hamming tables: each table takes PROBE of the 128 bits, and images
with a corner of equal bits share a bucket. A pair of strings that differ in f bits
shares a bucket of one table with a chance of about (1 - f / 128) ** PROBE, so m matching
corners all miss each other with (1 - that) ** (TABLES * m): 2e-19 for 8 corners of 4
differing bits, 2e-6 for 8, 0.015 for 12, 0.26 for 16. These are misses of one pair; a class
of several copies is lost only where all its ways are.

In a bucket every image is held against the least one; the links give components. Where a
bucket then still holds several components, all pairs across them are tested as well, in
blocks where it is large, so no candidate is dropped and no pair within a component is
listed. A bucket of many images that are no copies of one another costs the square of its
size; BLOCK bounds what a task holds. CORNERS is the method's own limit.

Defined cases: images that are null, empty or not width * height bytes have no corners
and are linked with nothing; flat images likewise, but equal ones are one node; repeated
rows share a component; rows with a null key take the least key of their class; input
columns other than the four named do not matter; ties between corners go to the upper,
then the left one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, lean, whole_groups, written
from .graph import components

CORNERS, BITS, PATCH, NEAR_BITS, INLIERS, MARGIN = 24, 128, 9, 32, 5, 3.0
#: Hamming tables, and bits that each looks at.
TABLES, PROBE = 12, 32
#: Members of a bucket that are held against each other in one block, and pairs handled at once.
BLOCK, STRIP = 512, 1024
_TESTS = np.random.default_rng(42).uniform(-PATCH, PATCH, (BITS, 4))
_PROBES = np.stack([np.random.default_rng(100 + t).permutation(BITS)[:PROBE] for t in range(TABLES)])


def _column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _box(x: np.ndarray) -> np.ndarray:
    """Mean over 3 x 3 neighbours."""
    p = np.pad(x, 1, mode="edge")
    return sum(p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3)) / 9


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y in the full image) and packed strings of an image's corners."""
    places, codes = [], []
    image = pixels.astype(np.float64)
    for scale, most in ((1, CORNERS * 2 // 3), (2, CORNERS - CORNERS * 2 // 3)):
        h, w = image.shape
        if min(h, w) < 2 * PATCH + 3:
            break
        smooth = _box(_box(image))
        gy, gx = np.gradient(smooth)
        a, b, c = _box(gx * gx), _box(gy * gy), _box(gx * gy)
        response = a * b - c * c - 0.05 * (a + b) ** 2
        inner = response[PATCH:-PATCH, PATCH:-PATCH]
        p = np.pad(inner, 1, constant_values=-np.inf)
        top = np.max([p[i : i + inner.shape[0], j : j + inner.shape[1]] for i in range(3) for j in range(3)], axis=0)
        y, x = np.nonzero((inner == top) & (inner > 1e-6))
        best = np.lexsort((x, y, -inner[y, x]))[:most]
        y, x = y[best] + PATCH, x[best] + PATCH
        if len(y):
            d = np.arange(-PATCH, PATCH + 1)
            part = smooth[y[:, None, None] + d[:, None], x[:, None, None] + d]
            disc = (d[:, None] ** 2 + d**2 <= PATCH**2).astype(float)
            turn = np.arctan2((part * disc * d[:, None]).sum((1, 2)), (part * disc * d).sum((1, 2)))
            cos, sin = np.cos(turn)[:, None], np.sin(turn)[:, None]

            def at(u, v, y=y, x=x, cos=cos, sin=sin, smooth=smooth, h=h, w=w):
                yy, xx = np.rint(y[:, None] + u * sin + v * cos).astype(int), np.rint(x[:, None] + u * cos - v * sin).astype(int)
                return smooth[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)]

            codes.append(np.packbits(at(_TESTS[:, 0], _TESTS[:, 1]) < at(_TESTS[:, 2], _TESTS[:, 3]), axis=1))
            places.append(np.column_stack([x, y]) * scale + (scale - 1) / 2)
        image = image[: h // 2 * 2, : w // 2 * 2].reshape(h // 2, 2, w // 2, 2).mean((1, 3))
    if not codes:
        return np.zeros((0, 2), np.float32), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(places).astype(np.float32), np.concatenate(codes)


def consensus(p: np.ndarray, s: np.ndarray, q: np.ndarray, t: np.ndarray) -> int:
    """Most mutually nearest strings of two images that obey one shift, turn and scale."""
    if not len(s) or not len(t):
        return 0
    far = np.unpackbits(s[:, None] ^ t[None], axis=2).sum(2)
    i = np.arange(len(s))
    j = far.argmin(1)
    ok = (far.argmin(0)[j] == i) & (far[i, j] <= NEAR_BITS)
    a, b = p[i[ok]].astype(float) @ [1, 1j], q[j[ok]].astype(float) @ [1, 1j]
    if len(a) < INLIERS:
        return len(a) if len(a) < 2 else 0
    m, n = np.triu_indices(len(a), 1)
    span = a[n] - a[m]
    use = np.abs(span) > 4
    m, z = m[use], (b[n] - b[m])[use] / span[use]
    use = (np.abs(z) > 0.3) & (np.abs(z) < 3.3)
    m, z = m[use], z[use]
    if not len(m):
        return 0
    miss = np.abs(z[:, None] * (a[None] - a[m][:, None]) + b[m][:, None] - b[None])
    return int((miss <= MARGIN).sum(1).max())


def buckets(codes: np.ndarray) -> np.ndarray:
    """Numbers of the buckets that an image with these strings lies in, each once."""
    bits = np.unpackbits(codes.reshape(-1, BITS // 8), axis=1)
    place = 1 << 8 * np.arange(-(-PROBE // 8), dtype=np.int64)
    found = [(np.packbits(bits[:, p], axis=1) * place).sum(1) | t << 48 for t, p in enumerate(_PROBES)]
    return np.unique(np.concatenate(found))


def stacked(codes: list[bytes], places: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings (images, CORNERS, 2 numbers), places (images, CORNERS, 2) and what is missing (images, CORNERS)."""
    n = len(codes)
    word, place = np.zeros((n, CORNERS, 2), np.uint64), np.zeros((n, CORNERS, 2), np.float32)
    gone = np.ones((n, CORNERS), bool)
    for i, (c, p) in enumerate(zip(codes, places, strict=True)):
        k = len(c) // (BITS // 8)
        word[i, :k], place[i, :k], gone[i, :k] = np.frombuffer(c, np.uint64).reshape(-1, 2), np.frombuffer(p, np.float32).reshape(-1, 2), False
    return word, place, gone


def agree(one: tuple, other: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether images i of one and j of other (as stacked() gives them) are copies."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), STRIP):
        x, y = i[a : a + STRIP], j[a : a + STRIP]
        far = np.bitwise_count(one[0][x][:, :, None] ^ other[0][y][:, None]).sum(3, dtype=np.uint16)
        far[one[2][x][:, :, None] | other[2][y][:, None]] = 999
        to, back = far.argmin(2), far.argmin(1)
        mutual = np.take_along_axis(back, to, 1) == np.arange(CORNERS)
        enough = (mutual & (far.min(2) <= NEAR_BITS)).sum(1) >= INLIERS
        for k in np.flatnonzero(enough):
            s, t = ((w[0][v], w[1][v], ~w[2][v]) for w, v in ((one, x[k]), (other, y[k])))
            out[a + k] = consensus(s[1][s[2]], s[0][s[2]].view(np.uint8), t[1][t[2]], t[0][t[2]].view(np.uint8)) >= INLIERS
    return out


def copies(images: DataFrame, key: str = "image_id", pixels: str = "pixels", width: str = "width", height: str = "height") -> DataFrame:
    """key, component_id (least key reachable through copies) and n_corners, one row an image."""
    spark = images.sparkSession
    arrow_batches(spark)
    rows = images.select(F.col(key).alias("key"), F.col(pixels).alias("pixels"), F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h"))
    rows = rows.withColumn("node", F.when(F.length("pixels") > 0, F.xxhash64("pixels", "w", "h")))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            places, codes, n = [], [], []
            for raw, w, h in zip(*(_column(batch, c).to_pylist() for c in ("pixels", "w", "h")), strict=True):
                good = raw is not None and w is not None and h is not None and len(raw) == w * h > 0
                p, c = describe(np.frombuffer(raw, np.uint8).reshape(h, w)) if good else describe(np.zeros((0, 0)))
                places.append(p.tobytes())
                codes.append(c.tobytes())
                n.append(len(c))
            yield pa.RecordBatch.from_arrays([_column(batch, "key"), _column(batch, "node"), pa.array(n, pa.int32()), pa.array(places, pa.binary()), pa.array(codes, pa.binary())], names=["key", "node", "n_corners", "places", "codes"])

    base = written(rows.mapInArrow(lean(run), f"key {kind}, node bigint, n_corners int, places binary, codes binary"), "corners")
    nodes = written(base.where("node is not null and n_corners > 0").groupBy("node").agg(F.any_value("places").alias("places"), F.any_value("codes").alias("codes")), "images", base.count(), 2000)
    n = nodes.count()

    def deal(batches):
        for batch in batches:
            found = [buckets(np.frombuffer(c, np.uint8)) for c in _column(batch, "codes").to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), _column(batch, "node").take(pa.array(np.repeat(np.arange(len(found)), list(map(len, found)))))], names=["bucket", "node"])

    dealt = written(nodes.select("node", "codes").mapInArrow(lean(deal), "bucket bigint, node bigint"), "dealt")
    shared = written(dealt.groupBy("bucket").agg(F.min("node").alias("center"), F.max("node").alias("other"), F.count("*").alias("n")).where("n > 1"), "shared", n * TABLES * CORNERS, 500_000)
    # A bucket of two is its pair; only larger ones are listed.
    members = written(dealt.join(shared.where("n > 2").select("bucket", "center", "n"), "bucket"), "buckets", n * TABLES * CORNERS, 500_000)
    stars = members.where("node != center").select(F.col("node").alias("a"), F.col("center").alias("b")).unionByName(shared.where("n = 2").select(F.col("other").alias("a"), F.col("center").alias("b")))
    stars = written(stars.distinct(), "stars", n * TABLES, 50_000)

    def linked(batches):
        for batch in batches:
            one, other = (stacked(*(_column(batch, f"{c}_{s}").to_pylist() for c in ("codes", "places"))) for s in ("a", "b"))
            every = np.arange(batch.num_rows)
            keep = pa.array(np.flatnonzero(agree(one, other, every, every)))
            yield pa.RecordBatch.from_arrays([_column(batch, "a").take(keep), _column(batch, "b").take(keep)], names=["a", "b"])

    for s in ("a", "b"):
        stars = stars.join(nodes.select(F.col("node").alias(s), F.col("codes").alias(f"codes_{s}"), F.col("places").alias(f"places_{s}")), s)
    links = written(stars.mapInArrow(lean(linked), "a bigint, b bigint"), "links")
    root = components(links)
    # Buckets that still hold several components: what stands across them is tested as well.
    marked = members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).select("bucket", "n", "node", "root")
    torn = written(marked.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket"), "torn", n * TABLES, 50_000)
    held = marked.join(torn, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    held = held.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = written(held.select("bucket", "node", "root", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")), "held", n * TABLES, 50_000)

    def across(batches):
        """Links between components, a pair only while nothing links its ends here."""
        for t, edges in whole_groups(batches, ("bucket", "p", "q")):
            node, first, own, p, q = (t.column(c).to_numpy() for c in ("node", "root", "own", "p", "q"))
            all_ = stacked(*(t.column(c).to_pylist() for c in ("codes", "places")))
            up = {x: x for x in first.tolist()}

            def top(x, up=up):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for i in range(a, b):
                    ok = first[i + 1 : b] != first[i]
                    if p[a] != q[a]:
                        ok &= own[i + 1 : b] != own[i]
                    at = np.flatnonzero(ok) + i + 1
                    mine = top(first[i])
                    at = at[[top(x) != mine for x in first[at].tolist()]] if len(at) else at
                    # The greater node comes first, as in the stars.
                    for x, y in ((np.full(len(at), i), at), (at, np.full(len(at), i))):
                        use = node[x] > node[y]
                        for j, k in zip(x[use][good := agree(all_, all_, x[use], y[use])], y[use][good], strict=True):
                            u, v = top(first[j]), top(first[k])
                            if u != v:
                                up[max(u, v)] = min(u, v)
                                out.append((node[j], node[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    met = held.join(nodes, "node").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    more = written(met.mapInArrow(lean(across), "a bigint, b bigint"), "more-links")
    if not more.isEmpty():
        root = components(links.unionByName(more))
    least = base.where("node is not null").groupBy("node").agg(F.min("key").alias("least")).join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = written(least.groupBy("root").agg(F.min("least").alias("component_id")), "smallest", n)
    named = written(least.join(smallest, "root").select("node", "component_id"), "named", n)
    got = base.select("key", "node", "n_corners").join(named, "node", "left")
    return got.select("key", F.coalesce("component_id", "key").alias("component_id"), "n_corners")


def rendered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", side: int = 16, block: int = 3, seed: int = 5) -> DataFrame:
    """A picture of side x side blocks for each vector, near vectors giving near pictures: the media column of tables without one.

    The brightness of each block is a fixed random projection of the vector. Vectors that
    are null, empty or hold null or non-finite numbers give a null picture.
    """

    def run(batches):
        mixes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for v in _column(batch, "v").to_pylist():
                if not v or None in v or not np.isfinite(v).all():
                    out.append(None)
                    continue
                if len(v) not in mixes:
                    mixes[len(v)] = np.random.default_rng(seed).standard_normal((side * side, len(v)))
                light = np.clip(128 + 45 * (mixes[len(v)] @ np.asarray(v, np.float64)), 0, 255).astype(np.uint8)
                out.append(light.reshape(side, side).repeat(block, 0).repeat(block, 1).tobytes())
            size = pa.array([side * block] * len(out), pa.int32())
            yield pa.RecordBatch.from_arrays([_column(batch, "image_id"), pa.array(out, pa.binary()), size, size], names=["image_id", "pixels", "width", "height"])

    arrow_batches(vectors.sparkSession)
    return vectors.select(F.col(key).alias("image_id"), F.col(vector).alias("v")).mapInArrow(lean(run), f"image_id {vectors.schema[key].dataType.simpleString()}, pixels binary, width int, height int")
