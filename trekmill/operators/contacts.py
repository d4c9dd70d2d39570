"""Contacts and their graphs by blocks of people, for days when a large part of all pairs meet.

People are dealt to blocks by a hash. A pair of blocks gets the stays of both, so all of a pair's
contacts are found in one task, where marks in a matrix of the two blocks take the place of a
DISTINCT: what is shuffled is stays times blocks, and no pair ever is. Graphs are kept as such
matrices, as bits or as lists, whichever is smaller; neighbours common to the ends of an edge are
products of them. A task holds a few matrices of two blocks, and the rows of two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import dialect

#: People of a block, and the least blocks that more than MANY people are dealt to.
BLOCK, LEAST, MANY = 4096, 8, 1000
_STEP = 1 << 22  # pairs expanded at once

_PARTS = dialect(
    """SELECT uid, location_id, d, greatest(LONG(EPOCH_US(started_at)), d * 86400000000) AS s, least(LONG(EPOCH_US(finished_at)), (d + 1) * 86400000000) AS e FROM
      (SELECT *, LONG(floor(EPOCH_US(started_at) / 86400000000e0)) AS d0, LONG(floor(EPOCH_US(finished_at) / 86400000000e0)) AS d1 FROM {visits} WHERE uid IS NOT NULL AND location_id IS NOT NULL AND finished_at >= started_at) v SERIES(d, d0, d1)""",
    0,
)


def _parts(visits: DataFrame, minutes: float) -> DataFrame:
    """The days of stays (uid, location_id, d, s, e) that are long enough for a contact."""
    return visits.sparkSession.sql(_PARTS, visits=visits).where(F.col("e") - F.col("s") >= minutes * 60_000_000)


def _blocks(people: DataFrame) -> int:
    n = people.select("uid").distinct().count()
    return max(-(-n // BLOCK), LEAST if n > MANY else 1)


def _block(uid, blocks: int):
    return F.pmod(F.xxhash64(uid), F.lit(blocks)).cast("int")


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """rows(b) once for each pair of blocks (x <= y) that b is of."""
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("x", F.least("b", "other").cast("int")).withColumn("y", F.greatest("b", "other").cast("int")).drop("other")


def _ranked(*columns) -> tuple[list[np.ndarray], pa.Array]:
    """Places of the columns' values among all of them in order, and these."""
    flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    names = pc.unique(pa.concat_arrays(flat))
    names = names.take(pc.sort_indices(names))
    return [pc.index_in(c, names).to_numpy(zero_copy_only=False).astype(np.int64) for c in flat], names


def _mark(seen: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, other: np.ndarray, turned: bool) -> None:
    """Marks the pairs of at[k] with all of other[lo[k]:hi[k]]."""
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    first = 0
    while first < len(n):
        base = ends[first] - n[first]
        last = max(int(np.searchsorted(ends, base + _STEP, side="right")), first + 1)
        k = n[first:last]
        of = np.repeat(at[first:last], k)
        with_ = other[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[first:last], k)]
        if turned:
            seen[with_, of] = True
        else:
            seen[of, with_] = True
        first = last


def _marks(minutes: float, x: int, y: int, columns: dict[str, np.ndarray], mine: list) -> Iterator[tuple[int, np.ndarray]]:
    """Each day of stays with the matrix of the pairs of mine[0] (of block x) and mine[1] (of block y) that have a contact; the matrix is used again."""
    need = round(minutes * 60_000_000)
    order = np.lexsort((columns["s"], columns["place"], columns["d"]))
    day, place, s, e, who, block = (columns[c][order] for c in ("d", "place", "s", "e", "who", "b"))
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(day) != 0]), len(day)]
    seen = np.zeros((len(mine[0]), len(mine[1])), bool)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if len(day) else ():
        # Stays of a day in the order of place and start: those that begin during another, long enough before its end, are a run.
        start = place[lo:hi] * (1 << 38) + s[lo:hi] - day[lo] * 86_400_000_000
        until = start + (e[lo:hi] - s[lo:hi]) - need
        sides = []
        for b, people in zip((x, y), mine, strict=True):
            on = block[lo:hi] == b
            sides.append((start[on], until[on], np.searchsorted(people, who[lo:hi][on])))
        (a, a_end, i), (c, c_end, j) = sides
        seen[:] = False
        _mark(seen, i, np.searchsorted(c, a, "left"), np.searchsorted(c, a_end, "right"), j, False)
        if x != y:
            _mark(seen, j, np.searchsorted(a, c, "right"), np.searchsorted(a, c_end, "right"), i, True)
        else:
            seen[:] = np.triu(seen | seen.T, 1)
        yield int(day[lo]), seen


def _columns(table: pa.Table, who: np.ndarray) -> dict[str, np.ndarray]:
    place = pc.dictionary_encode(table["location_id"].combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return {"who": who, "place": place} | {c: table[c].to_numpy() for c in ("b", "d", "s", "e")}


def _meet(minutes: float, count: bool):
    """The kernel of a pair of blocks: contacts (day, u, v), or the number of days of each pair (u, v, n)."""

    def found(x: int, y: int, table: pa.Table):
        """names, value, and places in names of the two ends."""
        (who,), names = _ranked(table["uid"])
        columns = _columns(table, who)
        mine = [np.unique(who[columns["b"] == b]) for b in (x, y)]
        total = np.zeros((len(mine[0]), len(mine[1])), np.uint16) if count else None
        for day, seen in _marks(minutes, x, y, columns, mine):
            if count:
                total += seen
            else:
                i, j = np.nonzero(seen)
                yield names, day, mine[0][i], mine[1][j]
        if count:
            i, j = np.nonzero(total)
            yield names, total[i, j], mine[0][i], mine[1][j]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, value, i, j in found(*(k.as_py() for k in key), pa.Table.from_batches(batches)):
            for at in range(0, len(i), _STEP):
                a, b = i[at : at + _STEP], j[at : at + _STEP]
                u, v = pc.take(names, pa.array(np.minimum(a, b))), pc.take(names, pa.array(np.maximum(a, b)))
                yield pa.RecordBatch.from_pydict({"u": u, "v": v, "n": pa.array(value[at : at + _STEP].astype(np.int64))} if count else {"day": pa.array(np.full(len(u), value, np.int64)), "u": u, "v": v})

    return run


def _met(visits: DataFrame, minutes: float, count: bool) -> DataFrame:
    parts, kind = _parts(visits, minutes), visits.schema["uid"].dataType.simpleString()
    blocks = _blocks(visits)
    rows = _dealt(parts.withColumn("b", _block("uid", blocks)), blocks).select("x", "y", "b", "uid", "location_id", "d", "s", "e")
    return rows.groupBy("x", "y").applyInArrow(_meet(minutes, count), f"u {kind}, v {kind}, n bigint" if count else f"day bigint, u {kind}, v {kind}")


def daily_contacts(visits: DataFrame, minutes: float = 5) -> DataFrame:
    """day, u, v: the rows of sequence.temporal_contacts. minutes is 0 or more."""
    return _met(visits, minutes, False)


def contact_days(visits: DataFrame, minutes: float = 5) -> DataFrame:
    """day: the days that have a contact.

    Where two stays of a place are a contact, two that follow one another in the order of starts are one as well, or
    the first of a person's run of stays with one of the run before it; so runs are compared with the next, and no pairs are listed.
    """
    line = Window.partitionBy("d", "location_id").orderBy("s", "uid")
    rows = _parts(visits, minutes).withColumn("run", F.when(F.lag("uid").over(line) == F.col("uid"), 0).otherwise(1)).withColumn("run", F.sum("run").over(line))
    runs = rows.groupBy("d", "location_id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    after = F.lead("s").over(Window.partitionBy("d", "location_id").orderBy("run"))
    return runs.withColumn("next", after).where(F.col("next") <= F.col("e") - minutes * 60_000_000).select(F.col("d").alias("day")).distinct()


def spanned_days(visits: DataFrame, minutes: float = 5) -> DataFrame:
    """days: from the first to the last day that has a contact, both in."""
    return contact_days(visits, minutes).agg((F.max("day") - F.min("day") + 1).alias("days"))


def contact_counts(visits: DataFrame, minutes: float = 5) -> DataFrame:
    """u, v, persistence: the rows of sequence.contact_network."""
    return _met(visits, minutes, True).crossJoin(F.broadcast(spanned_days(visits, minutes))).select("u", "v", F.round(F.col("n") / F.col("days"), 6).alias("persistence"))


def _people(ends: DataFrame) -> tuple[DataFrame, int]:
    """uid, b, i: each of ends(uid) with its block and its place there; and the number of blocks."""
    ends = ends.select("uid").where("uid is not null").distinct()
    blocks = _blocks(ends)
    return ends.withColumn("b", _block("uid", blocks)).withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy("uid")) - 1).persist(), blocks


def _packed(m: np.ndarray) -> tuple[str, bytes]:
    """A matrix of bool or int32 as all of it, or as a list of what is not 0."""
    flat, width = m.ravel(), 0 if m.dtype == bool else 4
    at = np.flatnonzero(flat)
    if len(at) * (4 + width) * 8 < len(flat) * (8 * width or 1):
        return "list" if width else "ones", at.astype(np.uint32).tobytes() + (flat[at].tobytes() if width else b"")
    if width and flat.max() < 256:
        return "bytes", flat.astype(np.uint8).tobytes()
    return ("all", flat.tobytes()) if width else ("bits", np.packbits(flat).tobytes())


def _unpacked(form: str, data: bytes, shape: tuple[int, int]) -> np.ndarray:
    n = shape[0] * shape[1]
    if form == "bits":
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n).view(bool).reshape(shape)
    if form == "bytes":
        return np.frombuffer(data, np.uint8).astype(np.int32).reshape(shape)
    if form == "all":
        return np.frombuffer(data, np.int32).reshape(shape)
    out = np.zeros(n, bool if form == "ones" else np.int32)
    split = len(data) if form == "ones" else len(data) // 2
    out[np.frombuffer(data[:split], np.uint32)] = True if form == "ones" else np.frombuffer(data[split:], np.int32)
    return out.reshape(shape)


#: own: a matrix that only its pair of blocks is to see. Values of days are kept above 0.
_MATRIX = "r int, c int, own boolean, rows int, columns int, form string, data binary, low bigint, high bigint"
_DAY_0 = 1_000_000


def _records(r: int, c: int, m: np.ndarray, kind: str) -> list[tuple]:
    """The records of a pair of blocks: its edges both ways round; with kind "count" their values apart, with "first" in place of them."""
    if r == c:
        big = np.where(m == 0, 2**31 - 1, m) if kind == "first" else m
        m = np.minimum(big, big.T) if kind == "first" else m + m.T
        m = np.where(m == 2**31 - 1, 0, m)
    out = [(r, c, True, *m.shape, *_packed(m.astype(np.int32)))] if kind == "count" else []
    for a, b, n in ((r, c, m), (c, r, m.T))[: 1 if r == c else 2]:
        out.append((a, b, False, *n.shape, *_packed(np.ascontiguousarray(n.astype(np.int32) if kind == "first" else n > 0))))
    return out


def _batch(records: list[tuple], of: tuple[pa.Scalar, ...], days: tuple[int | None, int | None] = (None, None)) -> Iterator[pa.RecordBatch]:
    types = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    for row in (r + days for r in records):
        named = {f"k{o}": pa.array([k.as_py()], k.type) for o, k in enumerate(of)}
        yield pa.RecordBatch.from_pydict(named | {x.split()[0]: pa.array([v], t) for x, v, t in zip(_MATRIX.split(", "), row, types, strict=True)})


class Graphs:
    """Contact graphs as matrices of pairs of blocks: records (by, r, c, ...), people (uid, b, i), and how many blocks."""

    def __init__(self, records: DataFrame, people: DataFrame, blocks: int, by: list[str]):
        self.records, self.people, self.blocks, self.by = records, people, blocks, by

    @staticmethod
    def of_stays(visits: DataFrame, minutes: float = 5, kind: str = "edges") -> Graphs:
        """The graph of all contacts: edges alone, with their days counted (kind "count"), or with their first day ("first"). No table of contacts is made."""
        people, blocks = _people(visits)
        sizes = people.groupBy("b").agg(F.count("*").cast("int").alias("size"))
        rows = _dealt(_parts(visits, minutes).join(people, "uid").join(F.broadcast(sizes), "b"), blocks).select("x", "y", "b", F.col("i").cast("long").alias("i"), "size", "location_id", "d", "s", "e")

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches)
            x, y = (k.as_py() for k in key)
            columns, size = _columns(table, table["i"].to_numpy()), table["size"].to_numpy()
            if not ((columns["b"] == x).any() and (columns["b"] == y).any()):
                return
            mine = [np.arange(size[columns["b"] == b][0]) for b in (x, y)]
            total = np.zeros((len(mine[0]), len(mine[1])), bool if kind == "edges" else np.int32)
            for day, seen in _marks(minutes, x, y, columns, mine):
                if kind == "edges":
                    total |= seen
                elif kind == "count":
                    total += seen
                else:
                    total[seen & (total == 0)] = day + _DAY_0
            if total.any():
                yield from _batch(_records(x, y, total, kind), ())

        return Graphs(rows.groupBy("x", "y").applyInArrow(run, _MATRIX), people, blocks, [])

    @staticmethod
    def of_edges(edges: DataFrame, kind: str = "edges", by: list[str] | None = None, ends: DataFrame | None = None) -> Graphs:
        """The graphs of edges(by, u, v), with their rows counted, or with the least day. ends(uid): who edges may have."""
        by = by or []
        people, blocks = _people(ends if ends is not None else edges.select(F.explode(F.array("u", "v")).alias("uid")))
        u, v = (people.select(F.col("uid").alias(x), F.col("b").alias(f"b{x}"), F.col("i").alias(f"i{x}")) for x in "uv")
        days = [F.col("day").cast("long").alias("day")] if kind == "count" else []
        value = (F.col("day") + _DAY_0).cast("int") if kind == "first" else F.lit(1)
        rows = edges.where("u != v").select(*[F.col(x).alias(f"k{o}") for o, x in enumerate(by)], *days, "u", "v", value.alias("value")).join(u, "u").join(v, "v")
        turn, keys = F.col("bu") <= F.col("bv"), [f"k{o}" for o in range(len(by))]
        rows = rows.select(*keys, *days, F.least("bu", "bv").alias("r"), F.greatest("bu", "bv").alias("c"), F.when(turn, F.col("iu")).otherwise(F.col("iv")).alias("i"), F.when(turn, F.col("iv")).otherwise(F.col("iu")).alias("j"), "value")
        sizes = people.groupBy("b").agg(F.count("*").cast("int").alias("size"))
        rows = rows.join(F.broadcast(sizes.select(F.col("b").alias("r"), F.col("size").alias("rows"))), "r").join(F.broadcast(sizes.select(F.col("b").alias("c"), F.col("size").alias("columns"))), "c")

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, low, high = None, None, None
            for part in batches:
                if "day" in part.schema.names:
                    day = part["day"].to_numpy()
                    low, high = min(day.min(), day.min() if low is None else low), max(day.max(), day.max() if high is None else high)
                if m is None:
                    m = np.zeros((part["rows"][0].as_py(), part["columns"][0].as_py()), np.int32)
                    m[:] = 2**31 - 1 if kind == "first" else 0
                (np.minimum if kind == "first" else np.add).at(m, (part["i"].to_numpy(), part["j"].to_numpy()), part["value"].to_numpy())
            m[m == 2**31 - 1] = 0
            *_, r, c = (k.as_py() for k in key)
            yield from _batch(_records(r, c, m, kind), key[: len(by)], (low, high))

        schema = "".join(f"k{o} {edges.schema[x].dataType.simpleString()}, " for o, x in enumerate(by)) + _MATRIX
        records = rows.select(*keys, "r", "c", *days, "i", "j", "value", "rows", "columns").groupBy(*keys, "r", "c").applyInArrow(run, schema)
        return Graphs(records.persist() if days else records, people, blocks, by)  # counts are read again for their days

    def days(self) -> DataFrame:
        """by, days: from the first to the last day of the edges of each graph, both in."""
        return self.records.where("low is not null").groupBy(*[F.col(f"k{o}").alias(x) for o, x in enumerate(self.by)]).agg((F.max("high") - F.min("low") + 1).alias("days"))

    def _sides(self) -> DataFrame:
        """Each pair of blocks (x <= y) with the rows of both."""
        return _dealt(self.records.withColumn("b", F.col("r")), self.blocks).where("not own or (x = r and y = c)").drop("b")

    def closed_pairs(self, by_day: bool = False) -> DataFrame:
        """uid, day, n, t: how many contacts each day gives a node, and how many ordered pairs of its contacts are then in contact for the first time; without by_day of all days (day 0)."""

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y = (k.as_py() for k in key)
            held, _ = _read(batches)
            if (x, y) not in held:
                return
            first = _unpacked(*held[x, y])
            days = np.unique(np.concatenate([np.unique(_unpacked(*m)) for m in held.values()])) if by_day else np.array([_DAY_0])
            before = [(0, 0), (0, 0)]
            for day in days[days > 0].tolist():
                kept = (lambda m, day=day: (m > 0) & (m <= day)) if by_day else (lambda m: m > 0)
                edge = kept(first)
                shared = np.where(edge, _common(held, x, y, kept), 0)
                for side, (b, axis) in enumerate(((x, 1), (y, 0))[: 1 if x == y else 2]):
                    n, t = edge.sum(axis), np.rint(shared.sum(axis, dtype=np.float64)).astype(np.int64)
                    more = n - before[side][0], t - before[side][1]
                    at = np.flatnonzero((more[0] != 0) | (more[1] != 0))
                    before[side] = n, t
                    yield pa.RecordBatch.from_pydict({"b": pa.array(np.full(len(at), b, np.int32)), "i": pa.array(at.astype(np.int32)), "day": pa.array(np.full(len(at), day - _DAY_0, np.int64)), "n": pa.array(more[0][at].astype(np.int64)), "t": pa.array(more[1][at])})

        got = self._sides().groupBy("x", "y").applyInArrow(run, "b int, i int, day bigint, n bigint, t bigint")
        return got.groupBy("b", "i", "day").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).join(self.people, ["b", "i"]).select("uid", "day", "n", "t")

    def overlaps(self, named: bool = True) -> DataFrame:
        """by, u, v, n, overlap: each edge with its count (1 where none were kept), and its ends' common neighbours over all neighbours of either; without u and v unless named."""

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            *_, x, y = (k.as_py() for k in key)
            held, own = _read(batches)
            if (x, y) not in held:
                return
            n = _unpacked(*own) if own else _unpacked(*held[x, y])
            degree = {b: sum(_unpacked(*m).sum(1) for (r, _), m in held.items() if r == b) for b in {x, y}}
            shared = _common(held, x, y, lambda m: m)
            i, j = np.nonzero(n if x != y else np.triu(n, 1))
            c = np.rint(shared[i, j]).astype(np.int64)
            rest = degree[x][i] + degree[y][j] - c
            value = np.where(rest > 0, c / np.where(rest > 0, rest, 1), 0.0)
            for at in range(0, len(i), _STEP):
                k = slice(at, at + _STEP)
                m = len(i[k])
                out = {f"k{o}": pa.array([kind.as_py()] * m, kind.type) for o, kind in enumerate(key[:-2])}
                if named:
                    out |= {"x": pa.array(np.full(m, x, np.int32)), "i": pa.array(i[k].astype(np.int32)), "y": pa.array(np.full(m, y, np.int32)), "j": pa.array(j[k].astype(np.int32))}
                yield pa.RecordBatch.from_pydict(out | {"n": pa.array(n[i[k], j[k]].astype(np.int64)), "overlap": pa.array(value[k])})

        keys = [f"k{o}" for o in range(len(self.by))]
        schema = "".join(f"{k} {self.records.schema[k].dataType.simpleString()}, " for k in keys) + ("x int, i int, y int, j int, " if named else "") + "n bigint, overlap double"
        got = self._sides().groupBy(*keys, "x", "y").applyInArrow(run, schema).withColumnsRenamed(dict(zip(keys, self.by, strict=True)))
        if not named:
            return got
        a, c = (self.people.select(F.col("b").alias(p), F.col("i").alias(q), F.col("uid").alias(e)) for p, q, e in (("x", "i", "p"), ("y", "j", "q")))
        return got.join(a, ["x", "i"]).join(c, ["y", "j"]).select(*self.by, F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"), "n", "overlap")


def _read(batches) -> tuple[dict, tuple | None]:
    """(r, c) -> packed matrix with its shape; and the pair's own."""
    held, own = {}, None
    for part in batches:
        for r, c, mine, n, m, form, data in zip(*(part[x].to_pylist() for x in ("r", "c", "own", "rows", "columns", "form", "data")), strict=True):
            if mine:
                own = form, data, (n, m)
            else:
                held[r, c] = form, data, (n, m)
    return held, own


def _common(held: dict, x: int, y: int, kept) -> np.ndarray | int:
    """Neighbours in common of each of block x with each of block y, by edges that kept marks."""
    out = 0
    for r, k in list(held):
        if r == x and (y, k) in held:
            a = kept(_unpacked(*held[x, k])).astype(np.float32)
            out = out + a @ (a if x == y else kept(_unpacked(*held[y, k])).astype(np.float32)).T
    return out
