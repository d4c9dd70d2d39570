"""Repeated passages by enhanced suffix arrays and the tree of common-prefix intervals.

A string of `least` bytes that stands in two places holds, in both, the same anchor:
the gram with the least hash among those it contains (the last of equals). Anchors are
about one in a hundred bytes. Only anchors that occur again matter, and whatever a
repeated string of that length can add around one lies within its context, a bounded
stretch of bytes about it. So:

1. anchors are found and counted, and unrepeated ones dropped;
2. contexts that occur twice as a whole are repeats as they stand;
3. the others of a repeated anchor meet as bytes, each different context once; an
   enhanced suffix array over them is scanned with a stack, and every common-prefix
   interval of at least `least` bytes whose left neighbours differ is a maximal repeat
   group with all its occurrences;
4. an anchor with more different contexts than fit in one array is split: each of its
   contexts gives the shorter contexts of its windows, by blocks of window starts, under
   the anchor of what all windows of the block share. Strings that are equal still meet,
   and step 2 and 3 are done again on these.

Whole contexts are compared by two independent 64-bit hashes (of the anchor and of the
context), all else byte by byte. Equal texts are handled once.

Defined cases: a null text is empty; texts shorter than `least` have no repeats; matches
never cross texts; occurrences that overlap count; repeated rows are repeats of each
other; very long texts are read in steps; null and repeated keys are kept; an empty table
gives an empty result; other input columns do not matter, and none of their names clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_batches, lean, written

LEAST = 400
#: Window starts looked at in one go; bytes of contexts in one suffix array, and most for one anchor.
STEP, ARRAY_BYTES, ANCHOR_BYTES = 1 << 18, 1 << 20, 2 << 20
#: Blocks that the window starts of a large anchor are split into; suffixes put in order at once (and the rest of a bucket), and compared at once.
SPLIT, TOGETHER, CHECKED = 4, 1 << 15, 8192
_LOW = (1 << 20) - 1


def _column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours in a row."""
    n = len(v) - w + 1
    pad = -len(v) % w
    x = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(x, axis=1).ravel()
    return np.minimum(ahead[:n], behind[w - 1 : w - 1 + n])


def gram_size(least: int) -> int:
    """Bytes of an anchor. Smaller grams make fewer anchors, with longer contexts."""
    return max(1, least // 3)


def anchors(raw: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """text index, place in the text, anchor hash and context hash of every anchor."""
    gram = gram_size(least)
    w = least - gram + 1
    n = len(raw)
    found: list[tuple[np.ndarray, ...]] = []
    for p0 in range(0, n - least + 1, STEP):
        p1 = min(p0 + STEP, n - least + 1)
        a, b = max(0, p0 - w + 1), min(n, p1 + w + least)
        h = K.prefix_hash(raw[a:b])
        q = np.arange(p0, p1 + w - 1)
        hashed = K.range_hash(h, q - a, q - a + gram)
        v = (hashed & ~K.U64(_LOW)) | (K.U64(_LOW) - (q - p0).astype(np.uint64))
        p = np.arange(p0, p1)
        doc = np.searchsorted(offsets, p, side="right") - 1
        valid = p + least <= offsets[doc + 1]
        if not valid.any():
            continue
        at = np.unique(_LOW - (sliding_min(v, w)[valid] & K.U64(_LOW)).astype(np.int64))
        place = at + p0
        d = np.searchsorted(offsets, place, side="right") - 1
        lo, hi = np.maximum(place - w + 1, offsets[d]), np.minimum(place + least, offsets[d + 1])
        found.append((d, place - offsets[d], hashed[at], K.mix(K.range_hash(h, lo - a, hi - a) ^ ((place - lo) * 1_000_003).astype(np.uint64))))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    d, place, g, c = (np.concatenate(x) for x in zip(*found, strict=True))
    _, once = np.unique(d * (int(np.diff(offsets).max()) + 1) + place, return_index=True)
    return d[once], place[once], g[once], c[once]


class SuffixArray:
    """The suffixes of at least depth bytes of strings put side by side, in order, with their common prefixes.

    No interval of depth bytes and more crosses a bucket of suffixes whose first depth bytes
    are equal, so buckets are made by fingerprint and stand in any order; the suffixes of a
    bucket stand in theirs, and what they share is counted byte by byte. Buckets whose
    suffixes all have the same byte before them hold no maximal repeat and are left out.
    """

    def __init__(self, strings: list[np.ndarray], depth: int):
        size = np.array([len(s) for s in strings])
        begin = np.cumsum(size) - size
        raw = np.concatenate(strings)
        many = np.maximum(size - depth + 1, 0)
        owner = np.repeat(np.arange(len(strings)), many)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start = begin[owner] + inside
        # The byte before a suffix; what begins a string has a left neighbour of its own.
        left = np.where(inside == 0, -1 - start, raw[np.maximum(start - 1, 0)])
        h = K.prefix_hash(raw)
        mark = K.range_hash(h, start, start + depth)
        order = np.argsort(mark)
        same = mark[order][1:] == mark[order][:-1]
        bucket = np.cumsum(np.r_[True, ~same][: len(order)]) - 1
        differs = np.r_[False, same & (left[order][1:] != left[order][:-1])][: len(order)]
        keep = (np.bincount(bucket, differs) > 0)[bucket] if len(order) else np.zeros(0, bool)
        at, bucket = order[keep], bucket[keep]
        rest = (begin + size)[owner[at]] - start[at] - depth
        # Whole buckets at a time, as a row of bytes is made for each suffix.
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(at)])
        cuts = first[np.r_[True, first[1:] // TOGETHER != first[:-1] // TOGETHER]] if len(at) else first
        parts = [_ordered(raw, start[at[i:j]], rest[i:j], bucket[i:j], depth) for i, j in zip(cuts, [*cuts[1:], len(at)], strict=True)]
        by = np.concatenate([x + i for (x, _), i in zip(parts, cuts, strict=True)]) if parts else np.zeros(0, np.int64)
        #: Of each suffix: the string it is of, where it begins there, what stands before it; bytes shared with the one before.
        self.owner, self.start, self.left = owner[at[by]], inside[at[by]], left[at[by]]
        self.lcp = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.int64)


def _ordered(raw: np.ndarray, start: np.ndarray, rest: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by bucket and by the rest bytes that follow their first depth, and bytes shared with the one before (0 across buckets)."""
    tail = _rows(raw, start + depth, rest)
    together = bucket[1:] == bucket[:-1]
    keys = [bucket, tail, rest]
    same = np.full(1, depth)
    parted = any(bool(((x := _rows(raw, start[i : i + CHECKED + 1], same))[1:] != x[:-1])[together[i : i + CHECKED]].any()) for i in range(0, len(start), CHECKED))
    if parted:  # two strings of one fingerprint: the whole suffix decides, and what it shares
        keys[1:1] = [_rows(raw, start, same)]
    by = np.argsort(_sortable(*keys))
    bucket, tail, rest = bucket[by], tail[by], rest[by]
    equal = np.c_[tail[1:] == tail[:-1], np.zeros((max(len(by) - 1, 0), 1), bool)]
    shared = depth + np.minimum(equal.argmin(1), np.minimum(rest[1:], rest[:-1]))
    together = bucket[1:] == bucket[:-1]
    if parted:
        head = keys[1][by]
        together &= (head[1:] == head[:-1]).all(1)
    return by, np.r_[0, np.where(together, shared, 0)][: len(by)]


def _rows(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """size bytes from start on in rows, padded with 0."""
    width = int(size.max(initial=0))
    if not width:
        return np.zeros((len(start), 0), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(width, np.uint8)), width)[start]
    if (size < width).any():
        rows *= np.arange(width) < size[:, None]
    return rows


def _sortable(*parts: np.ndarray) -> np.ndarray:
    """Strings of fixed width that sort like the parts: rows of bytes, or numbers from 0 on."""
    columns = [x if x.ndim == 2 else x.astype(">u4").view(np.uint8).reshape(-1, 4) for x in parts]
    rows = np.ascontiguousarray(np.concatenate(columns, axis=1))
    return rows.view(f"S{rows.shape[1]}").ravel()


def interval_tree(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every common-prefix interval of at least least; lcp[i] is that of suffixes i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now = int(lcp[i]) if i < len(lcp) else 0
        left = i - 1
        while stack and stack[-1][0] > now:
            length, left = stack.pop()
            yield length, left, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def maximal_repeats(strings: list[np.ndarray], place: np.ndarray, least: int) -> tuple[SuffixArray, np.ndarray]:
    """The suffix array of strings, and (length, first, last) of each maximal repeat of at least least bytes in it, the longest last.

    place: a number for each string's first byte; occurrences at equal numbers are one.
    """
    sa = SuffixArray(strings, least)
    tree = np.array(list(interval_tree(sa.lcp, least)), np.int64).reshape(-1, 3)
    number = place[sa.owner] + sa.start
    # How often the left neighbour, and the place, has changed up to each suffix.
    changes = [np.cumsum(np.r_[False, x[1:] != x[:-1]][: len(x)]) for x in (sa.left, number)]
    for c in changes:
        tree = tree[c[tree[:, 1]] != c[tree[:, 2]]]
    return sa, tree[np.argsort(tree[:, 0], kind="stable")]


def _scan(batches, least: int, groups: bool):
    """Suffix arrays over whole anchors, about ARRAY_BYTES at a time. Rows come ordered by anchor.

    Rows of the result are what maximal repeats cover in a context, or, with groups, each
    occurrence of each maximal repeat in the contexts.
    """

    def flush(held):
        ctx = [np.frombuffer(r[4], np.uint8) for r in held]
        if len(ctx) < 2:
            return
        # Strings of one text are numbered along it, others far apart.
        texts: dict[tuple[int, int], int] = {}
        number = np.array([texts.setdefault((r[1], r[2]), len(texts)) * (1 << 34) + r[3] for r in held])
        sa, tree = maximal_repeats(ctx, number, least)
        if groups:
            size, first, last = tree.T
            take = np.repeat(first - (np.cumsum(last - first + 1) - (last - first + 1)), last - first + 1) + np.arange(int((last - first + 1).sum()))
            string, size, first = sa.owner[take], np.repeat(size, last - first + 1), sa.start[take]
        else:
            # What groups cover is summed up along each context, so that nested groups of one
            # passage are not listed occurrence by occurrence.
            longest = np.zeros(len(sa.lcp), np.int64)
            for length, i, j in tree.tolist():
                longest[i : j + 1] = length
            width = np.array([len(c) + 1 for c in ctx])
            begin = np.cumsum(width) - width
            at = begin[sa.owner] + sa.start
            mark = np.bincount(at[longest > 0], minlength=int(width.sum())) - np.bincount((at + longest)[longest > 0], minlength=int(width.sum()))
            on = np.cumsum(mark) > 0
            first = np.flatnonzero(on & ~np.r_[False, on[:-1]])
            size = np.flatnonzero(on & ~np.r_[on[1:], False]) + 1 - first
            string = np.searchsorted(begin, first, side="right") - 1
            first = first - begin[string]
        if not len(first):
            return
        d, nb, base = (np.array([held[i][c] for i in string], np.int64) for c in (1, 2, 3))
        ident = [int.from_bytes(hashlib.blake2b(held[i][4][x : x + n], digest_size=8).digest(), "little", signed=True) for i, x, n in zip(string, first, size, strict=True)] if groups else [0] * len(first)
        yield pa.RecordBatch.from_pydict({"d": pa.array(d), "nb": pa.array(nb.astype(np.int32)), "lo": pa.array((base + first).astype(np.int32)), "hi": pa.array((base + first + size).astype(np.int32)), "repeat": pa.array(ident, pa.int64())})

    held, group, size, held_size, anchor = [], [], 0, 0, None
    for batch in batches:
        for row in zip(*(_column(batch, c).to_pylist() for c in ("a", "d", "nb", "base", "context")), strict=True):
            if row[0] != anchor:
                if held and held_size + size > ARRAY_BYTES:
                    yield from flush(held)
                    held, held_size = [], 0
                held += group
                held_size += size
                group, size, anchor = [], 0, row[0]
            group.append(row)
            size += len(row[4])
    if held and held_size + size > ARRAY_BYTES:
        yield from flush(held)
        held = []
    yield from flush(held + group)


def _split(batches, least: int):
    """Occurrences of the shorter contexts of windows whose starts lie in one block of those of a context.

    A window starts at place - o, with o from near to far. All windows of a block hold what
    lies between the first and the last start of it and their ends, and it is their new anchor.
    """
    for batch in batches:
        raw, off = K.string_bytes(_column(batch, "context"))
        rows = []
        for i, (a, d, nb, place, near, far, base) in enumerate(zip(*(_column(batch, c).to_pylist() for c in ("a", "d", "nb", "place", "near", "far", "lo")), strict=True)):
            h = K.prefix_hash(raw[off[i] : off[i + 1]])
            last = base + off[i + 1] - off[i] - least
            step = -(-(far - near + 1) // SPLIT)
            for k in range(near, far + 1, step):
                e = min(k + step - 1, far)
                x, y = max(base, place - e), min(last, place - k)
                if x <= y:
                    rows.append((a, d, nb, place, near, k, e, x, y + least, place - k - base, place - e + least - base, x - base, y + least - base, h))
        if not rows:
            continue
        core = np.array([K.range_hash(r[-1], np.array([r[9]]), np.array([r[10]]))[0] for r in rows])
        whole = np.array([K.range_hash(r[-1], np.array([r[11]]), np.array([r[12]]))[0] for r in rows])
        a, d, nb, place, up, near, far, lo, hi = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:9])
        key = K.mix(core ^ K.mix(a.view(np.uint64) + near.astype(np.uint64)))
        c = K.mix(whole ^ ((place - lo) * 1_000_003).astype(np.uint64))
        ints = {n: pa.array(v.astype(np.int32)) for n, v in (("nb", nb), ("place", place), ("up", up), ("near", near), ("far", far), ("lo", lo), ("hi", hi))}
        yield pa.RecordBatch.from_pydict({"a": pa.array(key.view(np.int64)), "c": pa.array(c.view(np.int64)), "d": pa.array(d), **ints})


def _cut(batches):
    """The bytes of the contexts that are wanted from each text, or from each context that is split.

    Equal texts come one after the other from a sorted join, and only the first is cut; where
    they do not, contexts come twice, which stand at one place and so are one occurrence.
    """
    last = None
    for batch in batches:
        keys = [_column(batch, c).to_numpy() for c in ("d", "nb", "base")]
        if not batch.num_rows:
            continue
        new = np.r_[tuple(int(k[0]) for k in keys) != last, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
        last = tuple(int(k[-1]) for k in keys)
        batch = batch.filter(pa.array(new))
        raw, off = K.string_bytes(_column(batch, "data"))
        lists = _column(batch, "wanted")
        inner = lists.flatten()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        lo, hi = (inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
        shift = (off[:-1] - _column(batch, "base").to_numpy())[owner]
        context = [raw[x:y].tobytes() for x, y in zip(lo + shift, hi + shift, strict=True)]
        take = pa.array(owner)
        names = ("a", "large", "place", "near", "far", "lo")
        yield pa.RecordBatch.from_arrays([*(inner.field(c) for c in names), *(_column(batch, c).take(take) for c in ("d", "nb")), pa.array(context, pa.binary())], names=[*names, "d", "nb", "context"])


OCCURRENCE = "a bigint, c bigint, d bigint, nb int, place int, up int, near int, far int, lo int, hi int"
CONTEXT = "a bigint, large boolean, place int, near int, far int, lo int, d bigint, nb int, context binary"


def repeats(docs: DataFrame, text: str = "text", least: int = LEAST, anchor_bytes: int = ANCHOR_BYTES, groups: bool = False) -> DataFrame:
    """What repeated passages cover in the distinct texts: d (hash of the text), nb (its bytes), lo, hi, repeat.

    repeat is 0; with groups, rows are the occurrences of each maximal repeat, repeat being
    a hash of its bytes: the repeats that lie in contexts of this operator (so a longer one
    appears by its overlapping parts), each with all its occurrences in different contexts,
    and each context that recurs as a whole.
    """
    arrow_batches(docs.sparkSession)
    w = least - gram_size(least) + 1
    rows = docs.select(F.col(text).alias("text")).withColumn("nb", F.octet_length("text").cast("int")).where(f"nb >= {least}").withColumn("d", F.xxhash64("text"))

    def find(batches):
        for whole in batches:
            for batch in K.blocks(whole, "text"):
                raw, off = K.string_bytes(_column(batch, "text"))
                d, place, a, c = anchors(raw, off, least)
                take = pa.array(d)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), _column(batch, "d").take(take), _column(batch, "nb").take(take), pa.array(place.astype(np.int32))], names=["a", "c", "d", "nb", "place"])

    def repeated(found: DataFrame) -> DataFrame:
        # A table of its own, so that Spark can split a hot anchor's side of the join.
        twice = written(found.groupBy("a").agg(F.count("*").alias("times")).where("times > 1").select("a"), "twice")
        return written(found.join(twice, "a"), "anchors")

    again = repeated(rows.select("text", "d", "nb").mapInArrow(lean(find), "a bigint, c bigint, d bigint, nb int, place int"))
    again = again.selectExpr("a", "c", "d", "nb", "place", "0 up", "0 near", f"{w - 1} far", f"greatest(0, place - {w - 1}) lo", f"least(nb, place + {least}) hi")
    above, on = rows.selectExpr("d", "nb", "text data", "0 base"), ["d", "nb"]
    found = []
    while True:
        first = F.min(F.struct("d", "nb", "place", "up", "near", "far", "lo", "hi")).alias("at")
        rows_ = again.count()
        contexts = written(again.groupBy("a", "c").agg(F.count("*").alias("n"), first).select("a", "c", "n", "at.*"), "contexts", rows_)
        several = written(contexts.where("n > 1").select("a", "c"), "several", rows_)
        found.append(again.join(several, ["a", "c"]).select("d", "nb", "lo", "hi", F.xxhash64("a", "c").alias("repeat") if groups else F.lit(0).cast("long").alias("repeat")).distinct())
        mixed = contexts.groupBy("a").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest"), F.sum(F.col("hi") - F.col("lo")).alias("size"))
        mixed = written(mixed.where("kinds > 1 and fewest = 1").select("a", (F.col("size") > anchor_bytes).alias("large")), "mixed", rows_)
        wanted = contexts.join(mixed, "a").withColumn("large", F.expr("large and far > near"))
        # A table of its own, so that Spark can split a text that many rows have.
        wanted = written(wanted.groupBy(*on).agg(F.collect_list(F.struct("a", "large", "place", "near", "far", "lo", "hi")).alias("wanted")), "wanted", rows_, 20_000)
        bytes_ = written(above.join(wanted, on).select("data", "base", "d", "nb", "wanted").mapInArrow(lean(_cut), CONTEXT), "context-bytes", rows_, 20_000)
        fits = bytes_.where("not large").repartition("a").sortWithinPartitions("a", "d", "nb", "place")
        found.append(fits.select("a", "d", "nb", F.col("lo").alias("base"), "context").mapInArrow(lean(lambda b: _scan(b, least, groups)), "d bigint, nb int, lo int, hi int, repeat bigint"))
        large = bytes_.where("large")
        if large.isEmpty():
            break
        again = repeated(large.mapInArrow(lambda b: _split(b, least), OCCURRENCE))
        above, on = large.selectExpr("d", "nb", "place", "near up", "lo base", "context data"), ["d", "nb", "place", "up"]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, keep_text: bool = False, anchor_bytes: int = ANCHOR_BYTES, words: int = 0) -> DataFrame:
    """docs' keys with n_bytes, n_removed, n_spans, kept_sha256 after all bytes of repeats are taken out.

    keep_text: all input columns instead of the key alone, text being what remains
    (bytes that are no longer UTF-8 at a cut are dropped from the text, not from the hash).
    words: only runs of repeats that hold so many whole words are taken out.
    """
    carried = docs.columns if keep_text else [key]
    column = dict(docs.dtypes)
    # Input columns travel under numbers, so that no name of theirs can clash.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(carried) if c != text], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{text}`").isNull().alias("was_null"))
    rows = rows.withColumn("nb", F.octet_length("text").cast("int")).withColumn("d", F.xxhash64("text"))
    spans = repeats(docs, text, least, anchor_bytes).groupBy("d", "nb").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    spans = written(spans, "spans")
    kept = [f"__{i}" for i, c in enumerate(carried) if c != text]

    def strip(batches):
        for batch in batches:
            raw, off = K.string_bytes(_column(batch, "text"))
            lists = _column(batch, "spans")
            at = lists.offsets.to_numpy()
            inner = lists.flatten()
            lo_all, hi_all = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
            none = lists.is_null().to_numpy(zero_copy_only=False)
            removed, runs, sha, left = [], [], [], []
            base, skipped = at[0], 0
            for i in range(batch.num_rows):
                data = raw[off[i] : off[i + 1]]
                if none[i]:
                    gone = np.zeros(len(data), bool)
                    skipped += at[i + 1] - at[i]
                else:
                    mark = np.zeros(len(data) + 1, np.int32)
                    np.add.at(mark, lo_all[at[i] - base - skipped : at[i + 1] - base - skipped], 1)
                    np.add.at(mark, hi_all[at[i] - base - skipped : at[i + 1] - base - skipped], -1)
                    gone = np.cumsum(mark)[:-1] > 0
                    if words:
                        gone = _wordy(data, gone, words)
                stays = data[~gone].tobytes()
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0)
                if keep_text:
                    left.append(stays.decode("utf-8", "ignore"))
                else:
                    sha.append(hashlib.sha256(stays).hexdigest())
            own = [_column(batch, c) for c in kept]
            if keep_text:
                lost = _column(batch, "was_null").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*own, pa.array([None if n else x for n, x in zip(lost, left, strict=True)], pa.string())], names=[*kept, "text"])
            else:
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=[*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = "".join(f"__{i} {column[c]}, " for i, c in enumerate(carried) if c != text)
    joined = rows.join(spans, ["d", "nb"], "left").select(*kept, "text", "was_null", "spans")
    if keep_text:
        done = joined.mapInArrow(lean(strip), f"{own}text string")
        return done.select(*[F.col("text" if c == text else f"__{i}").alias(c) for i, c in enumerate(carried)])
    done = joined.mapInArrow(lean(strip), f"{own}n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return done.select(F.col("__0").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _wordy(data: np.ndarray, gone: np.ndarray, words: int) -> np.ndarray:
    """Those runs of gone that hold so many whole words."""
    inside = K.SPACED[data] != 0
    begin = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    end = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    first = np.flatnonzero(gone & ~np.r_[False, gone[:-1]])
    last = np.flatnonzero(gone & ~np.r_[gone[1:], False]) + 1
    many = np.searchsorted(end, last, side="right") - np.searchsorted(begin, first)
    out = np.zeros(len(data), bool)
    for x, y in zip(first[many >= words], last[many >= words], strict=True):
        out[x:y] = True
    return out
