"""Numpy kernels over Arrow string buffers, shared by the text operators.

All of them work on the UTF-8 bytes of a whole Arrow batch at once, in slices of
bounded size, so that memory does not follow the length of a text column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd base of the polynomial byte hash (mod 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
INV = pow(BASE, -1, 1 << 64)
#: Bytes of text that a kernel looks at in one go.
SLICE = 1 << 20

_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _accumulated(base: int, n: int) -> np.ndarray:
    a = np.full(n, base, dtype=U64)
    a[:1] = 1
    return np.multiply.accumulate(a)


def powers(name: str, n: int) -> np.ndarray:
    """The first n powers of BASE (up) or of its inverse (down); those of one slice are kept."""
    base = BASE if name == "up" else INV
    if n > SLICE + 4096:
        return _accumulated(base, n)
    if name not in _POW:
        _POW[name] = _accumulated(base, SLICE + 4096)
    return _POW[name][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] = sum of (byte i + 1) * BASE**i over i < j."""
    h = np.empty(len(data) + 1, dtype=U64)
    h[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * powers("up", len(data)), out=h[1:])
    return h


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scrambled hash of data[start:end], wherever it stands."""
    return mix((h[end] - h[start]) * powers("down", len(h))[start] + (end - start).astype(U64))


def string_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    n = len(col)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(keep) -> np.ndarray:
    """For each byte what keep makes of it; 0 marks a byte outside words."""
    return np.array([keep(b) for b in range(256)], dtype=np.uint8)


#: Words as runs of anything but white space, A-Z lower-cased.
SPACED = byte_table(lambda b: 0 if b in (0x20, *range(0x09, 0x0E)) else b + 32 if 65 <= b <= 90 else b)
#: Words as runs of letters; every byte of a multi-byte character counts as one.
LETTERS = byte_table(lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0)


def slices(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Byte ranges of about size bytes that cut no word (text ends cut words by themselves)."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + size)
        while end < n:
            nxt = int(offsets[np.searchsorted(offsets, end)])  # the next text's start is a cut as well
            stop = min(n, end + 4096, nxt if nxt >= end else n)
            gap = np.flatnonzero(table[raw[end:stop]] == 0)
            if len(gap):
                end += int(gap[0])
                break
            if stop == nxt:
                end = nxt
                break
            end = stop
        yield at, end
        at = end


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, text index and byte length of every word, in order."""
    hashes, docs, lengths = [], [], []
    for a, b in slices(raw, offsets, table):
        data = table[raw[a:b]]
        inside = data != 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(offsets, [a, b])
        cuts = offsets[lo:hi] - a
        cuts = cuts[cuts < b - a]
        begin[cuts] = inside[cuts]
        start = np.flatnonzero(begin)
        if not len(start):
            continue
        last = inside.copy()
        last[:-1] &= ~inside[1:] | begin[1:]
        end = np.flatnonzero(last) + 1
        hashes.append(range_hash(prefix_hash(data), start, end))
        docs.append(np.searchsorted(offsets, start + a, side="right") - 1)
        lengths.append(end - start)
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(docs), np.concatenate(lengths)


def blocks(batch: pa.RecordBatch, text: str, size: int = 4 * SLICE) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about size bytes of text, one row at least."""
    col = batch.column(batch.schema.get_field_index(text))
    _, offsets = string_bytes(col)
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end
