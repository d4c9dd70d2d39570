"""Packing token sequences by bounded-space online best-fit.

Documents are cut into pieces of at most the capacity. Full pieces are sequences of
their own; the others are dealt to groups of bounded size by a hash, and a group's
pieces come as a stream in the order of another hash. A stream has a fixed number of
open bins, kept in a bitset keyed by free space: the fullest bin that still has room
takes the piece; where none has and all bins are open, the fullest one closes first.
AHEAD pieces of the stream are read ahead and placed longest first; the bins stay open
from one such window to the next. With AHEAD = 1 pieces are placed as they come.

Defined cases: a null or empty text is its end mark alone; repeated rows are packed
one by one; pieces of equal length are placed in the stream's order, and rows that are
equal in all columns in any order, which leaves the result the same; very long texts
become many pieces and are encoded stretch by stretch; a null key is kept; an empty
table gives an empty result; other input columns do not matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_batches, lean, written
from .tokens import PieceEncoder

CAPACITY = 2048
END = 0
END_MARK = END.to_bytes(4, "little")
#: Bins open at once, and pieces of a stream that are sorted together.
OPEN_BINS, AHEAD = 512, 1024
#: Tokens a group holds, about.
GROUP_TOKENS = 4 << 20


class BestFit:
    """Open bins by free space; bit f of mask is set where a bin with f free is open."""

    def __init__(self, capacity: int = CAPACITY, bins: int = OPEN_BINS):
        self.capacity, self.bins, self.mask, self.open, self.made, self.closed = capacity, bins, 0, 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        room = self.mask >> length
        if room:
            space = length + (room & -room).bit_length() - 1
            at = self._take(space)
        else:
            if self.open == self.bins:
                self._take((self.mask & -self.mask).bit_length() - 1)
                self.closed += 1
            space, at = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.free[left].append(at)
            self.mask |= 1 << left
            self.open += 1
        return at, self.capacity - space

    def _take(self, space: int) -> int:
        at = self.free[space].pop()
        if not self.free[space]:
            self.mask &= ~(1 << space)
        self.open -= 1
        return at


def stream(lengths: np.ndarray, capacity: int = CAPACITY, bins: int = OPEN_BINS, ahead: int = AHEAD) -> tuple[np.ndarray, BestFit]:
    """Bin and offset of each piece of a stream, and the packer as the stream left it."""
    fit = BestFit(capacity, bins)
    got = np.zeros((len(lengths), 2), np.int64)
    for a in range(0, len(lengths), ahead):
        for i in a + np.argsort(-lengths[a : a + ahead], kind="stable"):
            got[i] = fit.add(int(lengths[i]))
    return got, fit


def cut(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces of the tokenized documents: key, piece, start, length, ids_crc32 and, if asked for, ids."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder = PieceEncoder.of(tokenizer)
        for whole in batches:
            for batch in K.blocks(whole, "text"):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                row, piece, start, length, crc, content = [], [], [], [], [], []
                for i, got in enumerate(encoder.encode_all(texts)):
                    got += END_MARK
                    for p, a in enumerate(range(0, len(got), 4 * capacity)):
                        part = got[a : a + 4 * capacity]
                        row.append(i)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if ids:
                            content.append(np.frombuffer(part, "<u4").tolist())
                columns = {"key": batch.column(batch.schema.get_field_index("key")).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if ids:
                    columns["ids"] = pa.array(content, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if ids else "")
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run, encodes=True), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, bins: int = OPEN_BINS, group_tokens: int = GROUP_TOKENS, ahead: int = AHEAD) -> DataFrame:
    """pieces (any columns but __group and __turn, with length from 1 to capacity) with sequence_id and offset.

    Reads pieces twice: give a table, not a plan. The number of groups follows the
    tokens, so that a group is bounded and the bins left open at its end weigh little.
    """
    tokens = pieces.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // group_tokens))
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"

    def place(part: pa.Table) -> pa.Table:
        part = part.sort_by("__turn").drop_columns("__turn")
        got, _ = stream(part["length"].to_numpy(), capacity, bins, ahead)
        sequence = (part["__group"].to_numpy() << 32) + got[:, 0]
        return part.drop_columns("__group").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(got[:, 1]))

    names = [F.col(f"`{c}`") for c in pieces.columns if c != "ids"]
    dealt = F.pmod(F.xxhash64(*names), F.lit(groups)).cast("long")
    some = pieces.where(F.col("length") < capacity).withColumn("__group", dealt).withColumn("__turn", F.xxhash64(F.lit(1), *names)).groupBy("__group").applyInArrow(place, schema)
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return some.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    return pack(written(cut(docs, tokenizer, key, text, capacity), "pieces"), capacity)
