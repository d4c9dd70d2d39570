"""Token files: concatenated ids with Elias-Fano coded document boundaries.

A file is one shard of the documents in key order: the ids as little-endian unsigned
16-bit (or, for larger vocabularies, 32-bit) integers, the ends of its documents in
Elias-Fano form (the low bits of each end packed in a row, the high bits in unary), a
select directory with the place of every SKIP-th one bit of the unary part, and a foot
of fixed size. The i-th boundary is found from the foot and two short reads.
Boundaries take about 2 + log2(tokens / documents) bits each, with no 64-bit table.

A file is written once, from front to back, under another name and renamed, so a task
that runs twice, or again after a lost executor, leaves one whole file. Keys stand
beside the files, in rows of at most UNIT documents and about UNIT_TOKENS tokens; such
a row is what a task reads back, so a long file is read by many.

Defined cases: a null or empty text is its end mark alone; very long texts are encoded
stretch by stretch; null keys come first; rows of equal keys are ordered by a hash of
their text, and rows equal in both are alike; an empty table gives no files and an
empty result; other input columns do not matter; ids that do not fit in width bytes
are an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_batches, lean, shared_path
from .tokens import PieceEncoder

MAGIC = b"TMTOKEF2"
FOOT = "<8sIIQQQQ"  # magic, bytes an id, low bits, documents, tokens, unary bytes, select entries
SKIP = 256
END = 0
END_MARK = END.to_bytes(4, "little")
#: Documents, and tokens about, that are read back together; bytes of text in a file, about.
UNIT, UNIT_TOKENS, SHARD_BYTES = 2000, 4 << 20, 256 << 20


class EliasFano:
    """A non-decreasing sequence of n numbers below u, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def build(cls, values: np.ndarray, u: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(np.floor(np.log2(max(u, 1) / n)))) if n else 0
        v = values.astype(np.uint64)
        bits = np.zeros((n, low_bits), np.uint8)
        for j in range(low_bits):
            bits[:, j] = (v >> np.uint64(j)) & np.uint64(1)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        high = np.packbits(unary, bitorder="little")
        return cls(n, low_bits, np.packbits(bits.reshape(-1), bitorder="little"), high, ones[::SKIP].astype(_mark(len(high))))

    def select(self, i: int) -> int:
        """Number i of the sequence: from the nearest mark on, byte by byte."""
        at, left = int(self.marks[i // SKIP]), i % SKIP
        byte = at >> 3
        window = self.high[byte : byte + 64]
        base = byte << 3
        skip = at - base
        while True:
            ones = np.flatnonzero(np.unpackbits(window, bitorder="little"))
            ones = ones[ones >= skip]
            if left < len(ones):
                place = base + int(ones[left])
                break
            left -= len(ones)
            byte += 64
            base, skip = byte << 3, 0
            window = self.high[byte : byte + 64]
        low = 0
        if self.low_bits:
            a = i * self.low_bits
            part = int.from_bytes(self.low[a >> 3 : (a + self.low_bits + 7) >> 3].tobytes(), "little")
            low = part >> (a & 7) & ((1 << self.low_bits) - 1)
        return (place - i) << self.low_bits | low

    def part(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j - 1, from the mark before i to the mark after j."""
        if j <= i:
            return np.zeros(0, np.int64)
        first, beyond = i // SKIP, (j - 1) // SKIP + 1
        at = int(self.marks[first])
        end = int(self.marks[beyond]) if beyond < len(self.marks) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at >> 3 : (end + 7) >> 3], bitorder="little")) + (at >> 3 << 3)
        place = ones[ones >= at][i - first * SKIP : j - first * SKIP]
        a, b = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a]
        low = (bits.reshape(j - i, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return (place - np.arange(i, j)) << self.low_bits | low


def _mark(unary: int) -> str:
    """Type of a select entry over so many bytes."""
    return "<u4" if unary * 8 <= 1 << 32 else "<u8"


class Stored:
    """A part of an open file that is sliced like an array; each slice is one read."""

    def __init__(self, file, at: int, n: int, kind: str = "u1"):
        self.file, self.at, self.n, self.kind = file, at, n, np.dtype(kind)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, where):
        a, b, _ = (where if isinstance(where, slice) else slice(where, where + 1)).indices(self.n)
        size = self.kind.itemsize
        self.file.seek(self.at + a * size)
        got = np.frombuffer(self.file.read(max(0, b - a) * size), self.kind)
        return got if isinstance(where, slice) else got[0]


class TokenFile:
    """One shard, open: nothing but its foot is read before it is asked for."""

    def __init__(self, file):
        size = file.seek(0, 2)
        foot = struct.calcsize(FOOT)
        if size < foot:
            raise ValueError("not a token file")
        file.seek(size - foot)
        magic, width, low_bits, self.docs, self.tokens, unary, marks = struct.unpack(FOOT, file.read(foot))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ids = Stored(file, 0, self.tokens, f"<u{width}")
        at = self.tokens * width
        low = Stored(file, at, (self.docs * low_bits + 7) // 8)
        high = Stored(file, at + len(low), unary)
        self.ends = EliasFano(self.docs, low_bits, low, high, Stored(file, at + len(low) + unary, marks, _mark(unary)))

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Where documents i to j - 1 begin and end: j - i + 1 places."""
        return self.ends.part(i - 1, j) if i else np.append(0, self.ends.part(0, j))

    def document(self, i: int) -> np.ndarray:
        a = self.ends.select(i - 1) if i else 0
        return self.ids[a : self.ends.select(i)]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", width: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the files below folder (any URI that pyarrow opens, shared by all executors).

    Returns the units, one row for each run of documents that is read together: shard, file,
    first (its first document's number there), docs, tokens, keys, start (tokens of all
    shards before). width: bytes an id; by default 2 if the vocabulary allows it, else 4.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    where = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    fsys, base = _open(where)
    fsys.create_dir(base, recursive=True)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    ordered = rows.repartitionByRange(shards, F.col("key").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("tie"))

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = PieceEncoder.of(tokenizer)
        wide = width or (2 if encoder.largest_id < 1 << 16 else 4)
        if encoder.largest_id >= 1 << 8 * wide:
            raise ValueError(f"ids up to {encoder.largest_id} do not fit in {wide} bytes")
        fsys, base = _open(where)
        name = f"shard-{shard:06d}"
        temp, body = f"{base}/.{name}-{uuid.uuid4().hex}", None
        lengths, keys, first, tokens = [], [], 0, 0

        def unit():
            nonlocal keys, first, tokens
            row = {"shard": pa.array([shard], pa.int32()), "file": pa.array([f"{name}.tok"]), "first": pa.array([first], pa.int64()), "docs": pa.array([len(lengths) - first], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "keys": pa.ListArray.from_arrays(pa.array([0, len(lengths) - first], pa.int32()), pa.concat_arrays(keys))}
            keys, first, tokens = [], len(lengths), 0
            return pa.RecordBatch.from_pydict(row)

        for whole in batches:
            for batch in K.blocks(whole, "text"):
                key_column = batch.column(batch.schema.get_field_index("key"))
                body = body or fsys.open_output_stream(temp)
                for i, got in enumerate(encoder.encode_all(batch.column(batch.schema.get_field_index("text")).to_pylist())):
                    got += END_MARK
                    body.write(np.frombuffer(got, "<u4").astype(f"<u{wide}").tobytes())
                    lengths.append(len(got) // 4)
                    tokens += len(got) // 4
                    keys.append(key_column.slice(i, 1))
                    if len(lengths) - first == UNIT or tokens >= UNIT_TOKENS:
                        yield unit()
        if body is None:
            return
        if len(lengths) > first:
            yield unit()
        ends = np.cumsum(np.array(lengths, np.int64))
        ef = EliasFano.build(ends, int(ends[-1]) + 1)
        for part in (ef.low, ef.high, ef.marks):
            body.write(part.tobytes())
        body.write(struct.pack(FOOT, MAGIC, wide, ef.low_bits, len(lengths), int(ends[-1]), len(ef.high), len(ef.marks)))
        body.close()
        fsys.move(temp, f"{base}/{name}.tok")

    made = ordered.select("key", "text").mapInArrow(lean(run, encodes=True), f"shard int, file string, first bigint, docs bigint, tokens bigint, keys array<{kind}>")
    made.write.parquet(f"{where}/_keys")
    found = spark.read.schema(made.schema).parquet(f"{where}/_keys")
    starts, before = [], 0
    for r in found.groupBy("shard").agg(F.sum("tokens").alias("n")).orderBy("shard").collect():  # one row a file
        starts.append((r["shard"], before))
        before += r["n"]
    return found.join(F.broadcast(spark.createDataFrame(starts, "shard int, start bigint")), "shard")


def read(units: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32 and, if asked for, ids."""
    spark = units.sparkSession
    where = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    kind = units.schema["keys"].dataType.elementType.simpleString()

    def run(batches):
        fsys, base = _open(where)
        for batch in batches:
            for row in range(batch.num_rows):
                name, start, first, n = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ("file", "start", "first", "docs"))
                keys = batch.column(batch.schema.get_field_index("keys"))[row].values
                with fsys.open_input_file(f"{base}/{name}") as f:
                    shard = TokenFile(f)
                    at = shard.bounds(first, first + n)
                    held = shard.ids[int(at[0]) : int(at[-1])].astype("<u4")
                cut = at - at[0]
                parts = [held[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                columns = {"key": keys, "start": pa.array(at[:-1] + start), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
                if ids:
                    columns["ids"] = pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    n = units.count()
    tasks = max(min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), n // 64, 1)
    return units.repartition(tasks).mapInArrow(lean(run), f"key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if ids else ""))


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    folder = shared_path(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer, folder, key, text), folder)
