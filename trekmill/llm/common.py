"""Session helpers of the text operators: shared tables, Arrow batch sizes, folds."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints"
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a default where it is unset and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or DEFAULT_SHARED).rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/trekmill/{tag}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clear)
    _MADE.append((spark, path))
    return path


def _clear() -> None:
    while _MADE:
        spark, path = _MADE.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, PERF203  the session has ended already
            return


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, tag: str, rows: int | None = None, each: int = 50_000) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and no lost executor takes it along.

    rows: a bound of its rows where one is known; then it has a file for each so many, and
    small tables are not written as one file a shuffle partition.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._trekmill_path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table that written() gave and that nothing reads any more."""
    path = getattr(table, "_trekmill_path", None)
    if path:
        spark = table.sparkSession
        _MADE.remove((spark, path))
        _delete(spark, path)


def lean(run: Callable[[Iterator], Iterator], encodes: bool = False) -> Callable[[Iterator], Iterator]:
    """run, after which a worker gives freed memory back, as it waits beside others for its next task.

    encodes: run is one of the tasks that share the encoders of tokens; before any other, a worker lets go of them.
    """

    @wraps(run)
    def inner(batches: Iterator) -> Iterator:
        if not encodes:
            _let_go()
        yield from run(batches)
        _trim()

    return inner


def _let_go() -> None:
    """Drops the encoders, and the pieces they know, that earlier tasks have left in this process."""
    tokens = sys.modules.get("trekmill.llm.tokens")
    if tokens and tokens._LOADED:
        tokens._LOADED.clear()
        _trim()


def _trim() -> None:
    gc.collect()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_batches(spark: SparkSession, rows: int = 2000, mb: int = 8) -> None:
    """Bounds what is handed to Python at once by rows and bytes, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n (null where the key is)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches, keys: tuple[str, ...]):
    """Tables of whole groups (rows of equal keys, which come one after the other), with the bounds of each."""
    rest, ended, batches = None, False, iter(batches)
    while not ended:
        batch = next(batches, None)
        ended = batch is None
        parts = [x for x in (rest, None if ended else pa.Table.from_batches([batch])) if x is not None]
        if not parts:
            continue
        table = pa.concat_tables(parts).combine_chunks()
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows - 1, bool)
        for c in keys:
            x = table.column(c).to_numpy()
            change |= x[1:] != x[:-1]
        edge = np.flatnonzero(np.r_[True, change, True])
        rest = None
        if not ended:
            rest, edge = table.slice(edge[-2]), edge[:-1]
        if len(edge) > 1:
            yield table.slice(0, edge[-1]).combine_chunks(), edge
