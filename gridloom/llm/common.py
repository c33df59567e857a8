"""Small helpers of the llm operators: table access and Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.runtime import ship

#: Lower-cases A-Z only and leaves every other byte as it is.
LOWER = bytes(range(256)).lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that what a worker holds at once stays bounded."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


#: Bytes of an Arrow batch from the JVM; a session that has a value of its own keeps it.
BATCH_BYTES = 4 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864", "67108864b", "64MB", "64m")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` in small batches: texts of 64 MB at once would stand in the JVM, in its buffers and in the worker."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH_CONF, _BATCH_DEFAULT[0]) in _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def extra_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with results."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype) if b else np.empty(0, dtype)


def small(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in four bytes if they fit."""
    return a.astype(np.uint32) if not len(a) or a.max() < 2**32 else a.astype(np.uint64)


def pack_ints(a: np.ndarray) -> bytes:
    """Byte by byte of all numbers, the lowest first: most upper bytes are zero and take no room so."""
    a = small(a)
    return bytes([a.itemsize]) + pack(a.view(np.uint8).reshape(-1, a.itemsize).T)


def unpack_ints(b: bytes) -> np.ndarray:
    size = b[0]
    raw = unpack(b[1:], np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(np.uint32 if size == 4 else np.uint64).reshape(-1).astype(np.int64)


def private(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under column names of its own, and these by the old ones: nothing that an operator adds can clash with them."""
    names = {c: f"_in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def public(df: DataFrame, names: dict[str, str], made: list[str]) -> DataFrame:
    """The old columns under their old names, then the results; a result whose name is taken gets underscores until it is free."""
    taken, out = set(names), []
    for m in made:
        free = m
        while free in taken:
            free += "_"
        taken.add(free)
        out.append(F.col(f"`{m}`").alias(free))
    return df.select(*[F.col(n).alias(c) for c, n in names.items()], *out)


#: Seconds after its last task for which a worker keeps what it has built.
IDLE = 5.0
_KEPT: dict = {}
_LOCK = threading.Lock()
_USERS = [0, 0]  # now, and ever


@contextmanager
def kept(key, make: Callable):
    """What ``make`` gives, built once a worker and kept from task to task; one thing at a time.

    A worker that has had no task for IDLE seconds gives its memory back, as Spark
    keeps idle workers while other stages need theirs.
    """
    with _LOCK:
        _USERS[0] += 1
        _USERS[1] += 1
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = make()
            gc.collect()
            gc.freeze()  # what is built holds no cycles worth another search
            gc.set_threshold(200_000, 50, 1000)
        thing = _KEPT[key]
    try:
        yield thing
    finally:
        with _LOCK:
            _USERS[0] -= 1
            if not _USERS[0]:
                timer = threading.Timer(IDLE, _given_back, [_USERS[1]])
                timer.daemon = True
                timer.start()


def _given_back(users: int) -> None:
    """Forgets what is kept if no task has come since."""
    with _LOCK:
        if _USERS != [0, users]:
            return
        _KEPT.clear()
        gc.unfreeze()
        gc.collect()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
