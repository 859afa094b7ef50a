"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.ship import ship

#: ASCII white space of the word rule `[^\x20\x09-\x0D]+`; bytes.split() splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch handed to Python; keeps a batch of long texts small.
BATCH_ROWS = 1000

#: Threads of the tokenizers libraries in each Python worker.
THREADS = 2
os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))

_FOLDERS: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Ready the session for Python stages: small Arrow batches unless their size was set on purpose, and this package
    sent to the executors, who may not have it installed."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_ROWS))
    ship(spark)


def scratch(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir. Only a local session may do without it, in a folder of its own."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"gridloom-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def packed(docs: DataFrame, **derived: Column) -> DataFrame:
    """docs with all its columns in one struct `row` beside derived columns, so that no name of docs can clash; row.* unpacks it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in derived.items()))


#: Hot keys are those with more rows than this and than one in HOT_KEYS of all rows; so there are less than HOT_KEYS.
HOT_ROWS, HOT_KEYS = 1000, 50_000


def join_spread(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined to side, which has one row for each key and, as `n`, the number of rows with that key.

    Rows of hot keys meet their side by broadcast, of less than HOT_KEYS rows whatever the input's size, so that no task
    gets all rows of one key; the others shuffle. how: inner or left. `n` isn't in the result.
    """
    total = side.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = cut(side.filter(F.col("n") > limit).drop("n"))
    rest = side.filter(F.col("n") <= limit).drop("n")
    if hot.isEmpty():
        return rows.join(rest, on, how)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and go on from the written rows; the folder ends with the application."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder; it is removed when Python ends."""
    path = f"{scratch(spark).rstrip('/')}/gridloom-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a written table that is no longer needed."""
    with contextlib.suppress(Exception):  # the session may have ended before
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def by_key(batches: Iterator[pa.RecordBatch], key: str, least: int = 1) -> Iterator[pa.Table]:
    """Cut a stream sorted by an integer key into tables of at least so many rows that hold whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        start = int(np.searchsorted(keys, keys[-1], side="left"))
        if size + start >= least and (start or (held and last != keys[-1])):
            yield pa.Table.from_batches([*held, batch.slice(0, start)] if start else held)
            held, size = [], 0
            batch = batch.slice(start)
        held.append(batch)
        size += batch.num_rows
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


_KEPT: list = []


def kept(make: Callable) -> Callable:
    """make with its last two results kept in the worker for all its tasks, until forget()."""
    held = functools.lru_cache(2)(make)
    _KEPT.append(held)
    return held


def forget() -> None:
    """Let go of what kept() functions hold: a worker that goes on to another operator's tasks has its memory for them."""
    if any(held.cache_info().currsize for held in _KEPT):
        for held in _KEPT:
            held.cache_clear()
        with contextlib.suppress(AttributeError, OSError):  # glibc's; else its freed memory stays with the process
            ctypes.CDLL(None).malloc_trim(0)


class Memory(dict):
    """Ids of pieces of text: what is remembered, and besides it the long pieces of the texts at hand."""

    #: What an entry costs besides its characters and ids (230 bytes in all, measured over a million pieces).
    ENTRY = 200

    def __init__(self):
        self.long: dict[str, bytes] = {}
        self.size = 0

    def __missing__(self, piece: str) -> bytes:
        return self.long[piece]

    def add(self, pieces: list[str], ids: list[bytes]) -> None:
        self.update(zip(pieces, ids, strict=True))
        self.size += sum(map(len, pieces)) + sum(map(len, ids)) + self.ENTRY * len(ids)


def stretches(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about so many characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def unsigned_hex(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
