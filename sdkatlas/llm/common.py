"""Shared helpers of the training-data operators: tables, folds, intermediate tables, bounded broadcasts."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many narrow rows (some 20 bytes each, so 40 MB) may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: An Arrow batch of whole texts that a step of the pipeline sends to Python; a task holds a few copies of it (rows, Arrow, Python, the next one).
BATCH_BYTES = 4 << 20
#: ASCII letters only: the contracts lower-case A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers also get the folder of this package, for local sessions that did not install it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), one beside the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/llm-intermediate"


def saved(rows: DataFrame, label: str) -> DataFrame:
    """Write `rows` as a table in the shared folder and read it back: its lineage ends there, and a lost executor costs no rerun.
    Every call has a folder of its own, whose lifetime is that of the checkpoint folder."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def bounded_batches(rows: DataFrame) -> DataFrame:
    """`rows`, after the session's Arrow batches were bounded by BATCH_BYTES (a smaller bound stays): what tasks hold follows neither the number
    of rows in a batch nor their length. The bound is Spark's own setting and stays set, since a frame is run after the call that makes it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", rows.sparkSession.conf.get(key))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        rows.sparkSession.conf.set(key, str(BATCH_BYTES))
    return rows


def small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` (narrow, and saved before) hinted for broadcast if there are at most `limit` of them, else as they are."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def fold(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo `buckets`; a null key is in no fold (null)."""
    return F.crc32(key.cast("string").cast("binary")) % buckets


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def utf8(text: Column) -> Column:
    """The text as UTF-8 bytes, empty for null: what the Python helpers work on."""
    return F.coalesce(text, F.lit("")).cast("binary")


_held: dict[str, object] = {}


def held(name: str | None, make: Callable[[], object] | None = None):
    """A table that a Python worker keeps from one task to the next, made where there is none. A worker holds those of one name only: tasks of
    another operator free what the one before left (None: free it and hold nothing)."""
    if name not in _held:
        _held.clear()
        if name is not None:
            _held[name] = make()
    return _held.get(name)


def texts(values: Iterable[str | None]) -> pd.Series:
    """A column of strings as plain objects, which every Arrow conversion takes."""
    return pd.Series(list(values), dtype=object)


def share(rows: DataFrame, key: str, bound: int, total: int) -> DataFrame:
    """About `bound` of `total` rows, chosen by a hash of the key: the same rows on every run, spread over the whole table."""
    if total <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < int(bound / total * (1 << 30)))
