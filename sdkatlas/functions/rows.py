"""Row shaping helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shuffled bytes that adaptive execution may put together into one task. They are compressed: sorted and grouped they take some 15 to 50 times as much.
TASK_BYTES = 8 << 20
#: Rows of a task where a step deals out rows by their number.
TASK_ROWS = 200_000


def bounded_tasks(rows: DataFrame) -> DataFrame:
    """`rows`, after the bytes that adaptive execution puts together into one task were bounded by TASK_BYTES (a smaller bound stays).

    By default it goes for as few tasks as there are cores, up to 64 MB each, so a task's memory grows with the input until then. The bound is
    Spark's own setting and stays set, since a frame is run after the call that makes it.
    """
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    now = re.fullmatch(r"(\d+)([bkmgt]?)b?", rows.sparkSession.conf.get(key).strip().lower())
    if not now or int(now[1]) << 10 * "bkmgt".index(now[2] or "b") > TASK_BYTES:
        rows.sparkSession.conf.set(key, str(TASK_BYTES))
    return rows


def task_count(rows: DataFrame) -> int:
    """Tasks for `rows` (saved before, as they are counted) of some TASK_ROWS each."""
    return max(1, -(-rows.count() // TASK_ROWS))


def joined(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """An equi-join of two tables that both grow with the input: shuffled and merged, never broadcast.

    Left to itself, adaptive execution broadcasts a side whose shuffled bytes are few. Those bytes are compressed: repeated
    texts and schema nodes are ten times as large and more once the driver has built the relation from them, and a plan with many
    joins builds many at a time.
    """
    return bounded_tasks(left).join(right.hint("merge"), on, how)


def keep(rows: DataFrame, columns: list[str], record: Column) -> DataFrame:
    """`columns` plus the fields of `record`, for rows where `record` is not NULL.

    A filter on a computed column is pushed below the projection that computes it, so the work is
    done twice. A generator is a barrier to that.
    """
    return rows.select(*columns, F.inline(F.array_compact(F.array(record))))
