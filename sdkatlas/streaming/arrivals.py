"""SDK commits that wait for their contract to be published: the first publication within the wait ends it.

One row for each commit `(origin_commit, sdk_ts)`. On tables that is an outer join under a minimum. On streams it is keyed state with an
event-time timer: a commit is settled as soon as no earlier publication than the best one can still come, or when its wait
is over. State is the commits that wait, and publications that one which may still come could use; both go with the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS = 1_000_000
_SETTLED = "origin_commit string, sdk_us long, spec_us long"
_STATE = "waiting string, published string"


def settle(waiting: list[int], published: list[int], watermark: int, wait: int) -> tuple[list[tuple[int, int | None]], list[int], list[int], int | None]:
    """What is certain once no event before `watermark` can come: (sdk, spec or None) rows, the commits that still wait, the publications
    that may still be needed, and when to look again. All in microseconds."""
    rows, open_, times = [], [], []
    published = sorted(set(published))
    for sdk in sorted(set(waiting)):
        best = next((p for p in published if sdk <= p <= sdk + wait), None)
        decided = best if best is not None else sdk + wait + 1
        if decided < watermark:  # and the commit itself cannot come again
            rows.append((sdk, best))
        else:
            open_.append(sdk)
            times.append(decided)
    # a publication serves the commits that wait, and those to come, which are not before the watermark
    needed = [p for p in published if p >= watermark or any(sdk <= p <= sdk + wait for sdk in open_)]
    times += needed[-1:] if not open_ else []
    return rows, open_, needed, min(times) if times else None


def _settled_stream(events: DataFrame, wait: int) -> DataFrame:
    """`events(origin_commit, ts, us, is_spec)`, a stream with a watermark on ts."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, published = map(json.loads, state.get) if state.exists else ([], [])
        for batch in batches:
            us, is_spec = batch["us"], batch["is_spec"]
            waiting += us[~is_spec].tolist()
            published += us[is_spec].tolist()
        rows, waiting, published, again = settle(waiting, published, state.getCurrentWatermarkMs() * 1000, wait)
        if again is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(waiting), json.dumps(published)))
            state.setTimeoutTimestamp(max(again // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame({"origin_commit": key[0], "sdk_us": [r[0] for r in rows], "spec_us": pd.array([r[1] for r in rows], dtype="Int64")})

    return events.groupBy("origin_commit").applyInPandasWithState(step, _SETTLED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def late_specs(sdk_commits: DataFrame, specs: DataFrame, wait_seconds: int = 300, delay: str = "60 seconds") -> DataFrame:
    """Each SDK commit with the first contract published within the wait, or as timed out.

    `sdk_commits(origin_commit, sdk_ts)` and `specs(origin_commit, spec_ts)` are two tables or two streams; a commit or publication that
    occurs twice counts once. On streams, `delay` is how late an event may come, and rows come in append mode.
    """
    status = F.when(F.col("spec_ts").isNull(), "timed_out").otherwise("arrived")
    if not sdk_commits.isStreaming:
        publication = specs.select(F.col("origin_commit").alias("spec_commit"), "spec_ts")
        in_time = (F.col("origin_commit") == F.col("spec_commit")) & F.col("spec_ts").between(
            F.col("sdk_ts"), F.col("sdk_ts") + F.expr(f"interval {wait_seconds} seconds"))
        first = sdk_commits.join(publication, in_time, "left_outer").groupBy("origin_commit", "sdk_ts").agg(F.min("spec_ts").alias("spec_ts"))
        return first.withColumn("status", status)
    kind = sdk_commits.schema["sdk_ts"].dataType

    def side(rows, ts, is_spec):
        # Watermarks of their own: the slower stream holds both back.
        return (rows.select("origin_commit", F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)
                .select("origin_commit", "ts", F.unix_micros("ts").alias("us"), F.lit(is_spec).alias("is_spec")))

    events = side(sdk_commits, "sdk_ts", False).union(side(specs, "spec_ts", True))
    moment = lambda us: F.timestamp_micros(us).cast(kind)
    return (_settled_stream(events, wait_seconds * MICROS)
            .select("origin_commit", moment("sdk_us").alias("sdk_ts"), moment("spec_us").alias("spec_ts")).withColumn("status", status))
