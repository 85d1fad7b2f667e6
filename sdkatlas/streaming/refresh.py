"""Contracts and manifests kept up to date as contracts arrive.

A store has four parts below one folder: `batch=N`, the artifacts that batch N changed, `digests/batch=N`, their digests, `snapshots/upto=N`, the latest
digest of every artifact up to batch N, and `log`, one small file for each complete batch. A batch is written in that order, log last, so that
its contract and manifest appear together and a batch that broke off is never seen; what it left behind is overwritten when it is
repeated. Payloads and digests lie in buckets of repos, and a refresh reads the digests of the touched buckets only: those of the
last snapshot and of the few batches after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sdkatlas.session import checkpointed, saved
from sdkatlas.sources.artifacts import to_write, with_digest

KEY = ["repo_id", "artifact"]
#: Buckets of a new store, and batches after which the digests are compacted. The store's log keeps its own number of buckets.
BUCKETS, COMPACT_EVERY = 1024, 16
_STORED = "repo_id bigint, artifact string, digest string, payload string, bucket int"
_DIGESTS = "repo_id bigint, artifact string, digest string, bucket int, batch bigint"
_LOG = "batch bigint, buckets int, snapshot bigint"


@dataclass
class Log:
    """The complete batches of a store. `snapshot` is the last compaction, -1 where there is none."""

    batches: list[int]
    buckets: int
    snapshot: int

    @property
    def after_snapshot(self) -> list[int]:
        return [b for b in self.batches if b > self.snapshot]


def _bucket(repo_id: str, buckets: int) -> Column:
    return F.pmod(F.hash(repo_id), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    """The rows below `paths` that are there; a batch that changed nothing has no files."""
    frame = None
    for path in paths:
        try:
            found = spark.read.schema(schema).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        frame = found if frame is None else frame.unionByName(found)
    return spark.createDataFrame([], schema) if frame is None else frame


def read_log(spark: SparkSession, store: str) -> Log:
    rows = _read(spark, _LOG, [f"{store}/log"]).collect()  # one row a batch
    batches = sorted({r.batch for r in rows})
    return Log(batches, max((r.buckets for r in rows), default=BUCKETS), max((r.snapshot for r in rows), default=-1))


def stored(spark: SparkSession, store: str) -> DataFrame:
    """Every version written by complete batches, with its batch."""
    batches = read_log(spark, store).batches
    try:
        found = spark.read.schema(f"{_STORED}, batch bigint").option("pathGlobFilter", "*.parquet").option("basePath", store).parquet(*[f"{store}/batch={b}" for b in batches]) if batches else None
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    return spark.createDataFrame([], f"{_STORED}, batch bigint") if found is None else found


def next_batch(spark: SparkSession, store: str) -> int:
    """A number above those of all complete batches; a new stream over an old store counts from here."""
    return max(read_log(spark, store).batches, default=-1) + 1


def latest(versions: DataFrame) -> DataFrame:
    """The current digest of each artifact. Reads no payload."""
    return versions.groupBy(*KEY).agg(F.max_by("digest", "batch").alias("digest"))


def digests(spark: SparkSession, store: str, log: Log, buckets: list[int] | None = None) -> DataFrame:
    """The latest digests (repo_id, artifact, digest, bucket, batch) in `buckets` (all where None): the last snapshot under the batches since."""
    paths = [f"{store}/snapshots/upto={log.snapshot}"] if log.snapshot >= 0 else []
    paths += [f"{store}/digests/batch={b}" for b in log.after_snapshot]
    rows = _read(spark, _DIGESTS, paths)
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))  # literals, so the scan lists these partitions only
    newest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("batch")))
    return rows.withColumn("_n", newest).filter("_n = 1").drop("_n")


def compact(spark: SparkSession, store: str, log: Log, upto: int) -> None:
    """One table of the latest digests up to batch `upto`."""
    digests(spark, store, log).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/snapshots/upto={upto}")


def complete(spark: SparkSession, store: str, batch_id: int, buckets: int, snapshot: int) -> None:
    """Note the batch in the log: one file, which is there as a whole or not at all. From here on the batch is seen."""
    row = spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch"), F.lit(buckets).alias("buckets"), F.lit(snapshot).cast("bigint").alias("snapshot"))
    row.coalesce(1).write.mode("append").parquet(f"{store}/log")


def publish(batch: DataFrame, batch_id: int, store: str, build: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY) -> None:
    """Build the artifacts of the repos in `batch` and write those that changed.

    `build(repos)` gives (repo_id, artifact, payload). A batch that is repeated is judged against the batches before it, so it comes out the same.
    """
    spark = batch.sparkSession
    log = read_log(spark, store)
    if log.batches:
        buckets = log.buckets
    earlier = Log([b for b in log.batches if b < batch_id], buckets, log.snapshot if log.snapshot < batch_id else -1)
    repos = checkpointed(batch.select("repo_id").distinct())
    touched = [r[0] for r in repos.select(_bucket("repo_id", buckets).alias("bucket")).distinct().collect()]  # at most `buckets` numbers
    before = digests(spark, store, earlier, touched)
    current = with_digest(build(repos)).withColumn("bucket", _bucket("repo_id", buckets))
    changed = saved(to_write(current, before, KEY))
    place = changed.repartition("bucket")
    place.select("repo_id", "artifact", "digest", "payload", "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{store}/batch={batch_id}")
    own = place.select("repo_id", "artifact", "digest", "bucket", F.lit(batch_id).cast("bigint").alias("batch"))
    own.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/digests/batch={batch_id}")
    snapshot = log.snapshot
    whole = Log([*earlier.batches, batch_id], buckets, earlier.snapshot)
    if snapshot < batch_id and len(whole.after_snapshot) >= compact_every:
        compact(spark, store, whole, batch_id)
        snapshot = batch_id
    if batch_id not in log.batches:
        complete(spark, store, batch_id, buckets, snapshot)


def refresh(arrivals: DataFrame, store: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], **options: int) -> StreamingQuery:
    """Start the refresh of `store` from a stream of `arrivals(repo_id, …)`; handles what is there, then stops."""
    return (arrivals.writeStream.foreachBatch(lambda batch, batch_id: publish(batch, batch_id, store, build, **options))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
