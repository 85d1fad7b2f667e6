"""Queries whose work is a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sdkatlas.plans import corpus, manifest
from sdkatlas.plans.registry import query
from sdkatlas.plans.render_queries import metadata_of
from sdkatlas.operators.render import render_rules
from sdkatlas.session import ensure_checkpoint_dir, saved
from sdkatlas.streaming import arrivals, refresh


def events_as(events, event_type, ts):
    return events.filter(F.col("event_type") == event_type).select(
        F.concat(F.lit("c"), "user_id").alias("origin_commit"), F.col("ts").alias(ts))


WAIT_HOURS = 6


@query("late_spec", f"""with s as (select distinct 'c' || user_id as origin_commit, ts as sdk_ts from events where event_type = 'signup'),
      v as (select 'c' || user_id as origin_commit, ts as spec_ts from events where event_type = 'view')
    select s.origin_commit, sdk_ts, min(spec_ts) as spec_ts, case when min(spec_ts) is null then 'timed_out' else 'arrived' end as status
    from s left join v on s.origin_commit = v.origin_commit and spec_ts between sdk_ts and sdk_ts + interval {WAIT_HOURS} hours
    group by s.origin_commit, sdk_ts""")
def late_spec(spark, sf):
    """Runs as a stream over all events. One event of either kind long after the last, with no user, moves the watermark past every wait."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/late-spec-{uuid.uuid4().hex}"
    events = corpus.table(spark, sf, "events")
    kinds = F.explode(F.array(F.lit("signup"), F.lit("view"))).alias("event_type")
    closing = events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select("ts", kinds)
    closing.write.parquet(f"{place}/closing")
    arriving = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")  # as a pattern, it may be a file or a folder
    last = spark.readStream.schema(closing.schema).parquet(f"{place}/closing")
    stream = arriving.select("ts", "event_type", "user_id").union(last.select("ts", "event_type", F.lit(None).cast("bigint")))
    settled = arrivals.late_specs(events_as(stream, "signup", "sdk_ts"), events_as(stream, "view", "spec_ts"), wait_seconds=WAIT_HOURS * 3600)
    (settled.writeStream.format("parquet").option("path", f"{place}/settled").option("checkpointLocation", f"{place}/stream")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(settled.schema).parquet(f"{place}/settled").filter("origin_commit is not null")


def contract_artifacts(spark, sf):
    """build(repos) for the contract corpus: each repo's contract and its manifest, from those repos' parts alone."""
    def build(repos):
        specs = saved(corpus.contract_documents(spark, sf, repos))
        languages = corpus.contract_languages(spark, sf, repos)
        examples = manifest.matched_examples(specs, corpus.contract_mappings(spark, sf, repos), languages)
        documents = manifest.manifest_documents(manifest.manifest_rows(examples, metadata_of(languages)), render_rules(spark))
        return (specs.select("repo_id", F.lit("spec").alias("artifact"), F.col("doc").alias("payload"))
                .unionByName(documents.select("repo_id", F.lit("manifest").alias("artifact"), F.col("document").alias("payload"))))

    return build


@query("refresh", """select distinct p_partkey // 50 as repo_id, artifact, cast(1 as bigint) as versions from part, (values ('spec'), ('manifest')) a(artifact)""")
def refresh_query(spark, sf):
    """The stream is run twice over the same arrivals; the second run finds nothing to write."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/refresh-{uuid.uuid4().hex}"
    schema = corpus.table(spark, sf, "part").schema
    for run in range(2):
        parts = spark.readStream.schema(schema).parquet(f"{sf}/part.parque[t]")  # as a pattern, it may be a file or a folder
        touched = parts.select(F.floor(F.col("p_partkey") / corpus.PARTS_PER_DOC).alias("repo_id"))
        # A new checkpoint makes the second run see all arrivals again; its batches come after the first's.
        first = refresh.next_batch(spark, f"{place}/store")
        shifted = lambda batch, batch_id, base=first: refresh.publish(batch, base + batch_id, f"{place}/store", contract_artifacts(spark, sf))
        (touched.writeStream.foreachBatch(shifted).option("checkpointLocation", f"{place}/stream-{run}")
         .trigger(availableNow=True).start().awaitTermination())
    return (refresh.stored(spark, f"{place}/store").groupBy("repo_id", "artifact").agg(F.count("*").alias("versions")))
