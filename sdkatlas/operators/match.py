"""Contract endpoints against extracted SDK calls, per (repo, verb, path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sdkatlas.functions.rows import joined

KEY = ["repo_id", "http_method", "http_path"]


def mapping_index(mappings: DataFrame) -> DataFrame:
    """One mapping per key: the last in (file path, order) wins. Combines before the shuffle."""
    rest = [c for c in mappings.columns if c not in KEY]
    return (mappings.groupBy(KEY)
            .agg(F.max_by(F.struct(*rest), F.struct("path", "ord")).alias("m"))
            .select(*KEY, "m.*"))


def matched(endpoints: DataFrame, index: DataFrame) -> DataFrame:
    """Endpoints with their mapping."""
    return joined(endpoints, index, KEY)


def unmatched(endpoints: DataFrame, mappings: DataFrame) -> DataFrame:
    return joined(endpoints, mappings.select(KEY), KEY, "left_anti")


def orphans(endpoints: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mappings the contract does not cover, repeated ones included."""
    return joined(mappings, endpoints.select(KEY), KEY, "left_anti")


def coverage(endpoints: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per repo: contract endpoints, matched, unmatched, SDK calls, orphans.

    Both sides are counted per key first. That sum combines before its shuffle, so a key or a repo
    with a large share of all rows arrives as few rows.
    """
    side = lambda rows, spec: rows.select(*KEY, F.lit(spec).cast("bigint").alias("spec"), F.lit(1 - spec).cast("bigint").alias("sdk"))
    per_key = side(endpoints, 1).unionByName(side(mappings, 0)).groupBy(KEY).agg(
        F.sum("spec").alias("spec"), F.sum("sdk").alias("sdk"))
    hit = lambda count, other: F.sum(F.when(F.col(other) > 0, F.col(count)).otherwise(0))
    return per_key.groupBy("repo_id").agg(
        F.sum("spec").alias("total"), hit("spec", "sdk").alias("matched"),
        (F.sum("spec") - hit("spec", "sdk")).alias("unmatched"),
        F.sum("sdk").alias("sdk_endpoints"), (F.sum("sdk") - hit("sdk", "spec")).alias("orphans"))


def coverage_totals(per_repo: DataFrame, languages: DataFrame) -> DataFrame:
    """Coverage by language and over the corpus."""
    counts = ["total", "matched", "unmatched", "sdk_endpoints", "orphans"]
    return (per_repo.join(languages.select("repo_id", "language"), "repo_id")
            .rollup("language").agg(F.count("*").alias("repos"), *[F.sum(c).alias(c) for c in counts]))


def join_status(per_repo: DataFrame) -> DataFrame:
    """Both sides present but nothing aligned is an error."""
    broken = (F.col("matched") == 0) & (F.col("total") > 0) & (F.col("sdk_endpoints") > 0)
    return per_repo.withColumn("status", F.when(broken, "no_match").otherwise("ok"))


def extraction_status(client_files: DataFrame, mappings: DataFrame) -> DataFrame:
    """Client files without a single endpoint are an error: the generated code changed its shape.

    `client_files(repo_id, is_client)` lists every file of the repos to report on.
    """
    files = client_files.groupBy("repo_id").agg(F.count_if("is_client").alias("client_files"))
    found = mappings.groupBy("repo_id").agg(F.count("*").alias("endpoints"))
    endpoints = F.coalesce("endpoints", F.lit(0))
    status = (F.when(F.col("client_files") == 0, "no_client_files")
              .when(endpoints == 0, "no_endpoints").otherwise("ok"))
    return (joined(files, found, "repo_id", "left")
            .select("repo_id", "client_files", endpoints.alias("endpoints"), status.alias("status")))


def file_status(client_files: DataFrame, mappings: DataFrame) -> DataFrame:
    """The same for each client file: a single file whose shape changed does not hide behind the others of its repo."""
    found = mappings.groupBy("repo_id", "path").agg(F.count("*").alias("endpoints"))
    endpoints = F.coalesce("endpoints", F.lit(0))
    return (joined(client_files.filter("is_client").select("repo_id", "path"), found, ["repo_id", "path"], "left")
            .select("repo_id", "path", endpoints.alias("endpoints"), F.when(endpoints == 0, "no_endpoints").otherwise("ok").alias("status")))


def examples(matched_rows: DataFrame) -> DataFrame:
    """Request and response bodies as JSON text; a streaming endpoint has no response body, only the flag."""
    null = F.lit("null")
    return (matched_rows
            .withColumn("request_body", F.coalesce("request_example", null))
            .withColumn("response_body", F.when(F.col("is_streaming"), null).otherwise(F.coalesce("response_example", null)))
            .withColumn("streaming", F.when(F.col("is_streaming"), F.lit(True))))
