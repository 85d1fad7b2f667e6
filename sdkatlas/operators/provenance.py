"""Does each contract come from the commit its SDK was generated from?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _missing(text: Column) -> Column:
    """The word 'null' is what a missing field reads as."""
    return text.isNull() | text.isin("", "null")


def audit(metadata: DataFrame, specs: DataFrame) -> DataFrame:
    """First failing check per repo. `metadata(repo_id, origin_commit)`, `specs(repo_id, doc)`."""
    found = specs.select("repo_id", F.lit(True).alias("has_spec"), F.get_json_object("doc", "$.info.version").alias("spec_version"))
    status = (F.when(F.col("has_spec").isNull(), "spec_missing")
              .when(_missing(F.col("origin_commit")), "commit_missing")
              .when(_missing(F.col("spec_version")), "version_missing")
              .when(F.col("spec_version") != F.col("origin_commit"), "mismatch").otherwise("ok"))
    return (metadata.select("repo_id", "origin_commit").join(found, "repo_id", "left")
            .select("repo_id", "origin_commit", "spec_version", status.alias("status")))


def spec_lookup(metadata: DataFrame, published: DataFrame) -> DataFrame:
    """Contract by origin commit: ready, pending (not published yet) or invalid (no commit).

    `published(origin_commit, doc)` may hold one commit several times.
    """
    about = metadata.select("repo_id", "origin_commit")
    has_commit = ~_missing(F.col("origin_commit"))
    # Repos without a commit would all meet on one key, so they stay out of the join.
    invalid = about.filter(~has_commit).withColumn("status", F.lit("invalid"))
    available = published.select("origin_commit").distinct().withColumn("is_published", F.lit(True))
    looked_up = (about.filter(has_commit).join(available, "origin_commit", "left")
                 .select("repo_id", "origin_commit", F.when(F.col("is_published"), "ready").otherwise("pending").alias("status")))
    return looked_up.unionByName(invalid)
