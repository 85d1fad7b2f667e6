"""Host-level quality rules: rule failures by host, rates shrunk with an empirical beta prior, host verdicts joined back to documents.

Per document the words, symbols, repeated lines and repeated word windows are counted over the whole text. Failures are summed by host
(`source`), a beta prior is fitted to all hosts by moments, and a host whose shrunk failure rate reaches the threshold is not kept.

Null text: no words, so the base rules fail. Null source: one host of its own. Repeated rows count as often as they occur. An empty table
gives an empty result. Every row comes back, whatever further columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.llm import common

MIN_WORDS, REPEAT_SHARE, WINDOW = 20, 30, 8
#: A host is rejected if its shrunk share of failing documents is at least this.
HOST_THRESHOLD = 0.6
WHITE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of eight words that occur at least twice."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    n = len(ids) - window + 1
    mixed = np.zeros(n, dtype=np.uint64)  # a cheap first look: no two equal hashes, no two equal windows
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    for i in range(window):
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + spread[i:i + n]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    ranks, step = ids, 1
    while step < window:  # exact: doubling, each step numbers the windows of twice the length
        ranks = _ranks(ranks[:-step], ranks[step:])
        step *= 2
    found = np.bincount(ranks)[ranks] > 1
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(found)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts(data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()
    characters = len(data.decode("utf-8")) - (len(data) - len(data.translate(None, WHITE)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), characters, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    common.held(None)
    names = [c.split()[0] for c in COUNTS.split(", ")]
    for batch in batches:
        yield pd.DataFrame([counts(d) for d in batch], columns=names, dtype="int64")


def text_counts(text: Column) -> Column:
    return F.pandas_udf(_counts, COUNTS)(common.utf8(text))


def with_base_rules(rows: DataFrame) -> DataFrame:
    """The five counts and base_failed beside the columns that the frame has; `_counts` must be one of them."""
    counted = rows.select(*[c for c in rows.columns if c != "_counts"], "_counts.*")
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words")))


def host_verdicts(rows: DataFrame, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """host, documents, failures, rate (shrunk), host_kept. The prior's two moments are the only numbers that the driver sees."""
    hosts = common.saved(rows.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col(failed).cast("long")).alias("failures")), "hosts")
    share = F.col("failures") / F.col("documents")
    mean, variance, inverse = hosts.agg(F.avg(share), F.var_pop(share), F.avg(1 / F.col("documents"))).first()
    mean = min(max(mean if mean is not None else 0.5, 1e-3), 1 - 1e-3)
    # what the hosts' rates scatter beyond the scatter of a share of so few documents
    between = max((variance or 0.0) - mean * (1 - mean) * (inverse or 0.0), 1e-5)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1000.0)
    rate = (F.col("failures") + mean * strength) / (F.col("documents") + strength)
    return hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") < HOST_THRESHOLD)


def judged(rows: DataFrame) -> DataFrame:
    """rows (source, base_failed and more, saved before) with `kept`. Rejected hosts alone are joined: broadcast after a check of their
    number, else by a shuffle in which adaptive execution splits a hot host."""
    bad = common.saved(host_verdicts(rows).filter(~F.col("host_kept")).select(F.col("host").alias("_host"), F.lit(True).alias("_bad")), "bad-hosts")
    joined = rows.join(common.small(bad), rows["source"].eqNullSafe(F.col("_host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_host", "_bad")


def quality_rules(documents: DataFrame) -> DataFrame:
    counted = with_base_rules(documents.select("doc_id", "source", text_counts(F.col("text")).alias("_counts")))
    return judged(common.saved(counted, "quality")).drop("source")


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that the rules and their host's verdict keep, with their own columns."""
    names = common.bounded_batches(documents).columns
    counted = with_base_rules(documents.select(F.struct(*names).alias("_doc"), F.col("source"), text_counts(F.col("text")).alias("_counts")))
    kept = judged(common.saved(counted, "quality")).filter("kept")
    return kept.select("_doc.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"))


#: The same in SQL.
SQL = """
with words as (
  select row_number() over () as r, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (
  select r, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') as g from (select r, w, unnest(range(1, len(w) - 6)) as i from words where len(w) > 8)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as n from windows) where n > 1),
repeated as (select r, count(distinct i + k) as n from again, (select unnest(range(0, 8)) as k) group by r),
lines as (
  select r, count(*) - count(distinct l) as n
  from (select r, unnest(string_split(coalesce(text, ''), chr(10))) as l from words) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by r),
counted as (
  select r, doc_id, source, cast(len(w) as bigint) as n_words, cast(length(list_aggregate(w, 'string_agg', '')) as bigint) as word_chars,
    cast(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(lines.n, 0) as bigint) as n_dup_lines, cast(coalesce(repeated.n, 0) as bigint) as n_repeat_words
  from words left join lines using (r) left join repeated using (r)),
base as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted),
hosts as (select source, count(*) as d, sum(base_failed::int) as f from base group by source),
moments as (select least(greatest(avg(f / d), 1e-3), 1 - 1e-3) as m, var_pop(f / d) as v, avg(1 / d) as k from hosts),
prior as (select m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * k, 1e-5) - 1, 1), 1000) as s from moments),
verdicts as (select source, (f + m * s) / (d + s) < 0.6 as host_kept from hosts, prior)
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and host_kept as kept
from base join verdicts on base.source is not distinct from verdicts.source
"""
