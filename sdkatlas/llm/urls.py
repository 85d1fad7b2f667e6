"""URL filters: rules first, then host words by unigram Viterbi and multinomial naive Bayes over host and path tokens.

Host labels are concatenated words. Word counts come from the text of all pages; the Viterbi search splits a label into the likeliest words,
unknown stretches costing more the longer they are. Naive Bayes learns from the pages that a rule decides, and from nothing
else; it judges the pages that no rule fits. All words and all tokens count: those outside the broadcast ones are joined by a shuffle.

Null url or one without `://`: empty host and path, no rule, verdict allow. Ties of naive Bayes are allow. Empty table: empty result.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.llm import common

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with its own.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
VOCABULARY = 50_000  # the commonest words, which are broadcast for the search (2 MB at most); others are joined with the parts of hosts
TOKENS_KEPT = 100_000  # the commonest tokens, which are broadcast with their odds; others are joined with the pages' tokens
HOSTS_SENT = 200_000  # a table of at most this many hosts may be broadcast
HOST, PATH = "host:", "path:"
LETTERS = re.compile("[a-z]+")
SPLIT = re.compile(r"[^a-z0-9\x80-\U0010ffff]+")


@dataclass
class Model:
    tokens: dict[str, float]  # log odds of block, of the commonest tokens
    prior: float
    unseen: float
    whole: bool  # no other token has counts


def parts(url: str) -> tuple[Column, Column]:
    """host and path: after the first :// up to / ? # or the end; then up to ? or #."""
    found = F.coalesce(F.locate("://", F.col(url)), F.lit(0)) > 0
    rest = F.substring(F.col(url), F.locate("://", F.col(url)) + 3, F.length(url))
    host = common.ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(found, host).otherwise(F.lit("")), F.when(found, path).otherwise(F.lit(""))


def with_rules(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict): the longest rule that fits, else nulls."""
    host, path = parts("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in reversed(ordered):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rows.select("*", rule.alias("rule"), verdict.alias("ruled"))


def page_words(pages: DataFrame) -> DataFrame:
    """word, n: ASCII words of the pages' html outside tags, counted over all pages."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        word, tag = re.compile(rb"[a-z]+"), re.compile(rb"<[^>]*>")
        for batch in batches:
            for html in batch["html"]:
                for w in word.findall(tag.sub(b" ", html).lower()):
                    seen[w] = seen.get(w, 0) + 1
            if len(seen) > 200_000:
                yield pd.DataFrame({"word": common.texts(w.decode() for w in seen), "n": list(seen.values())})
                seen = {}
        yield pd.DataFrame({"word": common.texts(w.decode() for w in seen), "n": list(seen.values())})

    rows = pages.select(common.utf8(F.col("html")).alias("html"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segment(label: str, words: Mapping[str, float], lengths: list[int] | None = None) -> list[str]:
    """The likeliest split of a label into words of any of `lengths` (ascending; those of `words` where None); a stretch of unknown letters, however
    long, costs a word and more for each letter. Of equal splits, that with the latest last word."""
    lengths = sorted({len(w) for w in words}) if lengths is None else lengths
    best: list[tuple[float, int]] = [(0.0, 0)]
    unknown = (0.0, 0)  # where an unknown stretch best begins: cost there, plus what the letters before it would have cost
    for end in range(1, len(label) + 1):
        option = (unknown[0] - 7.0 - 1.5 * end, unknown[1])
        for n in lengths:
            if n > end:
                break
            cost = words.get(label[end - n:end])
            if cost is not None:
                option = max(option, (best[end - n][0] + cost, end - n))
        best.append(option)
        unknown = max(unknown, (option[0] + 1.5 * end, end))
    out, end = [], len(label)
    while end:
        out.append(label[best[end][1]:end])
        end = best[end][1]
    return out[::-1]


def labels_of(host: str) -> list[str]:
    return [p for p in SPLIT.split(host.rpartition(".")[0] or host) if p]  # the top-level domain says no word


def tokens_of(host_words: str, path: str) -> set[str]:
    return {*(HOST + w for w in host_words.split()), *(PATH + p for p in SPLIT.split(path.lower()) if p)}


def host_table(pages: DataFrame, ruled: DataFrame) -> DataFrame:
    """host, host_words (saved) of all distinct hosts. Words outside the broadcast VOCABULARY are joined with the parts of hosts."""
    spark = pages.sparkSession
    counts = common.saved(page_words(pages), "page-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    counts = counts.filter((F.length("word") > 1) | (F.col("n") > 0.001 * total))
    head = {r["word"]: math.log10(r["n"] / total) for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()}
    for word in ("www", "com", "org", "net"):
        head.setdefault(word, -5.0)
    lengths = sorted({*map(len, head), *(r[0] for r in counts.select(F.length("word")).distinct().collect())})  # of all counted words
    shared = spark.sparkContext.broadcast(head)
    hosts = ruled.select("host").distinct()

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[int, str]] = []
            for k, host in zip(batch["k"], batch["host"], strict=True):
                seen = set()
                for label in labels_of(host):
                    for start in range(len(label)):
                        for n in lengths:
                            part = label[start:start + n]
                            if len(part) < n:
                                break
                            if part not in seen and part not in shared.value and LETTERS.fullmatch(part):
                                seen.add(part)
                                out.append((k, part))
                    if len(out) > 200_000:
                        yield pd.DataFrame({"k": [x[0] for x in out], "word": common.texts(x[1] for x in out)})
                        out = []
            yield pd.DataFrame({"k": pd.Series([x[0] for x in out], dtype="int64"), "word": common.texts(x[1] for x in out)})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, found in zip(batch["host"], batch["found"], strict=True):
                own = {x["word"]: math.log10(x["n"] / total) for x in found} if found is not None else {}
                words = ChainMap(own, shared.value) if own else shared.value
                out.append(" ".join(w for label in labels_of(host) for w in segment(label, words, lengths)))
            yield pd.DataFrame({"host": batch["host"], "host_words": common.texts(out)})

    rows = common.saved(hosts.withColumn("k", F.monotonically_increasing_id()), "hosts")
    nothing = F.lit(None).cast("array<struct<word:string,n:bigint>>").alias("found")
    if distinct > VOCABULARY:
        met = rows.mapInPandas(candidates, "k long, word string").join(counts, "word").groupBy("k").agg(F.collect_set(F.struct("word", "n")).alias("found"))
        rows = rows.join(met, "k", "left").select("host", "found")
    else:
        rows = rows.select("host", nothing)
    return common.saved(rows.mapInPandas(split, "host string, host_words string"), "host-words")


def fit(rows: DataFrame) -> tuple[Model, DataFrame]:
    """From host_words, path, ruled: the model, of which TOKENS_KEPT tokens come to the driver, and token, odds of all tokens. Class sums and
    the number of tokens are over the whole table."""
    def token_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], int] = {}
        for batch in batches:
            for words, path, verdict in zip(batch["host_words"], batch["path"], batch["ruled"], strict=True):
                for token in [*tokens_of(words, path), ""]:  # the empty token counts pages
                    seen[token, verdict] = seen.get((token, verdict), 0) + 1
            if len(seen) > 200_000:
                yield pd.DataFrame({"token": common.texts(t for t, _ in seen), "ruled": common.texts(v for _, v in seen), "n": list(seen.values())})
                seen = {}
        yield pd.DataFrame({"token": common.texts(t for t, _ in seen), "ruled": common.texts(v for _, v in seen), "n": list(seen.values())})

    pairs = rows.filter(F.col("ruled").isNotNull()).select("host_words", "path", "ruled").mapInPandas(token_counts, "token string, ruled string, n long")
    sum_of = lambda verdict: F.coalesce(F.sum(F.when(F.col("ruled") == verdict, F.col("n"))), F.lit(0)).cast("double").alias(verdict)
    table = pairs.groupBy("token").agg(sum_of("block"), sum_of("allow"))
    table = common.saved(table, "url-tokens")
    pages_of = table.filter("token = ''").first()
    table = table.filter("token <> ''")
    distinct, *sums = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("block"), F.lit(0.0)), F.coalesce(F.sum("allow"), F.lit(0.0))).first()
    sums = [x + distinct + 1 for x in sums]
    unseen = math.log(sums[1]) - math.log(sums[0])
    odds = table.withColumn("odds", F.log(F.col("block") + 1) - F.log(F.col("allow") + 1) + F.lit(unseen))
    head = odds.orderBy(F.desc(F.col("block") + F.col("allow")), "token").limit(TOKENS_KEPT).select("token", "odds").collect()
    prior = math.log(pages_of["block"] + 1) - math.log(pages_of["allow"] + 1) if pages_of else 0.0
    return Model({r["token"]: r["odds"] for r in head}, prior, unseen, distinct <= TOKENS_KEPT), odds.select("token", "odds")


def filter_urls(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    ruled = with_rules(pages)
    hosts = common.small(host_table(pages, ruled), HOSTS_SENT)
    rows = common.saved(ruled.join(hosts, "host").withColumn("row", F.monotonically_increasing_id()), "url-rows")
    fitted, odds = fit(rows)
    model = spark.sparkContext.broadcast(fitted)

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = model.value
        for words, paths in batches:
            logs, rare = [], []
            for w, p in zip(words, paths, strict=True):
                tokens = sorted(tokens_of(w, p))
                logs.append(m.prior + sum(m.tokens.get(t, m.unseen if m.whole else 0.0) for t in tokens))
                rare.append([] if m.whole else [t for t in tokens if t not in m.tokens])
            yield pd.DataFrame({"log": logs, "rare": rare})

    judged = rows.withColumn("_m", F.pandas_udf(judge, "log double, rare array<string>")("host_words", "path")).select("*", "_m.log", "_m.rare").drop("_m")
    if fitted.whole:
        logs = judged.withColumn("all", F.col("log"))
    else:
        judged = common.saved(judged, "url-judged")
        rare = judged.select("row", F.explode("rare").alias("token")).join(odds, "token", "left")
        rare_logs = rare.groupBy("row").agg(F.sum(F.coalesce("odds", F.lit(fitted.unseen))).alias("more"))
        logs = judged.join(rare_logs, "row", "left").withColumn("all", F.col("log") + F.coalesce("more", F.lit(0.0)))
    bounded = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.when(F.col("host") != "", F.col("all")).otherwise(0.0)))
    scored = logs.withColumn("score", 1 / (1 + F.exp(-bounded)))
    verdict = F.coalesce(F.col("ruled"), F.when((F.col("host") != "") & (F.col("score") > 0.5), F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "host_words")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages"))
