"""Benchmark decontamination by winnowing, in SQL functions only.

Every run of SPAN = GRAM + WINDOW - 1 words has WINDOW hashes of GRAM words; the least of them is its fingerprint. Equal runs have equal
fingerprints, so a run that a document shares with an item always shows as a common fingerprint. First the fingerprints of all documents are joined
with those of the benchmark, which leaves the documents worth a second look; in these, each fingerprint hit is extended word by word in both directions,
and runs of SPAN words or more are the hits. An item of fewer words is one run by itself, found by the hash of that many words and compared.

The benchmark's fingerprints are broadcast if they are at most BROADCAST_ROWS, else joined by a shuffle; so are the candidate documents.

Null or empty text: no words, no hit. Repeated rows (equal doc_id and text) are judged once and come back as often as they occur; equal doc_ids with
other texts are judged apart. Items without words match nothing; equal items are all reported. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.llm import common

SPAN, GRAM = 13, 8
WINDOW = SPAN - GRAM + 1
#: Contaminated: hit words are at least one in SHARE of all words.
SHARE = 20
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case ASCII words; a text that begins or ends with other characters has no empty word."""
    clean = F.regexp_replace(common.ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD, " ")
    return F.filter(F.split(F.trim(clean), " "), lambda w: w != "")


def _hashes(w: Column, n: int) -> Column:
    """Hash of each n consecutive words."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))


def fingerprints(w: Column) -> Column:
    """The least hash of each window, for windows of WINDOW hashes; empty below SPAN words."""
    return F.when(F.size(w) >= SPAN, _minima(_hashes(w, GRAM))).otherwise(F.array().cast("array<bigint>"))


def _minima(hashes: Column) -> Column:
    bound = F.transform(F.array(hashes), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.array_min(F.slice(h, i, WINDOW))))
    return F.array_distinct(bound[0])


def short_hashes(w: Column, lengths: list[int]) -> Column:
    """Hashes of all runs of the lengths that short items have."""
    parts = [F.when(F.size(w) >= n, _hashes(w, n)).otherwise(F.array().cast("array<bigint>")) for n in lengths]
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<bigint>")


def _places(w: str, n: int, hashes: str) -> Column:
    """(place, fingerprint) structs: all places whose hash is the least of some window that holds it."""
    h = F.col(hashes)
    low = F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.array_min(F.slice(h, i, WINDOW)))
    near = lambda m, i: F.slice(m, F.greatest(i - WINDOW + 1, F.lit(1)), F.least(F.size(m), i) - F.greatest(i - WINDOW + 1, F.lit(1)) + 1)
    bound = F.transform(F.array(low), lambda m: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(near(m, i + 1), x), F.struct((i + 1).alias("at"), x.alias("fp")))), lambda s: s.isNotNull()))
    return bound[0]


def _benchmark(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """item words (saved): item_id, w, n, and the lengths of short items (at most SPAN - 1 of them)."""
    rows = common.saved(items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0).withColumn("n", F.size("w")), "benchmark")
    return rows, sorted(r[0] for r in rows.filter(F.col("n") < SPAN).select("n").distinct().collect())


def find_hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, _text, n_words, n_copies, n_hit, item_ids of every distinct (doc_id, text)."""
    bench, lengths = _benchmark(items)
    long_fps = bench.filter(F.col("n") >= SPAN).select(F.explode(fingerprints(F.col("w"))).alias("fp"))
    short_fps = bench.filter(F.col("n") < SPAN).select(F.xxhash64("w").alias("fp"))
    known = common.saved(long_fps.union(short_fps).distinct(), "fingerprints")
    keyed = documents.select("doc_id", F.xxhash64("text").alias("_text"), words(F.col("text")).alias("w"))
    # one row more than fingerprints, whose fingerprint is null: it carries the text's words and counts its copies
    w = F.col("w")
    all_fps = F.concat(fingerprints(w), short_hashes(w, lengths), F.array(F.lit(None).cast("bigint")))
    exploded = keyed.select("doc_id", "_text", F.size("w").alias("n_words"), F.explode(all_fps).alias("fp"))
    looked = exploded.join(common.small(known).withColumn("found", F.lit(True)), "fp", "left")
    screened = common.saved(looked.groupBy("doc_id", "_text").agg(F.max("n_words").alias("n_words"), F.sum(F.col("fp").isNull().cast("long")).alias("n_copies"),
                                                                  F.coalesce(F.max("found"), F.lit(False)).alias("candidate")), "screened")
    candidates = common.saved(screened.filter("candidate").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_key")), "candidates")
    second = documents.select("doc_id", F.xxhash64("text").alias("_text"), "text").join(
        common.small(candidates), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left_semi").dropDuplicates(["doc_id", "_text"])
    texts = common.saved(second.select("doc_id", "_text", words(F.col("text")).alias("w")), "candidate-words")
    hits = _long_hits(texts, bench).unionByName(_short_hits(texts, bench, lengths)).distinct()
    spans = hits.select("doc_id", "_text", "a", "b").distinct().groupBy("doc_id", "_text").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    total = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(s["b"], acc["end"]).alias("end")), lambda acc: acc["n"])
    found = hits.groupBy("doc_id", "_text").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    merged = spans.select("doc_id", "_text", total.cast("long").alias("n_hit")).join(found, [spans["doc_id"].eqNullSafe(found["doc_id"]), spans["_text"] == found["_text"]]).select(
        spans["doc_id"].alias("_id"), spans["_text"].alias("_key"), "n_hit", "item_ids")
    return screened.join(merged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left").select(
        "doc_id", "_text", F.col("n_words").cast("long").alias("n_words"), "n_copies", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def _long_hits(texts: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, _text, item_id, a, b: words [a, b) of the document are a run that the item has too."""
    def placed(rows: DataFrame, *keys: str) -> DataFrame:
        hashed = rows.filter(F.size("w") >= SPAN).withColumn("h", _hashes(F.col("w"), GRAM))
        # the words around a place: all that a run of SPAN words through it can hold
        around = hashed.select(*keys, "w", F.explode(_places("w", GRAM, "h")).alias("p"))
        side = SPAN - GRAM
        left = F.reverse(F.slice("w", F.greatest(F.col("p.at") - side, F.lit(1)), F.least(F.lit(side), F.col("p.at") - 1)))
        return around.select(*keys, F.col("p.fp").alias("fp"), F.col("p.at").alias("at"), left.alias("left"), F.slice("w", F.col("p.at"), SPAN).alias("right"))

    items = common.saved(placed(bench, "item_id").select("item_id", "fp", F.col("left").alias("i_left"), F.col("right").alias("i_right")).distinct(), "item-places")
    pairs = placed(texts, "doc_id", "_text").join(common.small(items), "fp")
    same = lambda x, y: F.array_position(F.concat(F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False))), F.array(F.lit(False))), False) - 1
    run = pairs.withColumn("l", same(F.col("left"), F.col("i_left"))).withColumn("r", same(F.col("right"), F.col("i_right"))).filter((F.col("r") >= GRAM) & (F.col("l") + F.col("r") >= SPAN))
    return run.select("doc_id", "_text", "item_id", (F.col("at") - F.col("l")).cast("int").alias("a"), (F.col("at") + F.col("r")).cast("int").alias("b"))


def _short_hits(texts: DataFrame, bench: DataFrame, lengths: list[int]) -> DataFrame:
    items = bench.filter(F.col("n") < SPAN).select("item_id", F.col("w").alias("i_w"), "n", F.xxhash64("w").alias("fp"))
    def runs_of(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(i.alias("at"), F.slice("w", i, n).alias("run")))
        return F.when(F.size("w") >= n, found).otherwise(F.array().cast("array<struct<at:int,run:array<string>>>"))

    runs = [runs_of(n) for n in lengths]
    places = F.concat(*runs) if runs else F.array().cast("array<struct<at:int,run:array<string>>>")
    rows = texts.select("doc_id", "_text", F.explode(places).alias("p")).withColumn("fp", F.xxhash64("p.run"))
    pairs = rows.join(items, "fp").filter(F.col("p.run") == F.col("i_w"))
    return pairs.select("doc_id", "_text", "item_id", F.col("p.at").cast("int").alias("a"), (F.col("p.at") + F.col("n")).cast("int").alias("b"))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def judge(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The verdict of every row. Rows that occur once have their own; only repeated ones are joined back to the table, where
    adaptive execution splits a row with very many copies."""
    found = common.saved(find_hits(documents, items), "judged")
    own = found.filter("n_copies = 1")
    repeated = common.saved(found.filter("n_copies > 1").withColumnsRenamed({"doc_id": "_id", "_text": "_key"}), "repeated")
    if not repeated.isEmpty():
        copies = documents.select("doc_id", F.xxhash64("text").alias("_text"))
        again = copies.join(common.small(repeated), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))).drop("_id", "_key")
        own = own.unionByName(again)
    return own.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def keep_clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    hits = find_hits(documents, items).filter(contaminated()).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_key"))
    bad = common.small(common.saved(hits, "contaminated"))
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(documents["text"]) == bad["_key"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: The same in SQL, by plain windows.
SQL = """
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
iw as (
  select item_id, k, array_to_string(w[p:p + k - 1], ' ') as g from (
    select item_id, w, least(len(w), 13) as k, unnest(range(1, len(w) - least(len(w), 13) + 2)) as p from i where len(w) > 0)),
ks as (select distinct k from iw),
dw as (select r, k, p, array_to_string(w[p:p + k - 1], ' ') as g from (select r, w, k, unnest(range(1, len(w) - k + 2)) as p from d, ks where len(w) >= k)),
hits as (select distinct r, item_id, p, dw.k from dw join iw on dw.g = iw.g and dw.k = iw.k),
n as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + k)) as q from hits) group by r),
items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, cast(item_id as varchar) as item_id from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n using (r) left join items using (r)
"""
