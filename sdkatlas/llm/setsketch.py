"""Near-duplicates by SetSketch registers.

A document's set is its distinct five-word shingles, as 64-bit hashes. Register i holds floor(1 - log_BASE(x)), where x is the least of exponential
variables, one for each shingle: truncated minima on an exponential scale, mergeable by the larger value. Equal sets make one class with one node.
Registers are banded; a class meets the others of a band in a bucket. Their similarity is estimated jointly by likelihood from how many
registers are larger, smaller and equal, and pairs that may reach the threshold are verified on their full sets.

No pairs of a whole group are made. First each class is compared with the least class of its buckets, and links are closed to components. Then only
pairs of different components that still meet in a bucket are looked at: in small buckets by a join, in large ones block against block in tasks
that hold both blocks' texts and return links alone. So every pair of different components that shares a band is decided, whatever the bucket's size.

Null or empty text and text without words: n_shingles 0, linked with nothing. Fewer than five words: the whole sequence is one shingle. Equal rows
(also with equal doc_id) are of one class and each comes back. Null doc_id: it is in its class but never names it, unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.llm import common

SHINGLE = 5
BANDS, ROWS = 36, 7
REGISTERS = BANDS * ROWS
BASE, SCALE, TOP = 1.02, 20.0, 65535
PERCENT = 85  # a link: 100 * intersection >= PERCENT * union
#: Pairs estimated lower are not verified: some five standard errors of the estimate under the threshold.
LEAST_ESTIMATE = 0.74
SMALL_BUCKET, BLOCK = 32, 512
KEPT_WORDS, KEPT_SHINGLES = 100_000, 2_000_000  # of a task: words with their hashes; shingles of the sets it holds
SKETCH = "doc_id long, k0 long, k1 long, n_shingles long, class long, check long, registers binary"
_random = np.random.default_rng(20240229)
_FACTORS = (_random.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFTS = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_ROLL, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    rolled = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        rolled = rolled * _ROLL + h[i:i + n]
    return np.unique(_mixed(rolled))


def registers(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[i:i + 1024, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / SCALE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype("<u2")


def identity(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(int(v) for v in np.array([found.sum(dtype=np.uint64), _mixed(found ^ _ROLL).sum(dtype=np.uint64)]).astype(np.int64))


def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    common.held(None)
    hashes, names = WordHashes(), [c.split()[0] for c in SKETCH.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, k0, k1, data in zip(batch["doc_id"], batch["k0"], batch["k1"], batch["text"], strict=True):
            found = shingles(data, hashes)
            rows.append((doc_id, k0, k1, len(found), *identity(found), registers(found).tobytes() if len(found) else None))
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest similarity, on a grid, from the registers of pairs (rows of a and b) and the sizes of their sets."""
    larger, smaller = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - larger - smaller
    u = n_a / (n_a + n_b)
    v = 1 - u
    grid = np.linspace(0.0, 1.0, 101)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)
    more, less = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    likelihood = larger[:, None] * np.log(more) + smaller[:, None] * np.log(less) + equal[:, None] * np.log(np.clip(1 - more - less, 1e-9, 1))
    return grid[np.arange(len(a)), likelihood.argmax(1)]


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<u2").reshape(-1, REGISTERS)


def _likely(n_a: Column, n_b: Column) -> Column:
    """The sizes alone allow the threshold."""
    return 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)


def promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate may reach the threshold, with both classes' documents."""
    side = lambda s: nodes.select(F.col("class").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"), F.struct("class", "doc", "k0", "k1").alias(f"doc_{s}"))

    def likely(r_a: pd.Series, r_b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        parts = [estimate(_matrix(r_a[i:i + 4096]), _matrix(r_b[i:i + 4096]), n_a[i:i + 4096].to_numpy(), n_b[i:i + 4096].to_numpy()) for i in range(0, len(r_a), 4096)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(_likely(F.col("n_a"), F.col("n_b")))
    return joined.withColumn("e", F.pandas_udf(likely, "double")("r_a", "r_b", "n_a", "n_b")).filter(F.col("e") >= LEAST_ESTIMATE).select("a", "b", "doc_a", "doc_b")


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text among those of one doc_id."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def same_row(documents: DataFrame, doc: Column, k0: Column, k1: Column) -> Column:
    keys = text_keys(documents["text"])
    return documents["doc_id"].eqNullSafe(doc) & (keys[0] == k0) & (keys[1] == k1)


def texts_of(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """class, text (UTF-8) of the classes in `docs` (class, doc, k0, k1), saved: only these are shuffled later."""
    needed = common.small(common.saved(docs.distinct(), "needed"))
    found = documents.join(needed, same_row(documents, needed["doc"], needed["k0"], needed["k1"]))
    return common.saved(found.select("class", common.utf8(documents["text"]).alias("text")).distinct(), "texts")


def is_link(one: np.ndarray, other: np.ndarray) -> bool:
    both = np.concatenate((one, other))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(both) - shared)


def verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""
    pairs = common.saved(pairs, "pairs")
    texts = texts_of(pairs.select("doc_a.*").union(pairs.select("doc_b.*")), documents)
    side = lambda s: texts.select(F.col("class").alias(s), F.col("text").alias(f"text_{s}"))
    # the side with most pairs last: its rows come one after the other, and their sets are made once
    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.held(None)
        hashes, kept, size = WordHashes(), {}, 0
        for batch in batches:
            out = []
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                sets = []
                for name, text in ((a, text_a), (b, text_b)):
                    if name not in kept:
                        found = shingles(text, hashes)
                        size += len(found)
                        if size > KEPT_SHINGLES:
                            kept.clear()
                            size = len(found)
                        if identity(found)[0] != name:  # another text with the same keys
                            found = None
                        else:
                            kept[name] = found
                    else:
                        found = kept[name]
                    sets.append(found)
                if sets[0] is not None and sets[1] is not None and is_link(*sets):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return common.saved(joined.select("a", "b", "text_a", "text_b").mapInPandas(compare, "a long, b long").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of all nodes in edges (a, b), by alternating large and small stars; each step is saved."""
    edges = common.saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = common.saved(small, "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
        mark = now


def unsettled_buckets(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """band, i, class, label, n, main, n_main of all members of buckets that hold several components; main is the largest one, of n_main members."""
    joined = bands.join(labels, bands["class"] == labels["node"], "left").select("band", "i", "class", F.coalesce("label", "class").alias("label"))
    members = common.saved(joined, "members")
    parts = members.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"))
    largest = F.max(F.struct("k", "label")).alias("main")
    several = parts.groupBy("band").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("labels"), largest).filter("labels > 1").select("band", "n", F.col("main.label").alias("main"), F.col("main.k").alias("n_main"))
    return common.saved(members.join(several, "band"), "unsettled")


def small_bucket_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in a bucket of at most SMALL_BUCKET."""
    few = rows.filter(F.col("n") <= SMALL_BUCKET)
    one = few.select("band", F.col("class").alias("a"), F.col("label").alias("label_a"))
    other = few.select("band", F.col("class").alias("b"), F.col("label").alias("label_b"))
    return one.join(other, "band").filter((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b"))).select("a", "b").distinct()


def large_bucket_links(rows: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a, b) between components in larger buckets. A bucket is cut into blocks of some BLOCK classes and a task sees two blocks; it
    estimates each pair of different components, verifies the likely ones, and returns links enough to join what is linked. The members of
    the bucket's largest component have blocks of their own, which never meet each other: a hot group with a few strangers costs its own
    size times the strangers' blocks, not its square."""
    others, mains = F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int"), F.ceil(F.col("n_main") / BLOCK).cast("int")
    is_main, number = F.col("label") == F.col("main"), F.xxhash64("class")
    own = F.when(is_main, others + F.pmod(number, mains)).otherwise(F.pmod(number, others)).cast("int")
    met = F.when(is_main, others - 1).otherwise(others + mains - 1)
    many = rows.filter(F.col("n") > SMALL_BUCKET).withColumn("own", own)
    spread = many.withColumn("k", F.explode(F.sequence(F.lit(0), met))).withColumn("p", F.least("own", "k")).withColumn("q", F.greatest("own", "k"))
    member_docs = many.select("class").distinct().join(nodes.select("class", "doc", "k0", "k1", "n_shingles", "registers"), "class")
    held = common.saved(member_docs, "large-members")
    texts = texts_of(held.select("class", "doc", "k0", "k1"), documents)
    members = held.join(texts, "class").select("class", "n_shingles", "registers", "text")
    shown = spread.join(members, "class").select("band", "i", "p", "q", "own", "class", "label", "n_shingles", "registers", "text")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        hashes, sets, root = WordHashes(), {}, {}

        def set_of(row) -> np.ndarray | None:
            if row.Index not in sets:
                found = shingles(row.text, hashes)
                sets[row.Index] = found if identity(found)[0] == row[group.columns.get_loc("class") + 1] else None
            return sets[row.Index]

        def top(label: int) -> int:
            while root.get(label, label) != label:
                label = root[label]
            return label

        band, left, right = int(group["i"].iloc[0]), group[group["own"] == group["p"]], group[group["own"] == group["q"]]
        matrix, sizes, labels = _matrix(right["registers"]), right["n_shingles"].to_numpy(), right["label"].to_numpy()
        others, out = list(right.itertuples()), []
        at = group.columns.get_loc("class") + 1
        for row in left.itertuples():
            to = np.flatnonzero((labels != row.label) & (100 * np.minimum(sizes, row.n_shingles) >= PERCENT * np.maximum(sizes, row.n_shingles)))
            if not len(to):
                continue
            own = np.frombuffer(row.registers, "<u2")
            # pairs that share an earlier band are decided there
            earlier = (matrix[to, :band * ROWS] == own[:band * ROWS]).reshape(len(to), band, ROWS).all(2).any(1) if band else np.zeros(len(to), bool)
            to = to[~earlier]
            if len(to):
                likely = estimate(np.broadcast_to(own, (len(to), REGISTERS)), matrix[to], np.full(len(to), row.n_shingles), sizes[to])
                for k in to[likely >= LEAST_ESTIMATE].tolist():
                    other = others[k]
                    a, b = top(row.label), top(other.label)
                    if a != b and set_of(row) is not None and set_of(other) is not None and is_link(set_of(row), set_of(other)):
                        root[a] = b
                        out.append((row[at], other[at]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return shown.groupBy("band", "p", "q").applyInPandas(compare, "a long, b long").distinct()


def grouped(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's sketch; and _class, label (of its component), component_id of every class."""
    rows = documents.select("doc_id", "text")
    k0, k1 = text_keys(F.col("text"))
    sketches = common.saved(rows.select("doc_id", k0.alias("k0"), k1.alias("k1"), common.utf8(F.col("text")).alias("text")).mapInPandas(sketch, SKETCH), "sketches")
    # SQL's min of structs puts a null doc_id first, so the flag comes before it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k0", "k1", "registers", "n_shingles"))
    nodes = common.saved(sketches.filter("n_shingles > 0").groupBy("class").agg(first.alias("f")).select("class", F.col("f.doc_id").alias("doc"), "f.k0", "f.k1", "f.registers", "f.n_shingles"), "classes")
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * width + 1, F.lit(width))))
    all_bands = nodes.select("class", F.posexplode(keys).alias("i", "band"))
    buckets = all_bands.groupBy("band").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "head")
    bands = common.saved(all_bands.join(buckets, "band"), "bands")  # classes alone in a bucket are gone here
    stars = bands.filter(F.col("class") != F.col("head")).select(F.col("head").alias("a"), F.col("class").alias("b")).distinct()
    links = verified(promising(stars, nodes), rows)
    labels = common.saved(components(links), "labels")
    open_ = unsettled_buckets(bands.select("band", "i", "class"), labels)
    more = verified(promising(small_bucket_pairs(open_), nodes), rows).union(large_bucket_links(open_, nodes, rows))
    labels = common.saved(components(links.union(more)), "labels")
    named = nodes.select("class", "doc").join(labels, F.col("class") == F.col("node"), "left").select("class", "doc", F.coalesce("label", "class").alias("label"))
    names = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    return sketches, named.join(names, "label").select(F.col("class").alias("_class"), "label", "component_id")


def clusters(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    sketches, of_class = grouped(documents)
    joined = sketches.select("doc_id", "n_shingles", "class").join(of_class, (F.col("class") == F.col("_class")) & (F.col("n_shingles") > 0), "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    return clusters(documents).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component, with its own columns: that of the least doc_id, null last. Rows without words all stay. Rows are told apart by
    doc_id and text, so a null or repeated doc_id loses no other text; of rows equal in both, any one stays."""
    sketches, of_class = grouped(common.bounded_batches(documents))
    told = sketches.filter("n_shingles > 0").join(of_class, F.col("class") == F.col("_class"))
    own = common.saved(told.groupBy("label", "doc_id", "k0", "k1").agg(F.count(F.lit(1)).alias("n")), "component-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k0", "k1")).alias("first")
    several = own.groupBy("label").agg(F.sum("n").alias("of"), first).filter("of > 1").select("label", "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k0") == F.col("first.k0")) & (F.col("k1") == F.col("first.k1"))
    judged = own.join(common.small(common.saved(several, "components")), "label").select("doc_id", "k0", "k1", "n", stays.alias("stays"))
    judged = common.saved(judged.filter("not stays or n > 1"), "copies")
    matches = lambda r: same_row(documents, r["doc_id"], r["k0"], r["k1"])
    gone = common.small(judged.select("doc_id", "k0", "k1"))
    kept = documents.join(gone, matches(gone), "left_anti")
    repeated = judged.filter("stays").select("doc_id", "k0", "k1")
    if repeated.isEmpty():
        return kept
    repeated = common.small(repeated)
    return kept.union(documents.join(repeated, matches(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


#: The same in SQL, by a join on shingles.
SQL = """
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[p:p + k - 1], ' ') as g from (
    select doc_id, w, least(len(w), 5) as k, unnest(range(1, len(w) - least(len(w), 5) + 2)) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 85 * (x.n + y.n - k)),
reached as (select doc_id as a, doc_id as b from documents union select reached.a, links.b from reached join links on reached.b = links.a),
least_ as (select a as doc_id, min(b) as component_id from reached group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n using (doc_id) join least_ using (doc_id)
"""
