"""Centroid clustering in integers, by a tournament of bisectors.

Vectors become integers, floor(SCALE * x). For two centroids a < b the plane half way between them is one integer normal 2(b - a) and one integer
threshold |b|^2 - |a|^2: a vector lies on a's side if its product with the normal is at most the threshold, so zero favours the smaller number.
All pairs' planes are made once a round; a vector starts with centroid 0 and meets 1, 2, ... in turn, k - 1 tests in all, each of which drops
the loser. Being nearer (or as near and smaller) is an order, so the last one left is the nearest. Its distance alone is computed, exactly.

Each round is one pass over the saved integers: a task returns sums and counts of its clusters (k rows), and only k centroids are on the driver.
Rounds end early when no centroid moves, since further ones would change nothing.

Kept are vectors with exactly `size` components, none null or non-finite; others have no row. Fewer than k kept vectors: so many centroids.
Null vec_ids come last in the first choice, equal vec_ids are told apart by their vectors; repeated rows count as often as they occur and each
comes back. Sums are exact at any size (Python integers beyond 64 bits); a distance or inertia beyond a long is null. An empty table gives an
empty result. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.llm import common

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Up to here, distances and products of SIZE components stay below 2^62.
SAFE = 1 << 26
LONGEST = (1 << 63) - 1
_SUMS = "cluster int, position int, total decimal(38,0)"


def clean(vector: Column) -> Column:
    """The vector is there and has neither null nor non-finite entries."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad


def whole_numbers(values) -> np.ndarray:
    """Rows of whole doubles as a matrix of integers: 64 bits where that is safe, else Python's own."""
    matrix = np.stack(list(values))
    if np.abs(matrix).max(initial=0) <= SAFE:
        return matrix.astype(np.int64)
    return np.array([[int(v) for v in row] for row in matrix], dtype=object)


def bisectors(centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """normal[a, b] and threshold[a, b] of every pair a < b."""
    wide = max((abs(v) for c in centroids for v in c), default=0) > SAFE
    c = np.array(centroids, dtype=object if wide else np.int64)
    squares = (c * c).sum(1)
    return 2 * (c[None, :, :] - c[:, None, :]), squares[None, :] - squares[:, None]


def tournament(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row; ties go to the smaller number."""
    if normals.dtype == object:
        x = x.astype(object)
    winner = np.zeros(len(x), dtype=np.int64)
    for rival in range(1, len(thresholds)):
        for held in range(rival):
            rows = np.flatnonzero(winner == held)
            if len(rows):
                side = (x[rows] * normals[held, rival]).sum(1) if x.dtype == object else x[rows] @ normals[held, rival]
                winner[rows[(side > thresholds[held, rival]).astype(bool)]] = rival
    return winner


def distances(x: np.ndarray, centroids: list[list[int]], cluster: np.ndarray) -> list[int]:
    wide = max(abs(v) for c in centroids for v in c) > SAFE
    past = (x.astype(object) if wide else x) - np.array(centroids, dtype=object if wide else np.int64)[cluster]
    return [int(d) for d in (past * past).sum(1)]


def _moved(batches: Iterator[pd.DataFrame], centroids: list[list[int]], size: int) -> Iterator[pd.DataFrame]:
    """Per cluster of a task: the sums of its components, and its count at position `size`."""
    totals = [[0] * (size + 1) for _ in centroids]
    planes = bisectors(centroids)
    for batch in batches:
        if not len(batch):
            continue
        x = whole_numbers(batch["x"])
        cluster = tournament(x, *planes)
        for k in range(len(centroids)):
            own = x[cluster == k]
            for i, v in enumerate([*own.sum(0).tolist(), len(own)] if len(own) else []):
                totals[k][i] += int(v)
    rows = [(k, i, Decimal(v)) for k, sums in enumerate(totals) if sums[size] for i, v in enumerate(sums)]
    yield pd.DataFrame(rows, columns=["cluster", "position", "total"])


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The k vectors whose `seed:vec_id` has the smallest SHA-256."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [[int(v) for v in r[0]] for r in vectors.orderBy(name.asc_nulls_last(), "x").limit(k).select("x").collect()]


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> list[list[int]]:
    """The centroids of `vectors(vec_id, x)`, x whole doubles, after `rounds` rounds."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        sums = vectors.select("x").mapInPandas(lambda batches, c=centroids: _moved(batches, c, size), _SUMS)
        found: dict[int, dict[int, int]] = {}
        for cluster, position, total in sums.groupBy("cluster", "position").agg(F.sum("total")).collect():
            found.setdefault(cluster, {})[position] = int(total)
        moved = [[found[j][i] // found[j][size] for i in range(size)] if j in found else c for j, c in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _within(value: int) -> int | None:
    return value if value <= LONGEST else None


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, exact (the squared distance, decimal(38,0)) of every vector."""
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = bisectors(centroids)
        for batch in batches:
            if len(batch):
                x = whole_numbers(batch["x"])
                cluster = tournament(x, *planes)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": cluster.astype(np.int32), "exact": [Decimal(d) for d in distances(x, centroids, cluster)]})

    return vectors.select("vec_id", "x").mapInPandas(judge, "vec_id long, cluster int, exact decimal(38,0)")


def whole_vectors(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, x of the kept vectors, saved. A double holds floor(scale * x) exactly, whatever x is."""
    kept = embeddings.select("vec_id", F.col("embedding").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") == size))
    kept = kept.filter(clean(F.col("v")))
    product = lambda v: v.cast("double") * scale
    # doubles of 2^53 and more are whole already, and floor() would give a long
    floor = lambda v: F.when(F.abs(product(v)) < float(1 << 53), F.floor(product(v)).cast("double")).otherwise(product(v))
    return common.saved(kept.select("vec_id", F.transform("v", floor).alias("x")), "vectors")


def cluster_vectors(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings, size, scale)
    centroids = fit(vectors, k, rounds, seed, size)
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    long = lambda c: F.when(F.col(c) <= LONGEST, F.col(c)).cast("long")
    if not centroids:
        return spark.createDataFrame([], f"vec_id long, {schema}").select("vec_id", "cluster", F.lit(None).cast("long").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
    assigned = common.saved(assign(vectors, centroids), "assigned")
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum("exact")).collect()}
    whole = _within(sum(inertia.values()))
    facts = spark.createDataFrame([(j, _within(inertia[j]), whole, digest(c)) for j, c in enumerate(centroids) if j in inertia], schema)
    joined = assigned.join(F.broadcast(facts), "cluster")  # one row for each centroid
    return joined.select("vec_id", "cluster", long("exact").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(common.table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same in SQL: rounds written out, each with the distances to all centroids."""
    nearest = ("select vec_id, x, (arg_min(j, [d, j])) as j, min(d) as d from (select v.r, v.vec_id, v.x, c.j, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::hugeint as d "
               "from v, c{n} c) group by r, vec_id, x")
    steps = [
        "kept as (select vec_id, embedding as e from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0)",
        "v as materialized (select row_number() over () as r, vec_id, list_transform(e, lambda z: cast(floor(1024 * cast(z as double)) as bigint)) as x from kept)",
        "c0 as materialized (select row_number() over (order by h nulls last, x) - 1 as j, x from (select x, sha256('3:' || vec_id) as h from v order by h nulls last, x limit 8))",
    ]
    for n in range(ROUNDS):
        steps.append(f"a{n} as materialized ({nearest.format(n=n)})")
        steps.append(f"m{n} as (select j, i, sum(e)::hugeint as s, count(*)::hugeint as k from (select j, unnest(x) as e, generate_subscripts(x, 1) as i from a{n}) group by j, i)")
        steps.append(f"n{n} as (select j, list((s - ((s % k) + k) % k) // k order by i)::bigint[] as x from m{n} group by j)")
        steps.append(f"c{n + 1} as materialized (select c.j, coalesce(n.x, c.x) as x from c{n} c left join n{n} n using (j))")
    last = nearest.format(n=ROUNDS)
    return (f"with {', '.join(steps)}, f as materialized ({last}) select vec_id, cast(j as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by j) as bigint) as cluster_inertia, "
            f"cast(sum(d) over () as bigint) as inertia, sha256(list_aggregate(c.x, 'string_agg', ',')) as centroid_sha256 from f join c{ROUNDS} c using (j)")


SQL = _sql()
