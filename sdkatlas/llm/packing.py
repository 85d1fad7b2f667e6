"""Best-fit packing of documents into sequences by a configuration linear program.

Pieces of the same length are alike, so the program is over the histogram of lengths (SIZE - 1 numbers, whatever the corpus): cover every length's
count by patterns, sets of lengths that fit into a sequence, with as few sequences as can be. Multiplicative weights solve it: lengths covered
less so far weigh more, and a knapsack dynamic program finds the pattern worth most. The fractional answer is rounded down, the rest is solved
again, and what is left goes by best fit decreasing, in runs of equal pieces. The plan is of bounded size and is broadcast.

Each piece gets its rank among those of its length (rank in its task plus the tasks before) and from it its place: no shuffle of all pieces
of a length, so a hot length is no hot task. Null and empty texts are the end id only. Repeated rows are documents of their own; repeated doc_ids
keep their own pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sdkatlas.llm import common, tokens

SIZE = 1024
END = 2
ROUNDS, STEPS, RATE, TILT = 3, 400, 0.35, 1.0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def knapsack(prices: np.ndarray, size: int = SIZE) -> Counter:
    """The multiset of lengths (1 to size - 1, prices[l] each) worth most that fits into `size`."""
    worth, choice = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    for c in range(1, size + 1):
        m = min(c, len(prices) - 1)
        options = worth[c - m:c][::-1] + prices[1:m + 1]
        best = int(options.argmax())
        if options[best] > worth[c - 1]:
            worth[c], choice[c] = options[best], best + 1
        else:
            worth[c] = worth[c - 1]
    pattern, c = Counter(), size
    while c:
        if choice[c]:
            pattern[int(choice[c])] += 1
            c -= int(choice[c])
        else:
            c -= 1
    return pattern


def fractional(counts: np.ndarray, size: int = SIZE, steps: int = STEPS) -> dict[tuple, float]:
    """pattern -> how often, by multiplicative weights; covers no length beyond its count on the whole."""
    there = np.flatnonzero(counts)
    weight = TILT * np.arange(len(counts)) / size  # long pieces first: short ones fill any gap
    covered = np.zeros(len(counts))
    use: dict[tuple, float] = {}
    prices = np.zeros(len(counts))
    for _ in range(steps):
        prices[there] = there * np.exp(weight[there])
        pattern = tuple(sorted(knapsack(prices, size).items()))
        if not pattern:
            break
        step = min(counts[n] / k for n, k in pattern) * 0.5
        use[pattern] = use.get(pattern, 0.0) + step
        for n, k in pattern:
            covered[n] += k * step
            weight[n] -= RATE * k * step / counts[n]
    for pattern in use:  # as far as its tightest length allows
        use[pattern] *= min(1.0, min(counts[n] / covered[n] for n, _ in pattern))
    return use


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple, int]]:
    """Best fit decreasing over runs of equal sequences: (pattern, how many)."""
    open_: dict[int, list[tuple[tuple, int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in range(length, size):
            while left and open_.get(room):
                pattern, many = open_[room].pop()
                used = min(many, left)
                if many > used:
                    open_[room].append((pattern, many - used))
                open_.setdefault(room - length, []).append(((*pattern, length), used))
                left -= used
            if not left:
                break
        fit = size // length
        for k, many in ((fit, left // fit), (left % fit, 1)):
            if k and many:
                open_.setdefault(size - k * length, []).append(((length,) * k, many))
    return [run for runs in open_.values() for run in runs]


@dataclass
class Plan:
    """Per length its runs in order: rank at which the run begins, pieces of it in a sequence, the first sequence, the place in it."""

    runs: dict[int, np.ndarray]
    sequences: int

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = self.runs[length]
        run = runs[np.searchsorted(runs[:, 0], ranks, side="right") - 1]
        past = ranks - run[:, 0]
        return run[:, 2] + past // run[:, 1], run[:, 3] + past % run[:, 1] * length


def make_plan(counts: dict[int, int], size: int = SIZE) -> Plan:
    left = np.zeros(size, dtype=np.int64)
    for n, k in counts.items():
        left[n] = k
    chosen: list[tuple[tuple, int]] = []
    for _ in range(ROUNDS):
        if not left.any():
            break
        use = fractional(left.astype(float), size)
        for pattern, x in sorted(use.items(), key=lambda p: (-p[1], p[0])):
            many = min([int(x), *(left[n] // k for n, k in pattern)])
            if many and sum(n * k for n, k in pattern) == size:  # only full sequences; others come with the rest
                chosen.append((pattern, int(many)))
                for n, k in pattern:
                    left[n] -= k * many
    rest = best_fit({int(n): int(left[n]) for n in np.flatnonzero(left)}, size)
    chosen += [(tuple(sorted(Counter(pattern).items())), many) for pattern, many in rest]
    runs: dict[int, list[tuple]] = {}
    placed, sequences = Counter(), 0
    for pattern, many in chosen:
        at = 0
        for n, k in pattern:
            runs.setdefault(n, []).append((placed[n], k, sequences, at))
            placed[n] += k * many
            at += n * k
        sequences += many
    return Plan({n: np.array(r, dtype=np.int64) for n, r in runs.items()}, sequences)


def to_pieces(documents: DataFrame, tokenizer: str, size: int = SIZE, kept: int = tokens.KEPT) -> DataFrame:
    """Encode and cut, saved; a piece's rank is among those of its length in its task."""
    end = END.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ranks, encode = TaskContext.get().partitionId(), Counter(), tokens.encoder(tokenizer, kept)
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = memoryview(encode.ids(text) + end)
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = n % size or size if at == 0 else size
                    rows.append((doc_id, piece, at, length, zlib.crc32(ids[4 * at:4 * (at + length)]), part, ranks[length]))
                    ranks[length] += 1
                    at, piece = at + length, piece + 1
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return common.saved(documents.select("doc_id", "text").mapInPandas(cut, PIECES), "pieces")


def pack(documents: DataFrame, tokenizer: str, kept: int = tokens.KEPT) -> DataFrame:
    """`kept`: entries of a worker's table of encoded words; fewer take less memory and more time, the result is the same."""
    spark = documents.sparkSession
    pieces = to_pieces(common.bounded_batches(documents), tokenizer, kept=kept)
    groups = common.saved(pieces.filter(F.col("length") < SIZE).groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {int(r[0]): int(r[1]) for r in groups.groupBy("length").agg(F.sum("n")).collect()}
    plan = spark.sparkContext.broadcast(make_plan(counts))

    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        size, rank = lengths.to_numpy(), ranks.to_numpy()
        order = np.argsort(size, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            if len(run):
                sequence[run], offset[run] = plan.value.place(int(size[run[0]]), rank[run])
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = groups.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    short = pieces.filter(F.col("length") < SIZE).join(before, ["part", "length"])
    placed = short.withColumn("_p", F.pandas_udf(place, "sequence_id long, offset long")("length", F.col("before") + F.col("local_rank")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") == SIZE)  # a sequence each, numbered by task and rank below zero
    number = -(F.col("part").cast("long") * F.lit(1 << 36) + F.col("local_rank")) - 1
    return placed.select(*columns, "_p.sequence_id", "_p.offset").unionByName(full.select(*columns, number.alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokens.default_path())
