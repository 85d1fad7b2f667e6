"""Quality classifier as a sparse ensemble of rules over text statistics.

Every text gets some twenty statistics in one pass. Shallow trees are boosted on the statistics of labelled rows; every path from a root to a node of
a tree is a rule, a conjunction of one to DEPTH comparisons. A logistic model with a lasso penalty over all different rules keeps few of them
(that with the least loss in cross-validation), and the model becomes one Spark column: a sum of weights of the
rules that hold, each written as comparisons of columns, put through the logistic function. Scoring needs no model object and no worker.

The model is fitted on at most FIT_ROWS labelled rows, chosen by a hash of doc_id and text over the whole table; only their statistics, not
their texts, come to the driver. Statistics and scores are of whole texts of all rows.

Null and empty texts have all statistics 0 and get the score that the rules give to that. Rows are scored one by one: ties, repeated rows, null
or repeated doc_ids and further columns don't matter (a label counts for all rows of its doc_id; a doc_id labelled twice has the larger label). Labels
other than 0 and 1 are left out. With labels of one class only, or none, every score is the share of label 1 (0 without labels). An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.llm import common

#: Labelled rows that fit the model at most.
FIT_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, LEAST_LEAF, SHRINK, CUTS, ROWS_OF_TREE = 60, 3, 10, 0.2, 32, 0.6
PENALTIES, FALL, LASSO_STEPS, ASIDE = 12, 0.6, 200, 3  # parts of the rows, each set aside in turn to choose the penalty
BLOCK = 100  # words; variety is measured in blocks, or long texts would seem poor
STATISTICS = [
    "log_words", "log_bytes", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "distinct_pairs", "top_pair", "letters", "digits", "white",
    "upper", "high_bytes", "marks", "symbols", "pipes", "odd_ends", "log_lines", "repeated_lines", "mean_line", "ended_lines", "entropy", "capital_words",
]
SCHEMA = ", ".join(f"{name} double" for name in STATISTICS)
_WORD_MARKS = b".,;:!?'\"()-"


def _kinds() -> dict[str, np.ndarray]:
    """For each kind of byte 1.0 at the bytes of that kind."""
    b = np.arange(256)
    letter = (b >= 65) & (b <= 90) | (b >= 97) & (b <= 122) | (b >= 128)
    mark, white, digit = np.isin(b, list(_WORD_MARKS)), np.isin(b, [9, 10, 11, 12, 13, 32]), (b >= 48) & (b <= 57)
    kinds = {"letters": letter, "digits": digit, "white": white, "upper": (b >= 65) & (b <= 90), "high_bytes": b >= 128, "marks": mark,
             "symbols": ~(letter | mark | white | digit), "pipes": b == 124}
    return {name: found.astype(float) for name, found in kinds.items()}


_KINDS = _kinds()
_KIND_MATRIX = np.stack(list(_KINDS.values()), axis=1)
_ODD_END = frozenset(b for b in range(33, 127) if not chr(b).isalnum() and b not in _WORD_MARKS)


def statistics(data: bytes) -> tuple[float, ...]:
    """STATISTICS of a text; shares are of bytes, words, neighbouring pairs of words or lines with a word. Different words and pairs are counted in
    blocks of BLOCK words, all of them, so that the share doesn't fall with the text's length."""
    words = data.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, size = len(words), len(data)
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = dict(zip(_KINDS, (bytes_ @ _KIND_MATRIX / size).tolist(), strict=True))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    block, m = np.arange(n) // BLOCK, max(1, n - 1)
    spread = len(np.unique(block * n + ids)) / n
    pairs, pair_ids, pair_counts = np.unique(ids[:-1] * n + ids[1:], return_inverse=True, return_counts=True) if n > 1 else (ids, ids, np.ones(1, int))
    pair_spread = len(np.unique(block[:m] * len(pairs) + pair_ids)) / m
    lines = [line for line in data.split(b"\n") if line.strip()]
    seen = bytes_[bytes_ > 0] / size
    return (
        math.log1p(n), math.log1p(size), float(lengths.mean()), float((lengths > 15).mean()), float((lengths < 3).mean()),
        spread, float(np.bincount(ids).max() / n), pair_spread, float(pair_counts.max() / m), shares["letters"], shares["digits"], shares["white"],
        shares["upper"], shares["high_bytes"], shares["marks"], shares["symbols"], shares["pipes"], sum(w[-1] in _ODD_END for w in words) / n, math.log1p(len(lines)),
        1 - len(set(lines)) / len(lines), sum(map(len, lines)) / len(lines), sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines) / len(lines),
        float(-(seen * np.log2(seen)).sum()), sum(65 <= w[0] <= 90 for w in words) / n,
    )


def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([statistics(d) for d in batch], columns=STATISTICS, dtype="float64")


def text_statistics(text: Column) -> Column:
    return F.pandas_udf(_statistics, SCHEMA)(common.utf8(text))


#: statistic, bound, above: the value is over the bound, else at most the bound
Condition = tuple[int, float, bool]


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), dtype=bool)
        for at, bound, above in self.conditions:
            found &= (x[:, at] > bound) == above
        return found

    def column(self, names: list[str]) -> Column:
        """The rule as a condition on columns."""
        found = None
        for at, bound, above in self.conditions:
            one = F.col(names[at]) > F.lit(bound) if above else F.col(names[at]) <= F.lit(bound)
            found = one if found is None else found & one
        return found

    def text(self) -> str:
        return " and ".join(f"{STATISTICS[at]} {'>' if above else '<='} {bound:g}" for at, bound, above in self.conditions)


def simplified(conditions: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One comparison for each statistic and direction, the narrowest; in a fixed order."""
    best: dict[tuple[int, bool], float] = {}
    for at, bound, above in conditions:
        held = best.get((at, above), bound)
        best[at, above] = max(held, bound) if above else min(held, bound)
    return tuple(sorted((at, bound, above) for (at, above), bound in best.items()))


@dataclass
class Model:
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0
    prior: float = 0.0  # the score where there are no rules to learn

    def score(self, x: np.ndarray) -> np.ndarray:
        """What column() says, for rows of statistics."""
        if not self.rules:
            return np.full(len(x), self.prior)
        z = self.bias + sum(w * r.holds(x) for r, w in zip(self.rules, self.weights, strict=True))
        return 1 / (1 + np.exp(-z))

    def column(self, names: list[str] = STATISTICS) -> Column:
        """The score as one expression over the statistics' columns."""
        if not self.rules:
            return F.lit(float(self.prior))
        parts = [F.when(r.column(names), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights, strict=True)]
        while len(parts) > 1:  # as a balanced tree, so that the expression stays shallow
            parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return 1 / (1 + F.exp(-(parts[0] + F.lit(self.bias))))


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """Candidate bounds of each statistic: half way between neighbouring quantiles."""
    found = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1), method="nearest"))
        found.append((values[1:] + values[:-1]) / 2)
    return found


def grown(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, curvature: np.ndarray, rows: np.ndarray) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """One tree for the gradient: the paths to all its nodes, and its step for every row. Ties go to the first statistic and the lowest bound."""
    paths, step = [], np.zeros(len(binned))
    width = max(len(c) for c in cuts) + 1

    def split(train: np.ndarray, all_rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        g, h = gradient[train], curvature[train]
        if path:
            paths.append(path)
        best = (1e-9, -1, -1)
        if len(path) < DEPTH and len(train) >= 2 * LEAST_LEAF:
            base = g.sum() ** 2 / (h.sum() + 1)
            for at in range(binned.shape[1]):
                sums = [np.cumsum(np.bincount(binned[train, at], weights=w, minlength=width))[:-1] for w in (g, h, None)]
                left_g, left_h, left_n = sums
                gains = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - base
                gains[(left_n < LEAST_LEAF) | (len(train) - left_n < LEAST_LEAF)] = -1
                cut = int(gains.argmax())
                if gains[cut] > best[0] and cut < len(cuts[at]):
                    best = (float(gains[cut]), at, cut)
        if best[1] < 0:
            step[all_rows] = SHRINK * g.sum() / (h.sum() + 1)
            return
        _, at, cut = best
        for above in (False, True):
            side = lambda part: part[(binned[part, at] > cut) == above]  # noqa: E731, B023
            split(side(train), side(all_rows), (*path, (at, float(cuts[at][cut]), above)))

    split(rows, np.arange(len(binned)), ())
    return paths, step


def rules_of(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[Rule]:
    """All different rules of the boosted trees, without those that hold for the same rows as an earlier, no longer one."""
    rng, cuts = np.random.default_rng(seed), _cuts(x)
    binned = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1)  # bin b: over b bounds
    z = np.full(len(y), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    found: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        paths, step = grown(binned, cuts, y - p, p * (1 - p), np.flatnonzero(rng.random(len(y)) < ROWS_OF_TREE))
        found.update(dict.fromkeys(map(simplified, paths)))
        z += step
    rules, held = [], set()
    for rule in sorted(map(Rule, found), key=lambda r: (len(r.conditions), r.conditions)):
        mark = np.packbits(rule.holds(x)).tobytes()
        if mark not in held:
            held.add(mark)
            rules.append(rule)
    return rules


def lasso_path(a: np.ndarray, y: np.ndarray, penalties: list[float]) -> Iterator[tuple[np.ndarray, float]]:
    """Weights and bias of the logistic model for each of the falling penalties, by accelerated proximal steps from the one before.
    Rules are scaled by their spread, so that a rule which seldom holds is not favoured."""
    mean, spread = a.mean(0), a.std(0)
    spread[spread == 0] = 1.0
    s = (a - mean) / spread
    n = len(y)
    vector = np.random.default_rng(1).normal(size=s.shape[1])
    for _ in range(30):  # the largest eigenvalue of the squares bounds the step
        vector = s.T @ (s @ vector)
        vector /= max(np.linalg.norm(vector), 1e-300)
    rate = 1 / (0.26 * max(float(np.linalg.norm(s @ vector)) ** 2, 1e-9) / n + 0.26)
    w, bias = np.zeros(s.shape[1]), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for penalty in penalties:
        ahead, ahead_bias, t = w, bias, 1.0
        for _ in range(LASSO_STEPS):
            error = 1 / (1 + np.exp(-np.clip(s @ ahead + ahead_bias, -30, 30))) - y
            raw = ahead - rate * (s.T @ error) / n
            new = np.sign(raw) * np.maximum(np.abs(raw) - rate * penalty, 0)
            new_bias = ahead_bias - rate * error.mean()
            t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
            ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
            still = np.abs(new - w).max(initial=0) < 1e-5
            w, bias, t = new, new_bias, t_new
            if still:
                break
        yield w / spread, bias - float((w / spread * mean).sum())


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """From statistics and labels (0 or 1). The lasso's penalty is chosen by cross-validation; the weights are then those of all rows."""
    prior = float(y.mean()) if len(y) else 0.0
    if not 0 < prior < 1:
        return Model(prior=prior)
    rules = rules_of(x, y, seed)
    if not rules:
        return Model(prior=prior)
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    part = np.random.default_rng(seed).permutation(len(y)) % ASIDE
    scaled = (a - a.mean(0)) / np.where(a.std(0) == 0, 1, a.std(0))
    top = float(np.abs(scaled.T @ (y - prior)).max() / len(y))  # from here on no rule has a weight
    penalties = [top * FALL**k for k in range(1, PENALTIES + 1)]
    losses = np.zeros((len(penalties), len(y)))
    for k in range(ASIDE):
        aside = part == k
        for i, (w, bias) in enumerate(lasso_path(a[~aside], y[~aside], penalties)):
            losses[i, aside] = np.logaddexp(0, -np.clip(a[aside] @ w + bias, -30, 30) * (2 * y[aside] - 1))
    chosen = int(losses.mean(1).argmin()) + 1
    *_, (w, bias) = lasso_path(a, y, penalties[:chosen])
    kept = np.flatnonzero(np.abs(w) > 1e-9)
    if not len(kept):
        return Model(prior=prior)
    return Model([rules[i] for i in kept], [float(w[i]) for i in kept], float(bias), prior)


def fit_table(labelled: DataFrame, bound: int = FIT_ROWS) -> Model:
    """labelled (saved): key, label, STATISTICS. At most `bound` rows come to the driver."""
    total = labelled.count()
    chosen = labelled.filter(F.pmod("key", F.lit(1 << 30)) < max(1, int(1.1 * bound / total * (1 << 30)))) if total > bound else labelled
    rows = chosen.orderBy("key", "label").limit(bound).select("label", *STATISTICS).toPandas()
    return fit(rows[STATISTICS].to_numpy(dtype=np.float64), rows["label"].to_numpy(dtype=np.float64))


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the statistics of every row; learns from labelled rows outside fold 0 of 5."""
    held_out = F.coalesce(common.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    key = F.xxhash64("doc_id", "text", F.lit("quality")).alias("key")
    measured = common.saved(documents.select("doc_id", held_out, key, text_statistics(F.col("text")).alias("_s")).select("doc_id", "held_out", "key", "_s.*"), "statistics")
    known = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = fit_table(common.saved(measured.filter(~F.col("held_out")).join(known, "doc_id").select("key", "label", *STATISTICS), "labelled"))
    scored = measured.withColumn("score", model.column())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *STATISTICS)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
