"""Toxicity by compression distance: two zstandard dictionaries, one trained on ordinary and one on toxic text.

The toxic dictionary is trained on the parts of toxic texts that ordinary texts lack, and holds all of them (TOXIC_BYTES at least); the ordinary one on ordinary text, and on those
ordinary words that the toxic dictionary would shorten. A window is one word, written REPEAT times so that fixed parts of a frame cancel.
Each window is compressed with either dictionary; the bytes that the toxic one saves are its gain. Thresholds on the gains are
calibrated by logistic regression on the training rows. Words repeat, so gains are kept in a bounded table in each Python worker.

Null and empty texts have no window and get the score of a text without gain. Ties, repeated rows and further columns don't matter: each
row is scored by itself. Without training rows of both classes every score is the training share of toxic rows (0 if there is none).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.llm import common

#: Labelled documents that fit the model at most: toxic, ordinary. Chosen by a hash of doc_id over the whole table.
FIT_TOXIC, FIT_ORDINARY = 2500, 4000
REPEAT = 8
GRAM = 5  # bytes; also the least match
ORDINARY_BYTES, TOXIC_BYTES, HARD_BYTES = 64 << 10, 2 << 10, 64 << 10
KEPT_WORDS = 400_000  # entries of a worker's table of gains
LONGEST = 4096  # a longer run of letters is cut into windows that overlap
LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    prior: float


def windows(data: bytes) -> list[bytes]:
    """Runs of letters (bytes over 127 are letters); together they hold every letter of the text."""
    words = data.translate(LETTERS).split()
    if len(data) > LONGEST and any(len(w) > LONGEST for w in words):
        words = [w[i:i + LONGEST] for w in words for i in range(0, len(w), LONGEST - 64)]
    return words


class Gains(dict):
    """window -> bytes saved by the toxic dictionary; features() tells what a text's windows say."""

    def __init__(self, model: Model):
        parameters = zstandard.ZstdCompressionParameters(compression_level=19, strategy=zstandard.STRATEGY_BTULTRA2, min_match=GRAM, window_log=17,
                                                         write_content_size=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.compressors = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                                     compression_params=parameters) for d in (model.ordinary, model.toxic)]

    def __missing__(self, window: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ordinary, toxic = self.compressors
        frame = (b" " + window) * REPEAT if len(window) < 256 else window
        gain = self[window] = len(ordinary.compress(frame)) - len(toxic.compress(frame)) if len(window) >= GRAM - 1 else 0
        return gain

    def features(self, data: bytes) -> tuple[float, ...]:
        words = windows(data)
        clear = [g for g in map(self.__getitem__, words) if g >= 1]
        strong = sum(g >= 2 for g in clear)
        return (1.0, float(bool(clear)), float(bool(strong)), math.log1p(len(clear)), math.log1p(strong), math.log1p(len(words)) / 10,
                min(1.0, 20.0 * len(clear) / max(1, len(words))))


def _grams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data.lower(), dtype=np.uint8).astype(np.uint64)
    if len(b) < GRAM:
        return np.zeros(0, np.uint64)
    return sum(b[i:len(b) - GRAM + 1 + i] << np.uint64(8 * i) for i in range(GRAM))


def _apart(texts: list[bytes]) -> list[bytes]:
    """One of each set of near copies (those with the same least word-window hash), or a copied text would count as many."""
    kept: dict[int, bytes] = {}
    for text in texts:
        words = text.lower().split()
        kept.setdefault(min((zlib.crc32(b" ".join(words[i:i + 5])) for i in range(max(1, len(words) - 4))), default=0), text)
    return list(kept.values())


def telling_spans(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The word parts of toxic texts whose byte n-grams twenty times as many toxic as ordinary texts hold."""
    toxic, ordinary = _apart(toxic), _apart(ordinary)
    counts: list[Counter] = []
    for texts in (toxic, ordinary):
        seen: Counter = Counter()
        for text in texts:
            seen.update(np.unique(_grams(text)).tolist())
        counts.append(seen)
    least = max(3, len(toxic) // 200)
    ratio = 20 * len(toxic) / max(1, len(ordinary))
    telling = np.array(sorted(g for g, n in counts[0].items() if n >= least and n >= ratio * (counts[1].get(g, 0) + 0.5)), dtype=np.uint64)
    spans = []
    for text in toxic:
        hit = np.flatnonzero(np.isin(_grams(text), telling))
        if len(hit):
            cuts = np.flatnonzero(np.diff(hit) > 1) + 1
            spans += [part for run in np.split(hit, cuts) for part in text[run[0]:run[-1] + GRAM].lower().split() if len(part) >= 4]
    return spans


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the samples as they are, the commonest last, where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(s for s, _ in Counter(samples).most_common(size // 16))[:size]


def toxic_dictionary(spans: list[bytes]) -> bytes:
    """Trained at the size that the distinct spans need; those that the training left out come first."""
    distinct = sorted(set(spans))
    found = _trained([b" ".join(spans[i:i + 4]) for i in range(0, len(spans), 4)], max(TOXIC_BYTES, 2 * sum(len(s) + 1 for s in distinct)))
    return b" ".join([*(s for s in distinct if s not in found), found])


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    total = len(toxic) + len(ordinary)
    prior = len(toxic) / total if total else 0.0
    if not toxic or not ordinary:
        return Model(b"", b"", (), prior)
    plain = [b" ".join(words[i:i + 16]) for words in map(windows, _apart(ordinary)) for i in range(0, len(words), 16)]
    spans = telling_spans(toxic, ordinary)
    model = Model(_trained(plain, ORDINARY_BYTES), toxic_dictionary(spans), (), prior)
    common_words = Counter(w for text in ordinary for w in set(windows(text)))
    gains = Gains(model)
    hard = sorted((w for w, n in common_words.items() if n >= 2 and gains[w] >= 1), key=lambda w: (common_words[w], w))
    model.ordinary = b" ".join([model.ordinary, *hard])[-(ORDINARY_BYTES + HARD_BYTES):]
    gains = Gains(model)
    x = np.array([gains.features(t) for t in toxic + ordinary])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
    model.weights = tuple(w)
    return model


def fit_table(labelled: DataFrame) -> Model:
    """labelled: doc_id, text, toxic. The bounded sample of either class comes to the driver; counts are over all labelled rows."""
    counts = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    texts: dict[int, list[bytes]] = {}
    for label, bound in ((1, FIT_TOXIC), (0, FIT_ORDINARY)):
        rows = common.share(labelled.filter(F.col("toxic") == label), "doc_id", bound, counts.get(label, 0))
        texts[label] = [bytes(r[0]) for r in rows.select(common.utf8(F.col("text")).alias("text")).orderBy("text").collect()]
    return fit(texts[1], texts[0])


def toxicity_score(spark: SparkSession, model: Model, text: Column) -> Column:
    """Column of scores, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        gains, w = (Gains(m), np.array(m.weights)) if m.weights else (None, None)
        for batch in batches:
            if gains is None:
                yield pd.Series(np.full(len(batch), m.prior))
                continue
            x = np.array([gains.features(d) for d in batch]).reshape(len(batch), -1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) if len(batch) else np.zeros(0))

    return score(common.utf8(text))


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learns from labelled rows outside fold 0 of 5. Labels that occur twice count once."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", F.coalesce(common.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"))
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = fit_table(docs.filter(~F.col("held_out")).join(known, "doc_id").select("doc_id", "text", "toxic"))
    scored = docs.select("doc_id", "held_out", toxicity_score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
