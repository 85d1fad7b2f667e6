"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier of byte n-grams predicts one bit: the log ratio of an n-gram's share in the languages
with that bit set and in the others. Decoding adds, over the bits, the loss of each language's code bit, weighted by how well the bit's
classifier separates the languages; the nearest codeword wins and a small lead over the second marks the text as ambiguous.

The n-gram counts come from all training rows: each task counts its rows by language, and counts are summed by a shuffle, so the
driver gets languages x FEATURES numbers at most, whatever the size of the corpus. Null text or text without a letter: `und`, score 0.
Ties go to the first language in sorted order. Without training rows every text is `und`. Rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.llm import common

FEATURES = 1 << 16  # byte pairs as they are, byte triples hashed
SMOOTHING = 0.5
EXHAUSTIVE_UP_TO = 5  # languages; more get 4 random bits each
AMBIGUOUS = 0.02  # lead of the nearest codeword, as a share of all bit weights
SHARPNESS = 12.0
REJECTED = 0.4  # a stage rejects texts whose best language scores less, or that have none
FOLD = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 and -1
    weights: np.ndarray  # 2 * FEATURES x bits
    offsets: np.ndarray  # bits
    trust: np.ndarray  # bits


def code_matrix(n: int) -> np.ndarray:
    """Exhaustive codes for few languages, else seeded random ones with the widest least distance of several draws."""
    if n <= EXHAUSTIVE_UP_TO:
        columns = [[1] + [1 if bits >> i & 1 else -1 for i in range(n - 1)] for bits in range(2 ** (n - 1) - 1)]
        return np.array(columns or [[1] * n], dtype=np.float32).T.reshape(n, -1)
    best, widest = None, -1
    for seed in range(50):
        draw = np.where(np.random.default_rng(seed).random((n, 4 * n)) < 0.5, -1, 1).astype(np.float32)
        draw = draw[:, np.abs(draw.sum(0)) < n]
        least = min(int((draw[i] != draw[j]).sum()) for i in range(n) for j in range(i))
        if least > widest:
            best, widest = draw, least
    return best


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the byte pairs and triples of folded text; a gram of white space only counts nothing (it is gram 0x2020)."""
    wide = data.astype(np.uint32)
    pairs = wide[:-1] << np.uint32(8) | wide[1:]
    triples = (wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    return pairs, triples + np.uint32(FEATURES)


def _folded(data: bytes) -> np.ndarray:
    return np.frombuffer(b" " + data.translate(FOLD) + b"  ", dtype=np.uint8)


def gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) rows to (lang, gram, n) rows, one for each gram of a language in this task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, data in zip(batch["lang"], batch["text"], strict=True):
            pairs, triples = grams(_folded(data))
            counts = sums.setdefault(lang, np.zeros(2 * FEATURES, dtype=np.int64))
            if len(pairs) > 4096:
                counts += np.bincount(np.concatenate((pairs, triples)), minlength=2 * FEATURES)
            else:
                np.add.at(counts, pairs, 1)
                np.add.at(counts, triples, 1)
    for lang, counts in sums.items():
        found = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": common.texts([lang] * len(found)), "gram": found.astype(np.int32), "n": counts[found]})


def fit(counts: dict[str, np.ndarray]) -> Model | None:
    languages = sorted(counts)
    if not languages:
        return None
    codes = code_matrix(len(languages))
    shares = np.stack([(counts[lang] + SMOOTHING) / (counts[lang].sum() + SMOOTHING * 2 * FEATURES) for lang in languages])
    usage = np.stack([counts[lang] / max(1, counts[lang].sum()) for lang in languages])
    weights, offsets, trust = [], [], []
    for code in codes.T:
        if (code > 0).all() or (code < 0).all():
            ratio = np.zeros(shares.shape[1])
        else:
            ratio = np.clip(np.log(shares[code > 0].mean(0)) - np.log(shares[code < 0].mean(0)), -4, 4)
        means = usage @ ratio  # what a text of each language scores on average
        high, low = (means[code > 0].min() if (code > 0).any() else 0.0), (means[code < 0].max() if (code < 0).any() else 0.0)
        scale = max((high - low) / 2, 1e-3)
        weights.append(ratio / scale)
        offsets.append(-(high + low) / 2 / scale)
        trust.append(max(high - low, 1e-3))
    return Model(languages, codes, np.array(weights, dtype=np.float32).T.copy(), np.array(offsets), np.array(trust) / np.sum(trust))


def fit_table(rows: DataFrame) -> Model | None:
    """rows: text, lang. All of them are counted."""
    known = rows.filter(F.col("lang").isNotNull()).select("lang", common.utf8(F.col("text")).alias("text"))
    summed = known.mapInPandas(gram_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = summed.groupBy("lang").agg(F.collect_list("gram").alias("grams"), F.collect_list("n").alias("n")).collect()
    counts = {}
    for r in found:
        counts[r["lang"]] = np.zeros(2 * FEATURES, dtype=np.int64)
        counts[r["lang"]][np.array(r["grams"])] = np.array(r["n"])
    for r in known.select("lang").distinct().collect():
        counts.setdefault(r[0], np.zeros(2 * FEATURES, dtype=np.int64))
    return fit(counts)


def has_letter(data: bytes) -> bool:
    return ASCII_LETTER.search(data) is not None or any(c.isalpha() for c in data.decode("utf-8"))


def decode(model: Model, texts: list[bytes]) -> pd.DataFrame:
    """lang_pred, score, ambiguous of each text."""
    bits = np.zeros((len(texts), model.codes.shape[1]))
    for i, data in enumerate(texts):
        folded = _folded(data)
        total = np.zeros(bits.shape[1])
        for start in range(0, len(folded) - 2, 1 << 18):
            pairs, triples = grams(folded[start:start + (1 << 18) + 2])
            if len(pairs) > 60_000:
                total += np.bincount(np.concatenate((pairs[:-1], triples)), minlength=2 * FEATURES) @ model.weights
            else:
                both = np.concatenate((pairs[:-1], triples))
                total += np.ones(len(both), dtype=np.float32) @ model.weights.take(both, axis=0)
        bits[i] = total / (2 * (len(folded) - 2)) + model.offsets
    losses = np.log1p(np.exp(-np.clip(bits[:, None, :] * model.codes[None], -20, 20))) @ model.trust  # texts x languages
    order = np.argsort(losses, axis=1, kind="stable")
    first = order[:, 0]
    least = losses[np.arange(len(texts)), first]
    lead = losses[np.arange(len(texts)), order[:, 1]] - least if len(model.languages) > 1 else np.ones(len(texts))
    likely = np.exp(-SHARPNESS * (losses - least[:, None]))
    letters = np.array([has_letter(d) for d in texts], dtype=bool)
    names = np.array(model.languages, dtype=object)[first] if len(texts) else np.array([], dtype=object)
    return pd.DataFrame({"lang_pred": common.texts(np.where(letters, names, "und")), "score": np.where(letters, 1 / likely.sum(1), 0.0), "ambiguous": ~letters | (lead < AMBIGUOUS)})


def language_of(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """Column of struct (lang_pred, score, ambiguous)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.held(None)
        for batch in batches:
            if shared.value is None or not len(batch):
                yield pd.DataFrame({"lang_pred": common.texts(["und"] * len(batch)), "score": [0.0] * len(batch), "ambiguous": [True] * len(batch)})
            else:
                yield decode(shared.value, list(batch))

    return predict(common.utf8(text))


def held_out() -> Column:
    return F.coalesce(common.fold(F.col("doc_id"), 4) == 2, F.lit(False))


def fit_documents(documents: DataFrame) -> Model | None:
    """Learns from rows with a lang outside fold 2 of 4."""
    return fit_table(documents.filter(~held_out()).select("text", "lang"))


def identify_languages(documents: DataFrame) -> DataFrame:
    model = fit_documents(documents)
    found = documents.select("doc_id", held_out().alias("held_out"), language_of(documents.sparkSession, model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.*")


def keep_known(documents: DataFrame) -> DataFrame:
    """The documents whose language was found, with their own columns: texts without letters go, and those of which no language has REJECTED."""
    names = common.bounded_batches(documents).columns
    model = fit_documents(documents)
    found = documents.select(F.struct(*names).alias("_doc"), language_of(documents.sparkSession, model, F.col("text")).alias("_found"))
    return found.filter((F.col("_found.lang_pred") != "und") & (F.col("_found.score") >= REJECTED)).select("_doc.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(common.table(spark, sf_dir, "documents"))
