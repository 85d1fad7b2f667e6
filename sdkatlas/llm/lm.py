"""LM scoring: a log-bilinear model fitted with noise-contrastive estimation, over word counts of the whole training corpus.

Symbols are the commonest tokens and classes of other words (by their last two bytes): FREQUENT and CLASSES at least, growing with the cube root
of the number of distinct words (the table of normalisers grows with the square of the symbols). The log-bilinear model predicts the next
symbol from the two before it; the normaliser of every pair of symbols is computed once by batched matrix products, so a token costs three look-ups.
A word outside the frequent ones has the probability of its class times its share in it: (c + 0.1) / (sum of (c + 0.1) in the class + 0.1), where the
last 0.1 is for any word not seen. So all probabilities sum to one.

Counts, class sums and the base score are over all training documents. The TOP commonest words go to the tasks in a broadcast of bounded size;
other words are joined with their counts by a shuffle, in which no word is frequent. Texts are taken apart once more, into symbols, which are saved: the
windows are counted and the texts are scored from these. The network is fitted on all windows of all training
documents, as counts of distinct (before-before, before, next) symbols. These are dealt to shards by their hash, and a shard is cut into rows of CHUNK
windows, which is what a task holds at once; in each of EPOCHS rounds every shard is trained from the same weights, row after row, and the
weights are merged by the shards' counts.

Null and empty texts are the end token only. Repeated rows count as often as they occur. An empty training set has N = 0, V = 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.llm import common

ADD = 0.1
FREQUENT, CLASSES, TOP = 768, 255, 150_000
GROWTH = 10.0  # symbols by the cube root of the number of distinct words
SHARD, CHUNK, FLUSH_WINDOWS, ROWS = 2_000_000, 300_000, 3_000_000, 64  # tokens of a shard, different windows of a row, windows counted before they are passed on, symbols merged together
GROUP, PASSED = 50_000, 250_000  # tokens that are looked up or scored together, rows of counted windows that are passed on together
DIMENSIONS, NOISE, EPOCHS, BATCH, LEARN = 24, 96, 3, 2048, 0.15
END = b"\n"  # no word holds white space
FLUSH = 200_000  # words that a task counts before it passes them on
LOCAL = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, parts double, rare array<struct<word:binary,n:int>>, symbols binary"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, parts double"


@dataclass
class Vocabulary:
    index: dict[bytes, int]  # TOP words, the commonest first
    logs: np.ndarray  # log10(c + ADD) of each
    symbols: np.ndarray  # the symbol of each
    tokens: int  # N
    distinct: int  # V
    class_logs: np.ndarray  # log10 of what the class sums to, by symbol; 0 for frequent ones
    frequent: int
    classes: int

    @property
    def size(self) -> int:
        return self.frequent + self.classes + 1

    @property
    def total_log(self) -> float:
        return float(np.log10(self.tokens + ADD * (self.distinct + 1)))


@dataclass
class Network:
    near: np.ndarray  # symbols x DIMENSIONS, of the symbol before
    far: np.ndarray  # of the one before that
    out: np.ndarray
    bias: np.ndarray
    norm: np.ndarray  # natural log of the normaliser, [before, the one before that]


def class_of(word: bytes, frequent: int, classes: int) -> int:
    return frequent + zlib.crc32(word[-2:]) % classes


def symbol_numbers(distinct: int) -> tuple[int, int]:
    """How many frequent words and classes for so many distinct words."""
    grown = round(GROWTH * distinct ** (1 / 3))
    classes = max(CLASSES, grown // 4)
    return max(FREQUENT, grown - classes), classes


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for batch in batches:
        for data in batch["text"]:
            seen.update(data.lower().split())
            if len(seen) > FLUSH:
                yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                seen = Counter()
        seen[END] += len(batch)
    if seen:
        yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From word, n (saved). TOP rows and CLASSES sums come to the driver."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "word").limit(TOP).collect()
    words = [bytes(r[0]) for r in top]
    frequent, classes = symbol_numbers(distinct)
    suffix = F.when(F.length("word") < 2, F.col("word")).otherwise(F.col("word").substr(F.length("word") - 1, F.lit(2)))
    masses = counts.groupBy((F.crc32(suffix) % classes).alias("c")).agg(F.sum(F.col("n") + ADD)).collect()
    mass = np.zeros(frequent + classes + 1)
    for c, m in masses:
        mass[frequent + c] = m
    for word, row in zip(words[:frequent], top, strict=False):
        mass[class_of(word, frequent, classes)] -= row[1] + ADD
    mass[frequent:] = np.maximum(mass[frequent:], 0) + ADD
    logs = np.log10(np.array([r[1] for r in top] or [1.0]) + ADD)
    symbols = np.array([i if i < frequent else class_of(w, frequent, classes) for i, w in enumerate(words)] or [0], dtype=np.int32)
    class_logs = np.r_[np.zeros(frequent), np.log10(mass[frequent:])]
    return Vocabulary({w: i for i, w in enumerate(words)}, logs, symbols, int(tokens), int(distinct), class_logs, frequent, classes)


def symbols_of(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Places in the TOP list (-1 outside) and symbols."""
    places = np.fromiter(map(v.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    symbols = v.symbols[places]
    for i in np.flatnonzero(places < 0).tolist():
        symbols[i] = class_of(words[i], v.frequent, v.classes)
    return places, symbols


def grouped(lists: Iterable[list | np.ndarray]) -> Iterator[tuple[int, list[list | np.ndarray]]]:
    """Where each group begins and its lists, GROUP elements together (or a longer list alone)."""
    held, many, first = [], 0, 0
    for one in lists:
        if held and many + len(one) > GROUP:
            yield first, held
            first, held, many = first + len(held), [], 0
        held.append(one)
        many += len(one)
    if held:
        yield first, held


def begins_of(lists: list[list | np.ndarray]) -> np.ndarray:
    """Where each of the lists, none of them empty, begins when they stand behind each other."""
    return np.cumsum([0, *map(len, lists[:-1])])


def split_texts(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    return ([*data.lower().split(), END] for data in texts)


def symbol_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<i4"


def symbol_lists(batch: pd.DataFrame, v: Vocabulary) -> Iterator[np.ndarray]:
    """The symbols of each document, as they were saved or from its text."""
    if "symbols" in batch:
        return (np.frombuffer(data, symbol_type(v.size)) for data in batch["symbols"])
    return (symbols_of(words, v)[1] for words in split_texts(batch["text"]))


def first_state(log_noise: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights and Adagrad's sums as one matrix: a row for each symbol (r, q, b, then their sums) and a last one for c."""
    rng, size = np.random.default_rng(seed), len(log_noise)
    state = np.zeros((size + 1, 2 * (2 * DIMENSIONS + 1)), dtype=np.float32)
    state[:size, :DIMENSIONS], state[:size, DIMENSIONS:2 * DIMENSIONS] = rng.normal(0, 0.1, (size, DIMENSIONS)), rng.normal(0, 0.1, (size, DIMENSIONS))
    state[:size, 2 * DIMENSIONS], state[size, :2 * DIMENSIONS], state[:, 2 * DIMENSIONS + 1:] = log_noise, 1.0, 1e-2
    return state


def parts_of(state: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The weights and Adagrad's sums, as own arrays."""
    d, half = DIMENSIONS, state.shape[1] // 2
    cut = lambda m: {"r": m[:-1, :d].copy(), "c": m[-1, :2 * d].reshape(2, d).copy(), "q": m[:-1, d:2 * d].copy(), "b": m[:-1, 2 * d].copy()}
    return cut(state[:, :half]), cut(state[:, half:])


def trained(state: np.ndarray, log_noise: np.ndarray, windows: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """One pass over windows (rows of the one before that, before, next) that occur `counts` times: noise-contrastive estimation with shared
    noise in each batch, Adagrad. A window of more than twice the mean count is dealt to several batches, so that none outweighs its batch."""
    if not len(windows):
        return state
    rng, size = np.random.default_rng(seed), len(log_noise)
    cumulative = np.cumsum(np.exp(log_noise))
    handicap = (np.log(NOISE) + log_noise).astype(np.float32)
    times = np.ceil(counts / (2 * counts.mean())).astype(np.int64)
    order = rng.permutation(np.repeat(np.arange(len(windows)), times))
    weights = (counts / times / (counts.sum() / len(order))).astype(np.float32)
    w, grown = parts_of(state)

    def move(key: str, at: np.ndarray | slice, gradient: np.ndarray) -> None:
        if isinstance(at, np.ndarray):  # sum what falls on the same row
            order = np.argsort(at, kind="stable")
            at = at[order]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            at, gradient = at[starts], np.add.reduceat(gradient[order], starts, axis=0)
        grown[key][at] += gradient**2
        w[key][at] += LEARN * gradient / np.sqrt(grown[key][at])

    for start in range(0, len(order), BATCH):
        rows = order[start:start + BATCH]
        far, near, target = windows[rows].T
        share = weights[rows] / np.float32(len(rows))
        others = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), size - 1)
        r_near, r_far = w["r"][near], w["r"][far]
        context = r_near * w["c"][0] + r_far * w["c"][1]
        q_target, q_others = w["q"][target], w["q"][others]
        true = (context * q_target).sum(1) + (w["b"][target] - handicap[target])
        false = context @ q_others.T
        false += w["b"][others] - handicap[others]
        np.clip(false, -30, 30, out=false)
        np.exp(np.negative(false, out=false), out=false)
        false += 1
        g_true = share / (1 + np.exp(np.clip(true, -30, 30)))
        g_false = np.divide(-share[:, None], false, out=false)
        back = g_true[:, None] * q_target + g_false @ q_others
        move("q", np.r_[target, others], np.r_[g_true[:, None] * context, g_false.T @ context])
        move("b", np.r_[target, others], np.r_[g_true, g_false.sum(0)])
        move("r", np.r_[near, far], np.r_[back * w["c"][0], back * w["c"][1]])
        move("c", slice(None), np.stack([(back * r_near).sum(0), (back * r_far).sum(0)]))
    half, d = state.shape[1] // 2, DIMENSIONS
    out = state.copy()
    for part, at in ((w, 0), (grown, half)):
        out[:-1, at:at + d], out[:-1, at + d:at + 2 * d], out[:-1, at + 2 * d], out[-1, at:at + 2 * d] = part["r"], part["q"], part["b"], part["c"].ravel()
    return out


def noise_of(unigram: np.ndarray) -> np.ndarray:
    """Natural logs of the noise distribution, from the symbols' counts."""
    smoothed = unigram + 0.5
    return np.log(smoothed / smoothed.sum())


def normalisers(w: dict[str, np.ndarray], near: np.ndarray) -> np.ndarray:
    """Natural logs of the normalisers of all pairs whose nearer symbol is in `near`."""
    norm, far_of = np.empty((len(near), len(w["b"])), dtype=np.float32), w["r"] * w["c"][1]
    for k, i in enumerate(near):
        scores = (w["r"][i] * w["c"][0] + far_of) @ w["q"].T + w["b"]
        top = scores.max(1)
        norm[k] = top + np.log(np.exp(scores - top[:, None]).sum(1))
    return norm


def network_of(w: dict[str, np.ndarray], norm: np.ndarray) -> Network:
    return Network(w["r"] * w["c"][0], w["r"] * w["c"][1], w["q"], w["b"], norm)


def fit(windows: np.ndarray, size: int, seed: int = 7) -> Network:
    """The network of windows that are all here, each counted once: EPOCHS rounds of a single shard."""
    log_noise = noise_of(np.bincount(windows[:, 2], minlength=size) if len(windows) else np.zeros(size))
    state = first_state(log_noise, seed)
    for k in range(EPOCHS):
        state = trained(state, log_noise, windows, np.ones(len(windows)), seed + k)
    w = parts_of(state)[0]
    return network_of(w, normalisers(w, np.arange(size)))


def split_codes(codes: np.ndarray, size: int) -> np.ndarray:
    return np.stack([codes // (size * size), codes // size % size, codes % size], axis=1)


def counted_windows(training: DataFrame, shared, start: int) -> DataFrame:
    """window ((far * size + near) * size + next), n: over all windows of all training documents, each task's part summed."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, held, many = shared.value, [], 0

        def summed() -> Iterator[pd.DataFrame]:
            codes, n = np.unique(np.concatenate(held or [np.zeros(0, np.int64)]), return_counts=True)
            for i in range(0, len(codes), PASSED):
                yield pd.DataFrame({"window": codes[i:i + PASSED], "n": n[i:i + PASSED].astype(np.int64)})

        for batch in batches:
            for _, lists in grouped(symbol_lists(batch, v)):
                far, near, target = windows_of(np.concatenate(lists), start, begins_of(lists)).astype(np.int64).T
                held.append((far * v.size + near) * v.size + target)
                many += len(target)
                if many >= FLUSH_WINDOWS:
                    yield from summed()
                    held, many = [], 0
        yield from summed()

    return training.mapInPandas(count, "window long, n long")


def packed_counts(windows: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted windows as differences, and their counts: small numbers, which compress well."""
    return zstandard.ZstdCompressor(level=1).compress(np.r_[np.diff(windows, prepend=0), counts].astype("<i8").tobytes())


def unpacked_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")
    return np.cumsum(numbers[:len(numbers) // 2]), numbers[len(numbers) // 2:]


def window_chunks(training: DataFrame, shared, shards: int) -> DataFrame:
    """shard, chunk, data (packed_counts): all windows, CHUNK different ones in a row. One shuffle, by shard; Spark sorts and spills, and a task
    holds one row at a time."""
    size = shared.value.size

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        shard, chunk, many = None, 0, 0

        def row() -> pd.DataFrame:
            rows = pd.concat(held).sort_values("window")
            return pd.DataFrame({"shard": [shard], "chunk": [chunk], "data": [packed_counts(rows["window"].to_numpy(), rows["n"].to_numpy())]})

        for batch in batches:
            # cut where a new shard begins
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(batch["shard"].to_numpy())) + 1):
                rows = batch.iloc[part]
                if len(rows) and shard is not None and (rows["shard"].iloc[0] != shard or many >= CHUNK):
                    yield row()
                    chunk = chunk + 1 if rows["shard"].iloc[0] == shard else 0
                    held, many = [], 0
                if len(rows):
                    shard, many = int(rows["shard"].iloc[0]), many + len(rows)
                    held.append(rows[["window", "n"]])
        if held:
            yield row()

    # mixed by a hash that says nothing of the window, so that every row is a sample of the shard
    rows = counted_windows(training, shared, size - 1).withColumn("shard", F.pmod(F.xxhash64("window", F.lit("shard")), F.lit(shards)).cast("int"))
    summed = rows.repartition(shards, "shard").groupBy("shard", "window").agg(F.sum("n").alias("n"))
    mixed = summed.sortWithinPartitions("shard", F.xxhash64("window", F.lit("order")))
    return mixed.select("shard", "window", "n").mapInPandas(pack, "shard int, chunk int, data binary")


def fit_table(training: DataFrame, shared) -> Network:
    """The network of all training documents' windows. What a row holds is bounded, the number of shards grows with the tokens."""
    spark, v = training.sparkSession, shared.value
    size = v.size
    packed = common.saved(window_chunks(training, shared, max(1, -(-v.tokens // SHARD))), "lm-windows")

    def count_next(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(size)
        for batch in batches:
            for row in batch.itertuples():
                codes, n = unpacked_counts(row.data)
                sums += np.bincount(codes % size, weights=n, minlength=size)
        yield pd.DataFrame({"symbol": np.arange(size), "n": sums})

    unigram = np.zeros(size)
    for symbol, n in packed.mapInPandas(count_next, "symbol long, n double").groupBy("symbol").agg(F.sum("n")).collect():
        unigram[symbol] = n
    log_noise = noise_of(unigram)
    state = first_state(log_noise)
    width, blocks = state.shape[1], -(-(size + 1) // ROWS)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) * m for x, m in zip(group["part"], group["mass"], strict=True))
        return pd.DataFrame({"block": group["block"].iloc[:1].to_numpy(), "part": [(total / group["mass"].sum()).astype("<f4").tobytes()]})

    for k in range(EPOCHS):
        now = spark.sparkContext.broadcast(state)

        def train(batches: Iterator[pd.DataFrame], now=now, k=k) -> Iterator[pd.DataFrame]:
            total, mass, first, shard, mine, of_shard = None, 0.0, 0, None, None, 0.0

            def done() -> None:
                nonlocal total, mass, first
                part = mine.astype(np.float64) * of_shard
                first = shard if total is None else min(first, shard)
                total, mass = part if total is None else total + part, mass + of_shard

            for batch in batches:
                for row in batch.itertuples():
                    if row.shard != shard:
                        if shard is not None:
                            done()
                        shard, mine, of_shard = row.shard, now.value, 0.0
                    codes, n = unpacked_counts(row.data)
                    mine = trained(mine, log_noise, split_codes(codes, size), n.astype(np.float64), 100_003 * k + 1009 * row.shard + row.chunk + 7)
                    of_shard += float(n.sum())
            if shard is not None:
                done()
                mean = (total / mass).astype("<f4")
                yield pd.DataFrame({"block": np.arange(blocks), "shard": first, "mass": mass, "part": [mean[i * ROWS:(i + 1) * ROWS].tobytes() for i in range(blocks)]})

        parts = packed.mapInPandas(train, "block int, shard int, mass double, part binary")
        merged = parts.groupBy("block").applyInPandas(merge, "block int, part binary").collect()
        if merged:
            state = np.concatenate([np.frombuffer(bytes(r[1]), "<f4") for r in sorted(merged)]).reshape(-1, width)
        now.unpersist()
    w = parts_of(state)[0]
    sent = spark.sparkContext.broadcast(w)

    def normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"].tolist():
                yield pd.DataFrame({"id": [i], "norm": [normalisers(sent.value, np.array([i]))[0].tobytes()]})

    made = spark.range(0, size, 1, max(1, size // ROWS)).mapInPandas(normalise, "id long, norm binary").collect()
    norm = np.empty((size, size), dtype=np.float32)
    for i, data in made:
        norm[i] = np.frombuffer(bytes(data), np.float32)
    return network_of(w, norm)


def windows_of(symbols: np.ndarray, start: int, begins: np.ndarray | int = 0) -> np.ndarray:
    """Rows of the one before that, before, next; of several documents behind each other where it says where they begin."""
    symbols = symbols.astype(np.int32)
    padded = np.r_[start, start, symbols].astype(np.int32)
    far, near = padded[:-2].copy(), padded[1:-1].copy()
    near[begins] = start
    seconds = np.atleast_1d(begins) + 1
    far[begins] = far[seconds[seconds < len(far)]] = start
    return np.stack([far, near, symbols], axis=1)


def log10_probabilities(symbols: np.ndarray, network: Network, start: int, begins: np.ndarray | int = 0) -> np.ndarray:
    far, near, target = windows_of(symbols, start, begins).T
    scores = np.einsum("ij,ij->i", network.near[near] + network.far[far], network.out[target]) + network.bias[target]
    return (scores - network.norm[near, far]).astype(np.float64) / np.log(10)


def local_rows(texts: Iterable[bytes], v: Vocabulary) -> Iterator[tuple]:
    """What of a text needs the TOP words only: n_tokens, known, logs, parts (without the network's), rare, symbols."""
    for _, lists in grouped(split_texts(texts)):
        words, begins = [w for one in lists for w in one], begins_of(lists)
        places, symbols = symbols_of(words, v)
        known = places >= 0
        logs = np.where(known, v.logs[places], 0.0)
        parts = np.where(symbols >= v.frequent, logs, 0.0) - v.class_logs[symbols]
        rare: list[Counter] = [Counter() for _ in lists]
        unknown = np.flatnonzero(~known)
        for i, k in zip(unknown.tolist(), (np.searchsorted(begins, unknown, side="right") - 1).tolist(), strict=True):
            rare[k][words[i]] += 1
        saved = np.split(symbols.astype(symbol_type(v.size)), begins[1:])
        sums = (np.add.reduceat(x, begins).tolist() for x in (known.astype(np.int64), logs, parts))
        for one, a, b, c, r, x in zip(lists, *sums, rare, saved, strict=True):
            yield len(one), a, b, c, [{"word": w, "n": n} for w, n in r.items()], x.tobytes()


def score_documents(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.coalesce(common.fold(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"), common.utf8(F.col("text")).alias("text"))
    training = docs.filter(~F.col("held_out")).select("text")
    counts = common.saved(training.mapInPandas(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    v = vocabulary(counts)
    shared, start = spark.sparkContext.broadcast(v), v.size - 1

    def taken_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, names = TaskContext.get().partitionId() << 33, [c.split()[0] for c in LOCAL.split(", ")]
        for batch in batches:
            rows = [(row + k, doc_id, held_out, *rest) for k, (doc_id, held_out, rest) in
                    enumerate(zip(batch["doc_id"], batch["held_out"], local_rows(batch["text"], shared.value), strict=True))]
            row += len(rows)
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    local = common.saved(docs.mapInPandas(taken_apart, LOCAL), "lm-local")
    network = spark.sparkContext.broadcast(fit_table(local.filter(~F.col("held_out")).select("symbols"), shared))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = batch["parts"].to_numpy(copy=True)
            for first, lists in grouped(symbol_lists(batch, shared.value)):
                begins = begins_of(lists)
                parts[first:first + len(lists)] += np.add.reduceat(log10_probabilities(np.concatenate(lists), network.value, start, begins), begins)
            yield batch.drop(columns="symbols").assign(parts=parts).astype({"doc_id": "Int64"})

    scored = local.drop("rare").mapInPandas(score, SCORED)
    rare = local.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("k"))
    joined = rare.join(counts.withColumnRenamed("n", "c"), "word", "left")
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("seen"),
                                     F.sum(F.col("k") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + ADD)).alias("rare_logs"))
    all_ = scored.join(sums, "row", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return all_.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
                       (F.col("logs") + rare_logs - F.col("n_tokens") * F.lit(v.total_log)).alias("base_score"), (F.col("parts") + rare_logs).alias("score"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"))
