"""Whitening, centroid clustering and the rule ensemble, held against brute force on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sdkatlas.llm import centroids, common, rules, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster int, n long, component int"
EXTRA = (0, "x", 7, 8, 9)


def vectors(spark, rows):
    common.table(spark, SF, "embeddings")
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], SCHEMA)


def odd_rows(size, many=60, seed=4):
    rng = np.random.default_rng(seed)
    plain = [(i, rng.normal(size=size).round(3).tolist()) for i in range(many)]
    gap = [0.5] * (size - 1)
    return plain, [*plain, (100, None), (101, [None, *gap]), (102, [math.nan, *gap]), (103, [math.inf, *gap]), (104, []), (105, gap),
                   (3, plain[3][1]), (106, plain[3][1]), (None, plain[4][1]), (None, rng.normal(size=size).tolist())]


def random_basis(rng, d):
    return np.linalg.qr(rng.normal(size=(d, d)))[0]


def test_rank_one_updates_are_exact():
    rng = np.random.default_rng(0)
    for trial in range(300):
        d = int(rng.integers(1, 20))
        values = np.sort(rng.choice([0, 0, 1, 1, 2, 5, 1e3, 1e-9], d) + (rng.random(d) if trial % 2 else 0))
        basis = random_basis(rng, d)
        z = rng.normal(size=d) * rng.choice([1, 1e-8, 100, 0])
        if trial % 3 == 0:
            z = basis @ np.where(rng.random(d) < 0.5, 0, basis.T @ z)
        rho = rng.random()
        new, turned = whitening.rank_one(values, basis, z, rho)
        whole = (basis * values) @ basis.T + rho * np.outer(z, z)
        assert (np.diff(new) >= 0).all() and np.abs(turned.T @ turned - np.eye(d)).max() < 1e-11
        assert np.abs((turned * new) @ turned.T - whole).max() <= 1e-11 * max(np.abs(whole).max(), 1e-300)


def test_deflation_leaves_untouched_components():
    values, basis = np.array([1.0, 1.0, 2.0, 3.0]), np.eye(4)
    w = np.array([1.0, 1.0, 0.0, 1.0])
    used = whitening.deflate(values, basis, w, 1.0)
    assert used.tolist() == [1, 3] and w[0] == 0 and abs(w[1] - 2**0.5) < 1e-15
    new, turned = whitening.rank_one(values, np.eye(4), np.array([1.0, 1.0, 0.0, 1.0]), 1.0)
    assert 1.0 in new.tolist() and 2.0 in new.tolist()


def test_spectra_combine_to_that_of_all():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (200, 9))
    parts = []
    for block in np.split(x, [1, 40, 41, 120]):
        s, mean = whitening.Spectrum.empty(9), np.zeros(9)
        for row in block.astype(float):
            s.add(row, mean)
            mean += (row - mean) / s.n
        s.sums = block.sum(0).tolist()
        parts.append(s)
    first, *others = parts
    for other in others:
        first.combine(other)
    expected = np.cov(x.T, bias=True) * 200
    assert first.n == 200 and first.sums == x.sum(0).tolist()
    assert np.abs((first.vectors * first.values) @ first.vectors.T - expected).max() < 1e-9 * np.abs(expected).max()


def whitened_by_hand(rows, size, components=4):
    ints = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == size and all(e is not None and math.isfinite(e) for e in v)]
    x = np.unique(np.stack([v for _, v in ints]), axis=0)
    n, s = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.atleast_2d(np.cov(x.T.astype(float), bias=True)))
    values, axes = values[::-1], axes[:, ::-1]
    return n, {str(i): int(((n * v - s) ** 2).sum()) for i, v in ints}, [(i, (v - s / n) @ axes[:, :components] / np.sqrt(values[:components])) for i, v in ints], (values / values.sum())[:components]


@pytest.mark.parametrize("size", [3, 12])
def test_whitening(spark, size, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)  # several rounds of combining
    plain, rows = odd_rows(size)
    frame = vectors(spark, rows).repartition(7)
    found = whitening.whiten(frame).collect()
    n, deviation, white, explained = whitened_by_hand(rows, size)
    k = min(4, size)
    assert len(found) == k * len(white) and {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1
    assert found[0]["identity_error"] < 1e-9
    for r in found:
        if r["vec_id"] is not None:
            assert r["deviation"] == deviation[str(r["vec_id"])]
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-12
    for c in range(k):
        expected = Counter((str(i), round(w[c], 8)) for i, w in white)
        flipped = Counter((str(i), round(-w[c], 8) + 0.0) for i, w in white)
        assert Counter((str(r["vec_id"]), round(r["whitened"], 8)) for r in found if r["component"] == c + 1) in (expected, flipped)


def test_whitening_without_variance(spark):
    found = whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in found) == [(i, c, 1, 0, 0.0, 0.0, 1.0) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(vectors(spark, [(i, [float(i), float(i)]) for i in range(5)])).collect()
    assert all(abs(r["whitened"]) < 1e-12 for r in line if r["component"] == 2) and abs(line[0]["explained"] - 1) < 1e-12
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 0.0])])).collect()
    assert len(huge) == 6 and any(r["deviation"] is None for r in huge)
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0 and whitening.whiten(vectors(spark, [])).count() == 0


def clustered_by_hand(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * float(np.float32(e))) for e in v]) for i, v in rows if v is not None and len(v) == size and all(e is not None and math.isfinite(e) for e in v)]
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centers = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centers = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    limit = lambda v: v if v < 2**63 else None
    return sorted(((i, j, limit(d), limit(inertia[j]), limit(sum(inertia.values())), digest[j]) for i, d, j in found), key=str)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("scale", [1.0, 0.002, 1e9])
def test_centroids(spark, scale):
    """Wide spread, many ties (few different integers), and integers for which products of 64 bits are too short."""
    _, rows = odd_rows(64, many=90, seed=6)
    rows = [(i, v if v is None else [e if e is None else e * scale for e in v]) for i, v in rows]
    found = centroids.cluster_vectors(vectors(spark, rows).repartition(5))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str) == clustered_by_hand(rows)


def test_tournament_is_the_nearest():
    rng = np.random.default_rng(8)
    for _ in range(50):
        x, c = rng.integers(-2, 3, (40, 3)), rng.integers(-2, 3, (int(rng.integers(1, 9)), 3))
        found = centroids.tournament(x, *centroids.bisectors(c.tolist()))
        assert (found == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()


def test_centroids_few_and_none(spark):
    few = [(1, [0.0] * 64), (2, [1.0] * 64), (2, [1.0] * 64)]
    found = centroids.cluster_vectors(vectors(spark, few)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=str) == clustered_by_hand(few)
    none = centroids.cluster_vectors(vectors(spark, [(1, None), (2, [1.0])]))
    assert none.columns == COLUMNS and none.count() == 0


def statistics_by_hand(text):
    words = text.split()
    blocks = [words[i:i + 100] for i in range(0, len(words), 100)]
    return len(words), sum(len(set(b)) for b in blocks) / len(words), max(Counter(words).values()) / len(words)


def test_statistics():
    rng = random.Random(3)
    at = {name: i for i, name in enumerate(rules.STATISTICS)}
    for _ in range(60):
        text = " ".join(rng.choice(["a", "bb", "Cé", "d|", "99"]) for _ in range(rng.randrange(1, 400)))
        found = rules.statistics(text.encode())
        n, variety, top = statistics_by_hand(text)
        assert (round(math.expm1(found[at["log_words"]])), found[at["distinct_words"]], found[at["top_word"]]) == (n, variety, top)
        assert abs(found[at["pipes"]] - text.count("|") / len(text.encode())) < 1e-12
    assert rules.statistics(b"") == rules.statistics(b" \n ") == (0.0,) * len(rules.STATISTICS)
    plain = [f"w{i % 90}" for i in range(50_000)]
    assert abs(rules.statistics(" ".join(plain).encode())[at["distinct_words"]] - rules.statistics(" ".join(plain[:1000]).encode())[at["distinct_words"]]) < 0.01


def planted(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 5)).round(2)
    return x, ((x[:, 0] > 0.5) & (x[:, 1] <= 0.4) | (x[:, 2] > 0.9)).astype(float)


def test_rules_are_found_and_few():
    x, y = planted(4000)
    model = rules.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97
    assert 0 < len(model.rules) < len(rules.rules_of(x[:3000], y[:3000])) / 2
    assert all(1 <= len(r.conditions) <= rules.DEPTH for r in model.rules)


def test_every_path_is_a_rule():
    x, y = planted(500)
    cuts = rules._cuts(x)
    binned = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1)
    paths, step = rules.grown(binned, cuts, y - 0.5, np.full(500, 0.25), np.arange(500))
    prefixes = {p[:i] for p in paths for i in range(1, len(p) + 1)}
    assert prefixes == set(paths)  # inner nodes too
    leaves = [p for p in paths if not any(q[:len(p)] == p and len(q) > len(p) for q in paths)]
    held = np.stack([rules.Rule(p).holds(x) for p in leaves])
    assert (held.sum(0) == 1).all() and all(len(set(step[h].tolist())) == 1 for h in held)


def test_lasso_meets_its_conditions():
    x, y = planted(800)
    a = np.stack([r.holds(x) for r in rules.rules_of(x, y)], axis=1).astype(float)
    penalty = 0.02
    *_, (w, bias) = rules.lasso_path(a, y, [0.1, 0.05, penalty])
    spread = a.std(0)
    gradient = ((a - a.mean(0)) / np.where(spread == 0, 1, spread)).T @ (y - 1 / (1 + np.exp(-(a @ w + bias)))) / len(y)
    assert (np.abs(gradient) <= penalty * 1.05).all()
    assert np.allclose(gradient[w != 0], penalty * np.sign(w[w != 0]), atol=1e-3) and 0 < (w != 0).sum() < a.shape[1]


def test_columns_say_what_the_model_says(spark):
    docs = common.table(spark, SF, "documents")
    scored = rules.score_quality(docs, common.table(spark, SF, "labels")).collect()
    texts, labels = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["quality"] for r in common.table(spark, SF, "labels").collect()}
    train = [i for i in sorted(texts) if i in labels and zlib.crc32(str(i).encode()) % 5]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored) and len(scored) == len(texts)
    order = spark.createDataFrame([(i, texts[i]) for i in train], "doc_id long, text string").select("doc_id", F.xxhash64("doc_id", "text", F.lit("quality")).alias("k")).orderBy("k").collect()
    x = np.array([rules.statistics((texts[r["doc_id"]] or "").encode()) for r in order])
    model = rules.fit(x, np.array([float(labels[r["doc_id"]]) for r in order]))
    for r in scored:
        mine = rules.statistics((texts[r["doc_id"]] or "").encode())
        assert np.allclose([r[s] for s in rules.STATISTICS], mine) and abs(r["score"] - model.score(np.array([mine]))[0]) < 1e-9
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1


def test_held_out_accuracy(spark):
    """On a table with some 70 labelled rows held out; sf0.001 has 19, three of them of label 0."""
    place = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, place, "labels").collect()}
    held = [r for r in rules.op13_quality_classifier(spark, place).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_quality_odd_rows(spark):
    common.table(spark, SF, "documents")
    good = lambda i: " ".join(f"word{(i * 31 + k * k) % 997}" for k in range(60)) + "."
    texts = [(i, good(i) if i % 3 else "spam " * 60) for i in range(150)]
    odd = [(None, good(1)), (7, good(7)), (7, None), (900, ""), (901, " ".join(f"w{i % 977}" for i in range(60_000)) + ".")]
    docs = spark.createDataFrame([(i, t, "s", 0.5, 1, 2.0) for i, t in texts + odd], "doc_id long, text string, symbols string, score double, key int, _s double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in texts] + [(7, 1, 1), (8, None, 1), (9, 5, 0)], "doc_id long, quality int, toxic int")
    found = rules.score_quality(docs, labels).collect()
    assert len(found) == len(texts) + len(odd)
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in found if r["doc_id"] is not None and r["doc_id"] < 150 and r["log_words"] > 0)
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {False}
    assert [r["predicted"] for r in found if r["doc_id"] == 901] == [1]
    assert {r["score"] for r in rules.score_quality(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in rules.score_quality(docs, labels.limit(0)).collect()} == {0.0}
    assert rules.score_quality(docs.limit(0), labels).count() == 0


def test_sample_is_bounded(spark):
    rows = spark.createDataFrame([(int(k), int(k) % 2, *([float(k % 7)] * len(rules.STATISTICS))) for k in np.random.default_rng(1).integers(-2**62, 2**62, 3000)], f"key long, label int, {rules.SCHEMA}")
    seen = []
    original = rules.fit
    try:
        rules.fit = lambda x, y: seen.append(len(x)) or rules.Model()
        rules.fit_table(rows, bound=500)
    finally:
        rules.fit = original
    assert 400 <= seen[0] <= 500
