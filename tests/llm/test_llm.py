"""The training-data operators on small tables: defined results for odd rows, brute force, exact round trips, held-out accuracy."""

import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from sdkatlas.llm import common, decontaminate, language, lm, packing, quality, queries, setsketch, tokenfile, tokens, toxicity, urls, warc

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "12 34 !!"), (5, "one"), (6, LONG), (7, "The cat sat on the mat and ate it all " * 4), (7, "The cat sat on the mat and ate it all " * 4), (None, "no id here at all"), (9, "ünïcode ñ  double  spaces \n\n x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with further columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i in (5, 6, 7, 9) else None, None if i == 9 else "src0", 0, 1, "x", 2.0, False) for i, t in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, n double, kept boolean"
    common.table(spark, SF, "documents")  # workers get the package's folder
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and ate it all the cat sat"), (2, "No ID here"), (3, None), (4, "")], "item_id long, text string")


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = connection.execute(queries.SQL[name])
    columns = [d[0] for d in result.description]
    expected = sorted(result.fetchall(), key=str)
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert rows(found, *columns) == expected


def test_windows_repeat_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(40))]
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        many = Counter(windows)
        hit = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
        assert quality.repeated_words(words) == len(hit)


def test_quality_odd_rows(odd):
    found = rows(quality.quality_rules(odd), "doc_id", "n_words", "word_chars", "base_failed")
    assert (1, 0, 0, True) in found and (5, 1, 3, True) in found and len(found) == len(ODD)
    assert quality.keep_good(odd).columns == odd.columns


def test_bad_host_is_rejected(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "short"
    docs = spark.createDataFrame([(i, good if i % 2 or i % 10 == 0 else bad, "bad" if i < 400 and (i % 10 == 0 or not i % 2) else "good") for i in range(800)], "doc_id long, text string, source string")
    found = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    assert not found[10] and found[11]


def test_tokens_equal_the_librarys(spark):
    encoder = tokens.encoder(tokens.default_path())
    texts = [t or "" for _, t in ODD] + ["a\n b", " lead", "tail ", "x\u2028 y", "don't they've", "a\x00b c", "<|endoftext|> a", "e\u0301 u\u0308, z"]
    texts += [r[0] for r in common.table(spark, SF, "documents").select("text").collect()]
    assert all(encoder.ids(t) == encoder.whole(t) for t in texts)


def test_odd_spaces():
    rng = random.Random(5)
    pattern = re.compile(r" (?:\s|\Z)|\s(?<=[^ ]) |\A ")
    texts = ["".join(rng.choices("ab \n\t\x1f\x85\u2003\u3000", [9, 9, 6, 1, 1, 1, 1, 1, 1], k=rng.randint(1, 9))) for _ in range(20_000)]
    assert all(tokens.odd(t) == bool(pattern.search(t)) for t in texts)
    encoder = tokens.encoder(tokens.default_path())
    assert all(encoder.ids(t) == encoder.whole(t) for t in texts[:4000])
    assert [c for c in map(chr, range(0x110000)) if c.isspace() and c != " "] == tokens._WHITE


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for ids in ([], [0], [5] * 3000, rng.integers(0, 50_000, 5000), np.r_[rng.integers(0, 9, 2000), 2**32 - 1, 2**31]):
        ids = np.array(ids, dtype="<u4")
        names, lengths, back = tokenfile.unpack_segment(tokenfile.pack_segment([None, 7], [ids[:1].tobytes(), ids[1:].tobytes()]))
        assert names == [None, 7] and lengths.sum() == len(ids) and (back == ids).all()


def test_token_file(odd):
    encoder, path = tokens.encoder(tokens.default_path()), tokens.default_path()
    found = sorted(tokenfile.read_documents(tokenfile.to_segments(odd, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in ODD), key=lambda i: -1 if i is None else i)
    at = 0
    for r in found:
        raw = encoder.whole(dict(ODD)[r["doc_id"]] or "") + struct.pack("<I", 0)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(raw) // 4, zlib.crc32(raw))
        at += r["n_tokens"]


def test_token_file_splits_a_hot_id(spark, request):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # or so few rows would come back as one part
    request.addfinalizer(lambda before=spark.conf.get(setting): spark.conf.set(setting, before))
    spark.conf.set(setting, "false")
    least = -(1 << 63)
    texts = [(7 if i % 3 else i, f"row {i} of the table") for i in range(3000)] + [(least, "least id"), (None, "none"), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    segments = tokenfile.to_segments(docs, tokens.default_path())
    found = sorted(tokenfile.read_documents(segments).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(found, found[1:]))
    encoder = tokens.encoder(tokens.default_path())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in found) == Counter((i, zlib.crc32(encoder.whole(t or "") + struct.pack("<I", 0))) for i, t in texts)
    parts = Counter()
    for r in segments.collect():
        parts[r["part"]] += tokenfile.unpack_segment(r["data"])[0].count(7)
    assert max(parts.values()) < 1200  # of 2000


def check_packing(found, texts):
    encoder = tokens.encoder(tokens.default_path())
    places, pieces = {}, {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for doc_id, text in texts.items():
        raw, at = encoder.whole(text or "") + struct.pack("<I", 2), 0
        for k, r in enumerate(sorted(pieces[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(raw[4 * at:4 * (at + r["length"])])) and (r["length"] == 1024 or k == 0)
            at += r["length"]
        assert 4 * at == len(raw)
    return len(places)


def test_packing_odd_rows(odd):
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(unique, tokens.default_path()).collect(), {i: t for i, t in ODD if i is not None})
    assert packing.pack(odd, tokens.default_path()).filter("doc_id is null").count() == 1


def test_batches_are_bounded_and_small_tables_change_nothing(spark, odd):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.createDataFrame([(i, f"word{i} " * 2000) for i in range(2000)], "doc_id long, text string").coalesce(1)
    sizes = lambda batches: (pd.DataFrame({"n": [int(b["text"].str.len().sum())]}) for b in batches)
    try:
        spark.conf.set(key, "64m")
        found = [r["n"] for r in common.bounded_batches(texts).mapInPandas(sizes, "n long").collect()]
        assert sum(found) == texts.selectExpr("sum(length(text))").first()[0] and len(found) > 3 and max(found) <= 1.1 * common.BATCH_BYTES
        spark.conf.set(key, "1000")
        assert spark.conf.get(key) == "1000" and common.bounded_batches(texts) is texts and spark.conf.get(key).rstrip("b") == "1000"
    finally:
        spark.conf.set(key, before)
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    whole, small = (rows(packing.pack(unique, tokens.default_path(), kept=n), "doc_id", "piece", "ids_crc32") for n in (tokens.KEPT, 3))
    assert whole == small


def test_packing_is_near_its_bound(spark):
    docs = common.table(spark, SF, "documents")
    found = packing.pack(docs, tokens.default_path()).collect()
    used = check_packing(found, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert used <= 1.06 * sum(r["length"] for r in found) / 1024 + 1


def test_warc_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a", "x\r\n\r\ny"), (2, None, None), (3, "http://c\r\n", ""), (4, "u", "x\r\n\r\ny"), (5, "ü", "é" * 3_000_000)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in warc.read_records(warc.to_archives(pages)).collect()}
    assert all(r["intact"] for r in found.values()) and len(found) == 5
    assert (found[1]["record_type"], found[1]["refers_to"], found[4]["record_type"]) == ("revisit", 4, "response")
    assert found[2]["refers_to"] == 3 and found[5]["payload_bytes"] == 6_000_000


def test_warc_damage_is_found():
    import gzip
    member = warc.record(1, "http://a", b"hello", None)
    assert warc.parse(member)[-1] and not warc.parse(member.replace(b"hello", b"jello"))[-1]
    packed = b"".join(gzip.compress(warc.record(i, "", b"x" * i, None)) for i in range(50))
    chunks = [packed[i:i + 7] for i in range(0, len(packed), 7)]
    assert [warc.parse(m)[1] for m in warc.members(iter(chunks))] == list(range(50))
    with pytest.raises(ValueError):
        list(warc.members(iter(chunks[:-1])))


def test_warc_archives_are_closed_at_a_size(spark):
    rng = random.Random(2)
    table = [(i % 50 if i % 7 else None, f"http://h/{i}", "same" if i % 3 == 0 else rng.randbytes(3000).hex()) for i in range(300)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").coalesce(2)
    archives = warc.to_archives(pages, limit=100_000)
    data, ids, kinds = {}, [], Counter()
    for r in archives.orderBy("archive", "chunk").collect():
        data.setdefault(r["archive"], []).append(bytes(r["data"]))
    assert len(data) > 5 and max(sum(map(len, chunks)) for chunks in data.values()) < 110_000
    for name, chunks in data.items():
        heads = [m.partition(b"\r\n\r\n")[0].decode() for m in warc.members(iter(chunks))]
        fields = [dict(line.split(": ", 1) for line in h.split("\r\n")[1:]) for h in heads]
        assert fields[0]["WARC-Type"] == "warcinfo" and fields[0]["WARC-Filename"] == name
        assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"]) for f in fields)
        ids += [f["WARC-Record-ID"] for f in fields]
        kinds.update(f["WARC-Type"] for f in fields)
        assert all(f["WARC-Refers-To-Target-URI"] and f["WARC-Refers-To-Date"] for f in fields if f["WARC-Type"] == "revisit")
    assert len(ids) == len(set(ids)) == 300 + len(data) and kinds["warcinfo"] == len(data)
    largest = max(i for i, _, h in table if h == "same" and i is not None)
    want = Counter((i, len(h), largest if h == "same" and i != largest else None) for i, _, h in table)
    found = warc.read_records(archives).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in found) == want and all(r["intact"] for r in found)


def test_urls(spark):
    cases = {"http://A.Example.com/en/1?x": ("a.example.com", "/en/1", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
             "x://b.net/es/#f": ("b.net", "/es/", "net/es/", "block"), "ftp://q.com?u/": ("q.com", "", None, None), "no scheme": ("", "", None, "allow"), "http://mycom/": ("mycom", "/", None, None), "http://z.com/a": ("z.com", "/a", "com/", "allow")}
    pages = spark.createDataFrame([(i, u, "<p>adult pills</p>") for i, u in enumerate(cases)] + [(99, None, None)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule) and found[i]["verdict"] == (verdict or found[i]["verdict"])
    assert (found[99]["host"], found[99]["verdict"]) == ("", "allow")


def test_urls_have_no_cut(spark, monkeypatch):
    """Words and tokens outside the broadcast ones judge alike, long labels and short path tokens included."""
    common.table(spark, SF, "documents")
    long = "quick" * 500
    urls_ = [f"http://{h}.{d}/{p}" for h in ("quickfox", "lazydog", "dogfox") for d, p in (("net", "es/slug-a"), ("net", "fr/zz"), ("com", "blog/12"), ("org", "slug/a"), ("org", "zz"), ("org", "new"), ("org", "12"))]
    pages = spark.createDataFrame([(i, u, "<p>quick fox lazy dog dog dog</p>") for i, u in enumerate([*urls_, f"http://{long}lazy.org/x"])], "page_id long, url string, html string")
    whole = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert whole[len(urls_)]["host_words"].split() == ["quick"] * 500 + ["lazy"]
    assert whole[4]["score"] > whole[5]["score"] > whole[6]["score"]  # zz stood under net/fr alone, 12 under com alone, new nowhere
    monkeypatch.setattr(urls, "VOCABULARY", 1)
    monkeypatch.setattr(urls, "TOKENS_KEPT", 2)
    for i, r in {r["page_id"]: r for r in urls.filter_urls(pages).collect()}.items():
        assert (r["verdict"], r["host_words"]) == (whole[i]["verdict"], whole[i]["host_words"]) and abs(r["score"] - whole[i]["score"]) < 1e-9


def test_urls_learn_from_ruled_pages_alone(spark):
    """A word that no ruled page holds says nothing, whatever it is."""
    pages = spark.createDataFrame([(i, u, "casino poker teapot") for i, u in enumerate(["http://a.net/es/x", "http://b.com/y", "http://casino.org/", "http://teapot.org/"])], "page_id long, url string, html string")
    found = {r["page_id"]: r["score"] for r in urls.filter_urls(pages).collect()}
    assert abs(found[2] - found[3]) < 1e-12


def test_segmentation():
    words = {"cheap": -2.0, "pills": -2.0, "online": -2.5, "on": -1.5, "line": -2.0}
    assert urls.segment("cheappillsonline", words) == ["cheap", "pills", "online"]
    assert urls.segment("donaudampfschifffahrtsgesellschaftonline", {**words, "donaudampfschifffahrtsgesellschaft": -4.0}) == ["donaudampfschifffahrtsgesellschaft", "online"]


def test_segmentation_is_the_best_of_all():
    """Against all splits, unknown stretches of any length included."""
    rng = random.Random(6)
    for _ in range(150):
        words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))): -rng.uniform(1, 9) for _ in range(6)}
        label = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 10)))
        cost = lambda part: max(words.get(part, -99.0), -7.0 - 1.5 * len(part))  # noqa: E731, B023
        splits = lambda rest: [[]] if not rest else [[rest[:i], *more] for i in range(1, len(rest) + 1) for more in splits(rest[i:])]
        found = urls.segment(label, words)
        assert "".join(found) == label and abs(sum(map(cost, found)) - max(sum(map(cost, s)) for s in splits(label))) < 1e-9


def test_long_page_words_are_whole(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    pages = spark.createDataFrame([(1, f"http://{long}reise.org/", f"<p>{long} reise</p>"), (1, f"http://{long}reise.org/", f"<p>{long}</p>"), (None, "http://reise.org", None)], "page_id long, url string, html string")
    common.table(spark, SF, "pages")
    assert {r["word"]: r["n"] for r in urls.page_words(pages).collect()} == {long: 2, "reise": 1}
    assert sorted((str(r["page_id"]), r["host_words"]) for r in urls.filter_urls(pages).collect()) == [("1", f"{long} reise"), ("1", f"{long} reise"), ("None", "reise")]


def test_verdicts_of_very_many_copies(spark, items):
    """A third of all rows is one row; its copies come back from many tasks, and none is lost."""
    common.table(spark, SF, "documents")
    hot = spark.range(3000).selectExpr("if(id % 3 = 0, 7L, id) as doc_id", "if(id % 3 = 0, 'the cat sat on the mat and ate it all the cat sat', concat('own text ', id)) as text")
    found = decontaminate.judge(hot.repartition(8), items)
    assert found.filter("doc_id = 7 and contaminated").count() == 1000 and found.count() == 3000


def test_languages(odd, spark):
    docs = common.table(spark, SF, "documents")
    found = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.85 * len(found)
    kept = rows(language.keep_known(odd), "doc_id")
    assert (4,) not in kept and (1,) not in kept and kept.count((7,)) == 2
    assert language.keep_known(odd).columns == odd.columns
    assert {r[0] for r in rows(language.identify_languages(odd.filter("lang is null")), "lang_pred")} == {"und"}


def test_code_matrix():
    for n in (1, 2, 4, 12):
        codes = language.code_matrix(n)
        assert codes.shape[0] == n and len({tuple(c) for c in codes}) == n


def test_toxicity(spark):
    rng = random.Random(5)
    plain = lambda: " ".join(rng.choice(["ander", "thing", "esting", "oring", "whert", "inthe"]) + rng.choice(["a", "e", "ed", "ing"]) for _ in range(60))
    texts = [(i, plain() + (" you wretchling and dolterbrain " if i % 3 == 0 else " ") + plain()) for i in range(300)]
    docs = spark.createDataFrame([*texts, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in texts], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [i for i, _ in texts if found[i]["held_out"]]
    assert held and all(found[i]["predicted"] == int(i % 3 == 0) for i in held)
    assert found[1000]["predicted"] == 0 and found[1001]["score"] < 0.5
    assert toxicity.score_toxicity(docs, labels.limit(0)).agg({"score": "max"}).first()[0] == 0


def test_toxic_dictionary_holds_all_telling_words():
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(9))
    bad, plain = sorted({word("qwxzjkvy") for _ in range(500)}), sorted({word("aeioustrn") for _ in range(300)})
    texts = [" ".join(rng.choice(plain) for _ in range(40)) for _ in range(600)]
    toxic = [(t + " " + " ".join(rng.sample(bad, 60))).encode() for t in texts[:300]]  # each word in some 36 texts
    model = toxicity.fit(toxic, [t.encode() for t in texts[300:]])
    gains = toxicity.Gains(model)
    assert sum(map(len, bad)) > toxicity.TOXIC_BYTES
    assert all(w.encode() in model.toxic for w in bad) and sum(gains[w.encode()] >= 1 for w in bad) >= 0.95 * len(bad)


def test_lm(odd, spark):
    docs = common.table(spark, SF, "documents")
    found = lm.score_documents(docs).collect()
    texts = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b"\n"] for r in docs.collect()}
    counts = Counter(w for i, words in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in words)
    n, v = sum(counts.values()), len(counts)
    for r in found:
        words = texts[r["doc_id"]]
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert r["train_tokens"] == n and r["n_known"] == sum(w in counts for w in words) and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score_documents(odd).count() == len(ODD)


def test_lm_counts_every_window(spark, monkeypatch):
    """All windows of all rows count, of copies too; and symbols grow with the words."""
    monkeypatch.setattr(lm, "FLUSH_WINDOWS", 50)
    texts = ["a b c a b", "a b c a b", "", "c a", *("a b c a b" for _ in range(30))]
    common.table(spark, SF, "documents")
    training = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    words = Counter(w for t in texts for w in [*t.encode().split(), lm.END])
    v = lm.vocabulary(spark.createDataFrame(list(words.items()), "word binary, n long"))
    expected = Counter()
    for t in texts:
        s = lm.symbols_of([*t.encode().split(), lm.END], v)[1].tolist()
        expected.update(zip([v.size - 1, v.size - 1, *s], [v.size - 1, *s], s))
    monkeypatch.setattr(lm, "CHUNK", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    found, seen = lm.window_chunks(training, spark.sparkContext.broadcast(v), 3).collect(), Counter()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for row in found:
        codes, counts = lm.unpacked_counts(row["data"])
        windows = lm.split_codes(codes, v.size).tolist()
        assert not seen.keys() & set(map(tuple, windows))
        seen.update(dict(zip(map(tuple, windows), counts.tolist(), strict=True)))
    assert seen == expected and len({(r["shard"], r["chunk"]) for r in found}) == len(found) > 3
    assert sum(lm.symbol_numbers(10)) == lm.FREQUENT + lm.CLASSES < sum(lm.symbol_numbers(10**7)) < sum(lm.symbol_numbers(10**8))


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    network = lm.fit(rng.integers(0, 12, (3000, 3)), 12)
    for far, near in ((0, 0), (3, 7)):
        scores = (network.near[near] + network.far[far]) @ network.out.T + network.bias
        assert abs(np.exp(scores - network.norm[near, far]).sum() - 1) < 1e-4


def brute_contamination(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    words, hit, ids = split(text), set(), set()
    for item, other in items:
        w = split(other)
        n = min(13, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                ids.add(str(item))
    return len(words), len(hit), len(ids)


def test_decontamination(spark, odd, items):
    rng = random.Random(9)
    bench = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([3, 12, 13, 14, 40])))) for i in range(12)]
    docs = []
    for i in range(80):
        words = [rng.choice("abcd") for _ in range(rng.randrange(60))]
        part = bench[i % 12][1].split()
        docs.append((i, " ".join(words + part[rng.randrange(3):] + words[:5])))
    found = decontaminate.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert rows(found, "doc_id", "n_words", "n_hit", "n_items") == sorted(((i, *brute_contamination(t, bench)) for i, t in docs), key=str)
    found = decontaminate.judge(odd, items)
    expected = sorted(((i, *brute_contamination(t, [(r[0], r[1]) for r in items.collect()])) for i, t in ODD), key=str)
    assert rows(found, "doc_id", "n_words", "n_hit", "n_items") == expected
    assert rows(decontaminate.keep_clean(odd, items), "doc_id").count((7,)) == 0
    assert decontaminate.keep_clean(odd, items.limit(0)).count() == len(ODD)


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return sorted(((i, len(sets[i]), root[i]) for i in sets), key=str)


@pytest.mark.parametrize("bucket,block", [(32, 512), (2, 4)])
def test_near_duplicates(spark, monkeypatch, bucket, block):
    """One group of near copies from few to many edits, chains included; also with all buckets going through blocks."""
    monkeypatch.setattr(setsketch, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(setsketch, "BLOCK", block)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    docs = [(0, None), (1, ""), (2, "a b"), (3, "A b"), (4, "a b c")]
    for i in range(5, 65):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(150)] = f"e{rng.randrange(40)}"
        docs.append((i, " ".join(copy)))
    docs.append((70, docs[10][1].upper()))
    common.table(spark, SF, "documents")
    found = setsketch.clusters(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute_components(docs)


def test_near_duplicates_odd_rows(odd):
    found = rows(setsketch.near_duplicates(odd), "doc_id", "n_shingles", "component_id")
    assert len(found) == len(ODD) and (1, 0, 1) in found and (None, 1, None) in found
    assert setsketch.keep_one(odd).columns == odd.columns


def test_keep_one_decides_by_row(spark):
    """A null or repeated doc_id loses no text of its own, and one row stays of each group, also of equal rows and of rows without an id."""
    text = lambda name, edits=0: " ".join(f"{name}{i}" if i >= edits else f"edit{i}" for i in range(200))
    docs = [(1, text("a")), (None, text("a", 1)), (None, text("own")), (2, text("b")), (3, text("b", 2)), (3, text("c")), (4, text("d")), (4, text("d")),
            (None, text("e")), (None, text("e")), (None, text("e", 1)), (5, None), (5, ""), (None, None), (None, None)]
    found = setsketch.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    kept = Counter((r["doc_id"], r["text"]) for r in found.collect())
    of_e = [d for d in kept if d[1] and d[1].endswith("e199")]
    assert len(of_e) == 1 and of_e[0][0] is None and kept.pop(of_e[0]) == 1
    assert kept == Counter([(1, text("a")), (None, text("own")), (2, text("b")), (3, text("c")), (4, text("d")), (5, None), (5, ""), (None, None), (None, None)])


def test_estimate():
    hashes = setsketch.WordHashes()
    for shared in (300, 700, 900):
        a = setsketch.shingles(" ".join(f"x{i}" for i in range(1004)).encode(), hashes)
        b = setsketch.shingles(" ".join(f"x{i}" if i < shared + 4 else f"y{i}" for i in range(1004)).encode(), hashes)
        found = setsketch.estimate(setsketch.registers(a)[None], setsketch.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(found - shared / (2000 - shared)) < 0.12
        merged = np.maximum(setsketch.registers(a), setsketch.registers(b))
        assert (merged == setsketch.registers(np.union1d(a, b))).all()


def test_empty_tables(spark, odd, items):
    none, pages = odd.limit(0), spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for frame in (toxicity.score_toxicity(none, labels), quality.quality_rules(none), language.identify_languages(none), tokenfile.read_documents(tokenfile.to_segments(none, tokens.default_path())),
                  packing.pack(none, tokens.default_path()), decontaminate.judge(none, items), setsketch.near_duplicates(none), urls.filter_urls(pages), warc.read_records(warc.to_archives(pages)), lm.score_documents(none)):
        assert frame.count() == 0


def test_pipeline(spark):
    docs = common.table(spark, SF, "documents")
    bench = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.saved(stage(spark, docs, SF), f"test-{name}")
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        kept = {r["doc_id"] for r in after.collect()}
        if name == "near_duplicates":
            assert kept == {i for i, _, c in brute_components(before) if i == c}
        if name == "decontamination":
            judged = {i: brute_contamination(t, bench) for i, t in before}
            assert kept == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
        docs = after
    found = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(found, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert isinstance(pd.DataFrame(found), pd.DataFrame)


def test_symbols_of_words_known_and_not():
    v = lm.Vocabulary({b"a": 0, b"b": 1}, np.zeros(2), np.array([0, 5], dtype=np.int32), 3, 2, np.zeros(9), 4, 4)
    places, symbols = lm.symbols_of([b"b", b"zz", b"a", b"b"], v)
    assert places.tolist() == [1, -1, 0, 1] and symbols.tolist() == [5, lm.class_of(b"zz", 4, 4), 0, 5]
    assert lm.symbols_of([], v)[0].tolist() == []


def test_lm_takes_texts_apart_once_for_windows_and_scores(spark, monkeypatch):
    """The saved symbols give the windows and the scores that each text gives by itself; long texts, empty ones and copies stand in one group."""
    texts = [b"", b"a", b"a b", b"B a zz a qq zz", b"a b " * 40, b"", b"b"]
    words = Counter(w for t in texts[:3] + texts[4:] for w in [*t.split(), lm.END])
    common.table(spark, SF, "documents")
    v = lm.vocabulary(spark.createDataFrame(list(words.items()), "word binary, n long"))
    rng, start = np.random.default_rng(1), v.size - 1
    network = lm.Network(*(rng.normal(0, 1, (v.size, 4)) for _ in range(3)), rng.normal(0, 1, v.size), rng.normal(0, 1, (v.size, v.size)))
    symbols = [lm.symbols_of([*t.lower().split(), lm.END], v)[1] for t in texts]
    for group in (1, 7, 10_000):
        monkeypatch.setattr(lm, "GROUP", group)
        rows = list(lm.local_rows(texts, v))
        saved = pd.DataFrame({"symbols": [r[5] for r in rows]})
        found, windows = [], []
        for _, lists in lm.grouped(lm.symbol_lists(saved, v)):
            begins = lm.begins_of(lists)
            windows += lm.windows_of(np.concatenate(lists), start, begins).tolist()
            found += np.add.reduceat(lm.log10_probabilities(np.concatenate(lists), network, start, begins), begins).tolist()
        assert windows == [w for s in symbols for w in np.stack([np.r_[start, start, s][:-2], np.r_[start, s][:-1], s], axis=1).tolist()]
        assert np.allclose(found, [lm.log10_probabilities(s, network, start).sum() for s in symbols])
        assert [r[:2] for r in rows] == [(len(s), len(s) - 3 * (i == 3)) for i, s in enumerate(symbols)]
        assert rows[3][4] == [{"word": b"zz", "n": 2}, {"word": b"qq", "n": 1}] and not rows[0][4]
    assert lm.local_rows([], v) is not None and not list(lm.local_rows([], v))
