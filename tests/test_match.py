from sdkatlas.operators import match, provenance


def test_index_coverage_and_guards(spark):
    ends = spark.createDataFrame([(1, "GET", "/a"), (1, "GET", "/a"), (1, "GET", "/b"), (2, "GET", "/x"), (3, "GET", "/only")], "repo_id bigint, http_method string, http_path string")
    maps = spark.createDataFrame([(1, "GET", "/a", "f1", 9, "x"), (1, "GET", "/a", "f2", 1, "y"), (1, "GET", "/c", "f1", 2, "z"), (1, "GET", "/c", "f2", 2, "z"), (2, "GET", "/y", "f", 0, "w"),
                                  (4, "GET", "/z", "f", 0, "v")], "repo_id bigint, http_method string, http_path string, path string, ord bigint, name string")
    index = match.mapping_index(maps)
    assert {(r.repo_id, r.http_path): r.name for r in index.collect()} == {(1, "/a"): "y", (1, "/c"): "z", (2, "/y"): "w", (4, "/z"): "v"}
    assert match.matched(ends, index).count() == 2 and match.unmatched(ends, maps).count() == 3 and match.orphans(ends, maps).count() == 4
    cover = match.coverage(ends, maps)
    assert {r.repo_id: (r.total, r.matched, r.unmatched, r.sdk_endpoints, r.orphans) for r in cover.collect()} == {
        1: (3, 2, 1, 4, 2), 2: (1, 0, 1, 1, 1), 3: (1, 0, 1, 0, 0), 4: (0, 0, 0, 1, 1)}
    assert {r.repo_id: r.status for r in match.join_status(cover).collect()} == {1: "ok", 2: "no_match", 3: "ok", 4: "ok"}


def test_extraction_status(spark):
    listing = spark.createDataFrame([(1, True), (1, False), (2, True), (3, False)], "repo_id bigint, is_client boolean")
    found = spark.createDataFrame([(1,)], "repo_id bigint")
    assert {r.repo_id: r.status for r in match.extraction_status(listing, found).collect()} == {1: "ok", 2: "no_endpoints", 3: "no_client_files"}


def test_provenance(spark):
    metadata = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, ""), (4, None), (5, "c5"), (6, "c6"), (7, "null")], "repo_id bigint, origin_commit string")
    docs = {2: '{"info": {"version": "old"}}', 3: "{}", 4: "{}", 5: '{"info": {"version": null}}', 6: '{"info": {"version": "c6"}}', 7: "{}"}
    specs = spark.createDataFrame(list(docs.items()), "repo_id bigint, doc string")
    assert {r.repo_id: r.status for r in provenance.audit(metadata, specs).collect()} == {
        1: "spec_missing", 2: "mismatch", 3: "commit_missing", 4: "commit_missing", 5: "version_missing", 6: "ok", 7: "commit_missing"}
    published = spark.createDataFrame([("c1", "{}"), ("c1", "{}")], "origin_commit string, doc string")
    assert {r.repo_id: r.status for r in provenance.spec_lookup(metadata, published).filter("repo_id < 4").collect()} == {1: "ready", 2: "pending", 3: "invalid"}
