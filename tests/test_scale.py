"""Steps that must hold on tables much larger than these: no side that grows is broadcast, no step is bound to a fixed number of tasks."""

import os
import re

import pytest
from pyspark.sql import functions as F

from sdkatlas.functions import rows
from sdkatlas.functions.brackets import argument_value, cut_balanced
from sdkatlas.operators import contract, java_calls, py_calls, ts_calls, values
from sdkatlas.operators.ts_calls import typescript_endpoints
from sdkatlas.plans import contract_queries, corpus, job_queries, manifest, registry, render_queries, source_queries, stream_queries  # noqa: F401
from sdkatlas.session import saved
from sdkatlas.sources import store
from sdkatlas.streaming import refresh

PART = "p_partkey bigint, p_name string, p_type string, p_size bigint"


def part_rows(first, last):
    return [(p, f"part {p}", ["SMALL BRASS", "LARGE TIN"][p % 2], p % 50) for p in range(first, last)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with `part` and `lineitem`, each a folder of several files."""
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(part_rows(0, 200), PART).repartition(3).write.parquet(f"{place}/part.parquet")
    lines = [(p % 4, p % 200, "ANR"[p % 3]) for p in range(400)]
    spark.createDataFrame(lines, "l_suppkey bigint, l_partkey bigint, l_returnflag string").repartition(3).write.parquet(f"{place}/lineitem.parquet")
    return place


def final_plan(rows):
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["render_schema", "manifest_rows", "query_fold"])
def test_no_growing_side_is_broadcast(spark, tables, name):
    plan = final_plan(registry.QUERIES[name](spark, tables))
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_manifests_broadcast_the_rules_alone(spark, tables):
    plan = final_plan(registry.QUERIES["manifest_json"](spark, tables)).split("== Initial Plan ==")[0]
    assert len(re.findall(r"BroadcastHashJoin \[language", plan)) == plan.count("BroadcastHashJoin") == 1


@pytest.mark.parametrize("make", [corpus.python_files, corpus.java_files, corpus.typescript_files, corpus.spec_documents, corpus.contract_documents])
def test_texts_are_read_where_they_are_made(spark, tables, make):
    """No text is shuffled after it is put together: dealing them out in turn sorts them all and binds what reads them to the number of cores."""
    plan = final_plan(make(spark, tables))
    assert "RoundRobinPartitioning" not in plan and "hashpartitioning(repo_id" in plan


def test_refresh_reads_a_table_of_many_files(spark, tables):
    rows = registry.QUERIES["refresh"](spark, tables).collect()
    assert sorted((r.repo_id, r.artifact, r.versions) for r in rows) == [(i, a, 1) for i in range(4) for a in ("manifest", "spec")]


def test_brackets_are_cut_in_one_pass(spark):
    """Texts without a closing bracket, with others before and long ones behind it."""
    texts = ["f(a(b)c)d(e)", "no bracket", "(open (twice)", ")first(then", "", None, "(" * 50 + ")" * 50 + "x" * 200_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(cut_balanced(F.col("t"), "(", ")").alias("cut")).collect()
    assert [r.cut for r in rows] == ["f(a(b)c)", None, None, None, None, None, "(" * 50 + ")" * 50]


def test_typescript_masks_hold_whatever_the_text_holds(spark, files):
    """The quick mask and that of texts with its cut character give the same bodies."""
    code = ("class C {\n    private async __a(r: Op = {}): Promise<X> {\n        // it's {\n        const s = \"{\" + '}' + `x${core.f(id)}y`;\n"
            "        const _response = await core.fetcher({ url: core.url.join(b, `a/${core.url.encodePathParam(id)}`), method: \"GET\", });\n        /* } */\n    }\n}\n")
    path = "src/api/resources/items/client/Client.ts"
    read = lambda text: [tuple(r) for r in typescript_endpoints(files((path, text))).select("http_method", "http_path", "method_name").collect()]
    assert read(code) == [("GET", "/a/{id}", "a")] == read(code.replace("it's", "it's \u000e"))


def test_contracts_are_read_once(spark, tables):
    """what follows the endpoints works on saved columns; none of it holds the reading of a contract's text."""
    languages = corpus.contract_languages(spark, tables)
    examples = manifest.matched_examples(corpus.contract_documents(spark, tables), corpus.contract_mappings(spark, tables), languages)
    plan = examples._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object(doc" not in plan and "from_json" not in plan.lower()


@pytest.mark.parametrize("make", [corpus.python_files, corpus.java_files, corpus.typescript_files, corpus.spec_documents, corpus.contract_documents])
def test_rows_are_gathered_before_texts_are_made(spark, tables, make):
    """what is shuffled are the parts of a repo and what the tables say of them, not the texts made of that."""
    plan = make(spark, tables)._jdf.queryExecution().optimizedPlan()
    gathered = [node for node in plan.toString().split("\n") if "RepartitionByExpression" in node]
    assert gathered and all("repo_id" in node for node in gathered)
    below = plan.toString().split("RepartitionByExpression", 1)[1]
    assert not any(text in below for text in ("self._client_wrapper", "addPathSegments", "core.fetcher", "responses", "/parts/"))


def test_stored_texts_are_compressed(spark, tmp_path):
    """the tree and what was read from it are compressed tables that hold the same rows."""
    kept = spark.createDataFrame([(1, "a.py", "text"), (1, "b", None), (None, None, "x")], "repo_id bigint, path string, content string")
    store.put(kept.filter("content is not null and path is not null"), f"{tmp_path}/store")
    names = [name for _, _, found in os.walk(f"{tmp_path}/store/version=0") for name in found if name.endswith(".parquet")]
    assert names and all(".zstd." in name for name in names)
    assert [tuple(r) for r in store.read(spark, f"{tmp_path}/store").collect()] == [(1, "a.py", "py", "text")]
    again = saved(kept)
    assert all(".zstd." in name for name in again.inputFiles()) and sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_contract_status_makes_documents_once(spark, tables):
    """both uses of the documents read what was written out; a document is read by one parser for all its parts."""
    status = registry.QUERIES["spec_load_status"](spark, tables)
    assert "l_suppkey" not in status._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.endpoints for r in status.collect()) > 0
    docs = ['{"paths": {"/a": {"parameters": [{"name": "x", "in": "query"}], "get": {"p\\u0061rameters": [{"name": "y", "in": "path"}]}, "put": {}}}}',
            "{}", '{"paths": {"/a": {"get": {}}}} and more', "no document", None, '{"paths": null}']
    specs = spark.createDataFrame(list(enumerate(docs)), "repo_id bigint, doc string")
    read = contract.operations(specs).orderBy("method").selectExpr("repo_id", "method", "path_params_listed.name as above", "op_params_listed.name as own").collect()
    assert [tuple(r) for r in read] == [(0, "get", ["x"], ["y"]), (0, "put", ["x"], [])]
    plan = contract.operations(specs)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"paths,MapType", plan)) == 1


@pytest.mark.parametrize("name", ["java_endpoints", "file_status"])
def test_extraction_broadcasts_nothing_that_grows(spark, tables, name):
    """the joins of chains, languages and counts shuffle and merge."""
    plan = final_plan(registry.QUERIES[name](spark, tables))
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_mappings_leave_the_texts_where_they_are(spark, tables):
    """repos of another language are dropped from what was found; no join stands between a text and its extraction."""
    files = source_queries.all_files(spark, tables)
    languages = spark.createDataFrame([(0, "python"), (1000000000, "java"), (1000000000, "java"), (2000000000, "typescript")], "repo_id bigint, language string")
    found = manifest.all_mappings(files, languages)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in re.sub(r"(?s)Join LeftSemi, \(\(?repo_id#\d+L = repo_id#\d+L\)? AND \(child.*?\n", "", plan)
    once = [(r.repo_id, r.path, r.ord) for r in found.collect()]
    assert len(once) == len(set(once)) > 0 and {i for i, _, _ in once} == {0, 1000000000, 2000000000}


def test_java_signatures_are_cut_at_plain_text(spark, files):
    """a signature that opens the text still counts as its head; the line of the builder is read from its start."""
    method = lambda n: f"public AHttpResponse<X> {n}(String a) {{ u = x.newBuilder().addPathSegments(\"p/{n}\").build(); r.method(\"GET\", null); }}\n"
    path = "src/main/java/com/a/RawAClient.java"
    read = lambda text: sorted((r.method_name, r.http_path) for r in java_calls.java_endpoints(files((path, text))).collect())
    assert read("class A {\n" + method("a") + "republic\n" + method("b") + "}") == [("a", "/p/a"), ("b", "/p/b")]
    assert read(method("a") + method("b")) == [("b", "/p/b")]


def test_typescript_literals_by_pattern_and_peeled(spark):
    """F6, F8: one pattern finds the literals; deep, open or unpaired ones are peeled as before, with the same result."""
    shallow = 'x({ url: `a`, headers: { method: 2, b: { c: 1 } }, method: "GET" }); if (y) { z }'
    texts = [shallow, "{ url: 1 { method: 2 }", "} { method: 1 } {", "{" * 9 + "url: 1" + "}" * 9, "no literal", "", None, "{ amethod: 1, urls: 2 }"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    requests = lambda b: F.rlike(b, F.lit(r"(?=[mu])(?<![\w$.])(?:method|url)\s*:"))
    both = rows.select(F.array_sort(ts_calls.object_literals(F.col("t"))).alias("a"), F.array_sort(ts_calls._peeled_literals(F.col("t"), requests)).alias("b"))
    found = both.collect()
    assert all(r.a == r.b for r in found) and [len(r.a) if r.a else 0 for r in found] == [2, 1, 1, 1, 0, 0, 0, 0]
    assert "aggregate(" in both._jdf.queryExecution().optimizedPlan().toString()


def test_python_calls_without_an_argument_are_not_searched(spark):
    """the name is looked for as plain text first; a call that holds the mark itself is read as before."""
    texts = ["f(json=a)", "f(x(json=a), json = b)", "f(jsonable(a))", "f(a)", "f(a\u0001b)", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(argument_value(F.col("t"), "json").alias("v"), F.expr("t"))
    assert [r.v for r in rows.collect()] == ["a)", " b)", None, None, "b)", None, None]
    assert re.search(r"(?i)contains\(t#\d+, json\)", rows._jdf.queryExecution().optimizedPlan().toString())
    paths = spark.createDataFrame([('r(f"a/{e(b)}",',), ('r(xf"a",',), ('f"a"',), ('r(xf"no", f"yes")',)], "t string")
    assert [r.p for r in paths.select(py_calls.request_path(F.col("t")).alias("p")).collect()] == ["a/{b}", None, "a", "yes"]


def test_refreshed_artifacts_are_compressed(spark, tmp_path):
    """what a batch writes, and what it compares, are compressed tables."""
    build = lambda repos: repos.select("repo_id", F.lit("spec").alias("artifact"), F.lit("text").alias("payload"))
    refresh.publish(spark.range(3).withColumnRenamed("id", "repo_id"), 0, f"{tmp_path}/store", build)
    assert all(".zstd." in name for name in refresh.stored(spark, f"{tmp_path}/store").inputFiles())
    assert sorted(r.repo_id for r in refresh.stored(spark, f"{tmp_path}/store").collect()) == [0, 1, 2]


def test_merged_values_are_dealt_out_by_their_number(spark, monkeypatch):
    """as many rows a task at any size; adaptive execution made one task of small compressed rows."""
    monkeypatch.setattr(rows, "TASK_ROWS", 100)
    frame = lambda text: spark.range(300).select("id", F.lit(text).alias("json"))
    merged = values.merge(frame('{"a": {"b": 1}}'), frame('{"a": {"c": 2}}'), ["id"])
    assert merged.rdd.getNumPartitions() >= 900 // 100
    assert {(r.json, r.n) for r in merged.groupBy("json").agg(F.count("*").alias("n")).collect()} == {('{"a":{"b":1,"c":2}}', 300)}


def test_tasks_of_growing_tables_are_bounded(spark, tables, tmp_path):
    """adaptive execution may put less into a task; a smaller bound of the session stays. Coverage is counted once for both of its uses."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    place = str(tmp_path)
    for name in ("part", "lineitem"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{place}/{name}.parquet")
    spark.range(4).withColumnRenamed("id", "s_suppkey").write.parquet(f"{place}/supplier.parquet")
    try:
        for given, kept in (("64MB", "8388608"), ("1g", "8388608"), ("8388609b", "8388608"), ("8m", "8m"), ("100k", "100k"), ("5000", "5000")):
            spark.conf.set(key, given)
            totals = registry.QUERIES["coverage_totals"](spark, place) if given == "64MB" else rows.bounded_tasks(spark.range(1))
            assert spark.conf.get(key) == kept
            if given == "64MB":
                assert "lineitem" not in totals._jdf.queryExecution().optimizedPlan().toString() and "l_suppkey" not in final_plan(totals)
    finally:
        spark.conf.set(key, before)
