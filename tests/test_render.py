"""One contract, three languages: render schemas, manifests and call text."""

import json

import pytest
from pyspark.sql import functions as F

from sdkatlas.operators import calltext, contract, match, render
from sdkatlas.plans import manifest

ref = lambda name: {"$ref": f"#/components/schemas/{name}"}
BODY = lambda s, **more: {"content": {"application/json": {"schema": s, **more}}}
DOC = {
    "paths": {
        "/t/{b}/{aID}": {"post": {
            "parameters": [{"name": "aID", "in": "path", "schema": {"type": "integer"}}, {"name": "b", "in": "path", "schema": ref("x_Role")}, {"name": "extra", "in": "path"},
                           {"name": "pageSize", "in": "query", "schema": {"type": "array", "items": ref("x_Tag")}}, {"name": "q", "in": "query"}],
            "requestBody": BODY(ref("x_Thing"), example={"name": "n"}), "responses": {"200": {"content": {"application/json": {"example": {"ok": 1}}}}}}},
        "/patch": {"patch": {"parameters": [{"name": "q", "in": "query"}], "requestBody": BODY({"type": "array", "items": ref("x_Tag")}), "responses": {"200": {"content": {"text/event-stream": {}}}}}},
        "/missing": {"get": {}}},
    "components": {"schemas": {
        "x_Role": {"type": "string", "enum": ["sys-tem", "user"]}, "x_Odd_Role": {"enum": ["a"]},
        "x_Tag": {"type": "object", "properties": {"label_text": {"type": "string"}, "role": ref("x_Role")}},
        "x_Odd_Tag": {"type": "object", "properties": {"label": {"type": "string"}}},
        "x_Thing": {"type": "object", "required": ["zed", "name", "ghost"], "properties": {
            "name": {"type": "string"}, "zed": {"type": "boolean"}, "tags": {"type": "array", "items": ref("x_Tag")}, "one": ref("x_Tag"), "odd": ref("x_Odd_Tag"),
            "inline": {"type": "object", "properties": {"d": {"type": "number"}}}, "kind": {"enum": ["k", 1]}, "odd_role": ref("x_Odd_Role")}}}}}
LANGUAGES = {1: "python", 2: "java", 3: "typescript"}


@pytest.fixture(scope="module")
def built(spark):
    specs = spark.createDataFrame([(i, json.dumps(DOC)) for i in LANGUAGES], "repo_id bigint, doc string")
    languages = spark.createDataFrame(list(LANGUAGES.items()), "repo_id bigint, language string")
    rows = []
    for i in LANGUAGES:
        rows += [(i, "POST", "/t/{b}/{a_id}", "f", 1, ["grp", "sub", "make"], "make", "ThingRequest", ["b", "a"], {"name": "name_", "pageSize": "page_size"}, None, None),
                 (i, "PATCH", "/patch", "f", 2, ["fix"], "fix", None, None, None, "payload" if i == 1 else None, "body" if i == 3 else None),
                 (i, "GET", "/orphan", "f", 3, ["o"], "o", None, None, None, None, None)]
    mappings = spark.createDataFrame(rows, "repo_id bigint, http_method string, http_path string, path string, ord bigint, method_chain array<string>, method_name string, request_class_name string, "
                                     "path_param_names array<string>, body_kwarg_by_json_key map<string,string>, body_kwarg_for_passthrough string, body_wrapper_key string")
    metadata = languages.select("repo_id", "language", F.lit("p").alias("package_name"), F.lit("1").alias("sdk_version"), F.lit("").alias("origin_commit"), F.lit("g").alias("generator_name"))
    rows = manifest.manifest_rows(manifest.matched_examples(specs, mappings, languages), metadata)
    documents = {r.repo_id: json.loads(r.document) for r in manifest.manifest_documents(rows, render.render_rules(spark)).collect()}
    return specs, languages, mappings, documents


def rendered(built, repo, key):
    return built[3][repo]["examples"][key]["render"]


def test_manifest_head_and_examples(built):
    document = built[3][1]
    assert document["metadata"] == {"language": "python", "packageName": "p", "sdkVersion": "1", "specCommit": "unknown", "generatorName": "g"}
    assert document["renderRules"]["trueLiteral"] == "True" and built[3][2]["renderRules"]["listLiteral"] == "Arrays.asList({{items}})"
    assert list(document["examples"]) == ["POST /t/{b}/{a_id}", "PATCH /patch"]
    assert document["examples"]["POST /t/{b}/{a_id}"]["request"] == {"body": {"name": "n"}}
    assert document["examples"]["POST /t/{b}/{a_id}"]["response"] == {"body": {"ok": 1}}
    assert document["examples"]["PATCH /patch"]["response"] == {"body": None, "streaming": True}


@pytest.mark.parametrize("repo, make, fix", [
    (1, "client.grp.sub.make(b={{b}}, a={{aID}}, extra={{extra}}, {{__body__}})", "client.fix(payload={{__body__}})"),
    (2, "client.grp().sub().make({{b}}, {{aID}}, {{extra}}, ThingRequest.builder(){{__body__}}.build())", "client.fix({{__body__}})"),
    (3, "client.grp.sub.make({{b}}, {{aID}}, {{extra}}, { {{__body__}} })", 'client.fix({ "body": {{__body__}} })')])
def test_call_templates(built, repo, make, fix):
    assert rendered(built, repo, "POST /t/{b}/{a_id}")["callTemplate"] == make
    assert rendered(built, repo, "PATCH /patch")["callTemplate"] == fix


def test_params_and_field_order(built):
    one = rendered(built, 1, "POST /t/{b}/{a_id}")
    assert one["params"] == [{"name": "b", "kind": "enum"}, {"name": "aID", "kind": "number"}, {"name": "extra", "kind": "object"}]
    fields = one["body"]["fields"]
    assert [(f["jsonKey"], f["required"]) for f in fields] == [
        ("zed", True), ("name", True), ("tags", False), ("one", False), ("odd", False), ("inline", False), ("kind", False), ("odd_role", False), ("pageSize", False), ("q", False)]
    assert [f["fieldTemplate"] for f in fields[1:3]] == ["name_={{value}}", "tags={{value}}"]
    assert fields[8]["fieldTemplate"] == "page_size={{value}}" and fields[8]["kind"] == "list" and fields[9]["kind"] == "object"
    assert not any("nested" in f for f in fields) and fields[6]["enumValues"] == ["k", "1"]


def test_nesting_by_language(built):
    java, ts = ({f["jsonKey"]: f for f in rendered(built, i, "POST /t/{b}/{a_id}")["body"]["fields"]} for i in (2, 3))
    assert java["one"]["nested"]["wrap"] == "Tag.builder(){{__body__}}.build()" and java["one"]["nested"]["fieldSeparator"] == ""
    assert [f["fieldTemplate"] for f in java["one"]["nested"]["fields"]] == [".labelText({{value}})", ".role({{value}})"]
    assert java["tags"]["items"]["nested"] == java["one"]["nested"]
    assert java["one"]["nested"]["fields"][1]["enumConstants"] == {"sys-tem": "Role.SYS_TEM", "user": "Role.USER"}
    # A name that fits two classes has no builder in Java; TypeScript needs none.
    assert "nested" not in java["odd"] and ts["odd"]["nested"]["wrap"] == "{ {{__body__}} }"
    assert "nested" not in ts["inline"] and "enumConstants" not in ts["kind"] and "enumConstants" not in ts["odd_role"]
    assert ts["pageSize"]["items"]["nested"]["fields"][1]["enumConstants"]["sys-tem"] == "Role.SysTem"


def test_passthrough(built):
    for repo in LANGUAGES:
        fields = rendered(built, repo, "PATCH /patch")["body"]["fields"]
        assert [(f["jsonKey"], f["passthroughBody"], f["kind"], "items" in f) for f in fields] == [("", True, "list", True)]


def shapes(built):
    specs, languages, mappings, _ = built
    endpoints = contract.endpoints(specs)
    nodes = render.resolved_nodes(endpoints, contract.components(specs), languages)
    rows = match.matched(endpoints, match.mapping_index(mappings)).join(languages, "repo_id")
    return render.with_shape(rows, render.root_kinds(nodes)), nodes


def test_warnings(built):
    rows, _ = shapes(built)
    bare = render.with_shape(rows.drop("body_root", "is_passthrough", "has_body", "folds_query", "drops_query", "java_unrenderable")
                             .withColumn("request_class_name", F.lit(None).cast("string")), render.root_kinds(shapes(built)[1]))
    found = {(r.repo_id, r.http_method, r.warning) for r in render.warnings(bare).collect()}
    assert found == {(1, "PATCH", "query_dropped_passthrough_body"), (2, "PATCH", "query_dropped_passthrough_body"),
                     (3, "PATCH", "query_dropped_wrapped_body"), (2, "POST", "java_body_without_request_class")}


def test_calls(built, spark):
    rows, nodes = shapes(built)
    fields = render.catalog(nodes)
    body = {"name": 'a"b', "zed": True, "tags": [{"role": "sys-tem", "label_text": "l", "more": 1}, None], "inline": {"d": 1.5, "0": [False]}, "unknown": 1, "kind": "k"}
    texts = F.when(F.col("http_method") == "POST", json.dumps(body)).otherwise(json.dumps([{"label_text": "x"}]))
    calls = rows.select("repo_id", "path_ord", "method_ord", F.lit(0).alias("call_id"), texts.alias("body"), F.create_map(F.lit("b"), F.lit('"user"'), F.lit("aID"), F.lit("7")).alias("path_values"))
    templates = render.with_call_template(rows, render.root_kinds(nodes))
    found = {(r.repo_id, r.http_method): r.call_text for r in calltext.render_calls(calls, templates, render.top_fields(rows, fields), fields).collect()}
    assert found == {
        (1, "POST"): 'client.grp.sub.make(b="user", a=7, extra=None, zed=True, name_="a\\"b", tags=[{"role": "sys-tem", "label_text": "l", "more": 1}, None], inline={"0": [False], "d": 1.5}, kind="k")',
        (2, "POST"): 'client.grp().sub().make("user", 7, null, ThingRequest.builder().zed(true).name("a\\"b").tags(Arrays.asList(Tag.builder().labelText("l").role(Role.SYS_TEM).build(), null))'
                     '.inline({"0": Arrays.asList(false), "d": 1.5}).kind("k").build())',
        (3, "POST"): 'client.grp.sub.make("user", 7, null, { "zed": true, "name": "a\\"b", "tags": [{ "label_text": "l", "role": Role.SysTem }, null], "inline": {"0": [false], "d": 1.5}, "kind": "k" })',
        (1, "PATCH"): 'client.fix(payload=[{"label_text": "x"}])', (2, "PATCH"): 'client.fix(Arrays.asList(Tag.builder().labelText("x").build()))',
        (3, "PATCH"): 'client.fix({ "body": [{ "label_text": "x" }] })'}
