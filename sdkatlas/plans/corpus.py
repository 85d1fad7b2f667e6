"""A corpus of contracts and client sources derived from the supplied tables.

The tables hold no contracts and no code, so both are written out as text from relations over
`part` and `lineitem`. A repo is a supplier's share of a block of parts; the block bounds how much
text one document can hold, whatever the data's size or skew.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.functions.rows import joined

PARTS_PER_REPO = 500
PARTS_PER_DOC = 50

VERBS = ["get", "post", "put", "delete", "patch"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _choose(index: Column, values: list) -> Column:
    """The value at `index`; plain values become literals."""
    chosen = None
    for i, value in enumerate(values):
        value = value if isinstance(value, Column) else F.lit(value)
        chosen = F.when(index == i, value) if chosen is None else chosen.when(index == i, value)
    return chosen


def text(template: str, **columns: Column) -> Column:
    """`template` with each `<name>` replaced by a column."""
    pieces, rest = [], template
    for mark in re.findall(r"<(\w+)>", template):
        if mark in columns:
            head, rest = rest.split(f"<{mark}>", 1)
            pieces += [F.lit(head), columns[mark].cast("string")]
    return F.concat(*pieces, F.lit(rest))


def _described(rows: DataFrame) -> DataFrame:
    """`rows(repo_id, p, p_size, p_type)` with what the texts say of a part."""
    p = F.col("p")
    kind = F.lower("p_type")
    return rows.select(
        "repo_id", "p", F.col("p_size").cast("string").alias("size"), kind.alias("kind"),
        _choose(p % 5, VERBS).alias("verb"),
        _choose(p % 4, [text("/parts/<p>", p=p), text("/parts/<p>/{itemID}", p=p),
                        text("/parts/<p>/{itemID}/tags/{tagId}", p=p),
                        F.concat(F.lit("/types/"), kind, F.when(p % 2 == p % 3, "/{itemID}").otherwise("/{item_id}"))]).alias("raw_path"),
        _choose(p % 4, [text("parts/<p>", p=p), text("parts/<p>/{item_id}", p=p),
                        text("parts/<p>/{item_id}/tags/{tag_id}", p=p),
                        F.concat(F.lit("types/"), kind, F.lit("/{item_id}"))]).alias("call_path"))


def _side(spark: SparkSession, sf: str, flags: list[str]) -> DataFrame:
    """The parts of each repo as the tables have them: (repo_id, p, p_size, p_type)."""
    repo = F.col("l_suppkey") * 1000000000 + F.floor(F.col("l_partkey") / PARTS_PER_REPO)
    keys = (table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin(flags))
            .select(repo.alias("repo_id"), F.col("l_partkey").alias("p")).distinct())
    return joined(keys, table(spark, sf, "part").select(F.col("p_partkey").alias("p"), "p_size", "p_type"), "p")


def spec_side(spark: SparkSession, sf: str) -> DataFrame:
    """Contract operations: (repo_id, verb, raw_path), one each."""
    return _described(_side(spark, sf, ["A", "N"])).select("repo_id", "verb", "raw_path").distinct()


def _sdk_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _side(spark, sf, ["A", "R"])


def sdk_side(spark: SparkSession, sf: str) -> DataFrame:
    """SDK calls: one row per repo and part."""
    return _described(_sdk_keys(spark, sf))


def _object(*columns, key: str, value: str) -> Column:
    """JSON object text out of a group's members. Groups are bounded by PARTS_PER_REPO."""
    member = F.concat(F.lit('"'), F.col(key), F.lit('": '), F.col(value))
    return F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(member)), ", "), F.lit("}"))


def spec_documents(spark: SparkSession, sf: str) -> DataFrame:
    """`specs(repo_id, doc)` over `spec_side`."""
    op = F.concat(F.lit('{"responses": {"200": {"content": {"application/json": {"example": {"path": "'), F.col("raw_path"), F.lit('"}}}}}}'))
    sides = _described(_gathered(_side(spark, sf, ["A", "N"]), "repo_id")).select("repo_id", "verb", "raw_path").distinct()
    by_path = sides.withColumn("op", op).groupBy("repo_id", "raw_path").agg(_object(key="verb", value="op").alias("item"))
    version = F.concat(F.lit('"info": {"version": "c'), F.floor(F.col("repo_id") / 1000000000), F.lit('"}'))
    return (by_path.groupBy("repo_id").agg(_object(key="raw_path", value="item").alias("paths"))
            .select("repo_id", F.concat(F.lit('{"openapi": "3.0.0", '), version, F.lit(', "paths": '), F.col("paths"), F.lit("}")).alias("doc")))


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of each text together, over as many tasks as any shuffle has, and over all cores at least.

    The groupings that follow need no shuffle of their own, and a text is read in the task that puts it together: it is neither sorted
    nor shuffled as a whole. Rows are best gathered before texts are made of them, so that the shuffle holds keys and not texts.
    """
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _source_files(calls: DataFrame, method: Column, path: Column, head: Column, tail: Column) -> DataFrame:
    """Files out of method texts, methods in part order. `calls(repo_id, p, p_size, p_type)` are gathered by repo, their texts made there."""
    return (_described(_gathered(calls, "repo_id")).select("repo_id", "p", path.alias("path"), method.alias("method")).groupBy("repo_id", "path")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "method"))), lambda m: m["method"]), "\n").alias("methods"))
            .select("repo_id", "path", F.concat(head, F.col("methods"), tail).alias("content")))


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    """`files(repo_id, path, content, package_root)`: two raw clients per repo, each with an async twin."""
    p = F.col("p")
    literal = F.when(p % 4 == 0, F.concat(F.lit('"'), F.col("call_path"), F.lit('"'))).otherwise(
        F.concat(F.lit('f"'), F.regexp_replace("call_path", r"\{(\w+)\}", r"{jsonable_encoder($1)}"), F.lit('"')))
    body = _choose(p % 3, [
        text('            json={"sizeValue": size_<s>, "brandName": jsonable_encoder(convert(brand_name)), "mixed": f(a, b)},\n', s=F.col("size")),
        "            json=jsonable_encoder(request),\n", ""])
    query = F.when(p % 7 == 0, '            params={"pageSize": page_size, "sizeValue": q_size},\n').otherwise("")
    method = text(
        "    def op_<p>(self, *, request_options=None):\n"
        "        _response = self._client_wrapper.httpx_client.<fn>(\n"
        "            <path>,\n            method=\"<verb>\",\n<body><query>"
        "            headers={\"X-Trace\": str(trace(\"<p>\"))},\n        )\n        return _response\n",
        p=p, fn=F.when(p % 11 == 0, "stream").otherwise("request"), path=literal,
        verb=F.upper("verb"), body=body, query=query)
    path = F.when(p % 2 == 0, "src/shop/items/raw_client.py").otherwise("src/shop/items/resources/extra/raw_client.py")
    head = F.lit('"""Generated."""\n\nclass RawItemsClient:\n    def __init__(self, client_wrapper):\n        self._client_wrapper = client_wrapper\n\n')
    twin = F.lit('\n\nclass AsyncRawItemsClient:\n    async def op(self):\n        pass\n\n    def twin(self):\n'
                 '        return self._client_wrapper.httpx_client.request("twin", method="GET")\n')
    return (_source_files(_sdk_keys(spark, sf), method, path, head, twin)
            .withColumn("package_root", F.lit("src/shop")))


def java_files(spark: SparkSession, sf: str) -> DataFrame:
    """Raw clients with overloads, their wiring clients and an async twin."""
    p = F.col("p")
    base = "src/main/java/com/shop/resources"
    segment = lambda s: F.concat(F.lit('                .addPathSegments("'), s, F.lit('")\n'))
    named = lambda name: f"                .addPathSegment({name})\n"
    segments = _choose(p % 4, [
        segment(F.concat(F.lit("parts/"), p)), F.concat(segment(F.concat(F.lit("parts/"), p)), F.lit(named("itemId"))),
        F.concat(segment(F.concat(F.lit("parts/"), p)), F.lit(named("itemId")), segment(F.lit("tags")), F.lit(named("tagId"))),
        F.concat(segment(F.concat(F.lit("types/"), F.col("kind"))), F.lit(named("itemId")))])
    params = _choose(p % 6, [
        text("Op<p>Request request", p=p), "String itemId", "\n            String itemId,\n            Map<String, Object> request",
        text("UUID itemId, Optional<Op<p>Request> request", p=p), "", text("String itemId, Page<Op<p>Request> request", p=p)])
    comma = F.when(params == "", "").otherwise(", ")
    returned = F.when(p % 2 == 0, "ShopHttpResponse<Item>").otherwise("ShopClientHttpResponse<Map<String, List<Item>>>")
    method = text(
        "    public <ret> op<p>(<params>) {\n        return op<p>(request, null);\n    }\n"
        "    public <ret> op<p>(<params><comma>RequestOptions requestOptions) {\n"
        "        HttpUrl url = HttpUrl.parse(\"https://example\").newBuilder()\n<segments>                .build();\n"
        "        OkHttpClient other = this.client.newBuilder().build();\n"
        "        if (url != null) {\n            Request r = new Request.Builder().url(url)\n"
        "                .method(\"<verb>\", null)\n                .build();\n        }\n        return null;\n    }\n",
        ret=returned, p=p, params=params, comma=comma, segments=segments, verb=F.upper("verb"))
    path = F.when(p % 2 == 0, f"{base}/stockitems/RawStockItemsClient.java").otherwise(f"{base}/stockitems/extra/RawExtraClient.java")
    raw = _source_files(_sdk_keys(spark, sf), method, path,
                        F.lit("package com.shop.resources.stockitems;\n\npublic class RawClient {\n"), F.lit("}\n"))
    repos = raw.select("repo_id").distinct()
    wiring = [
        ("src/main/java/com/shop/ShopClient.java",
         "package com.shop;\n\nimport com.shop.resources.stockitems.StockItemsClient;\n\npublic class ShopClient {\n"
         "    public StockItemsClient stockItems() { return null; }\n    public GhostClient ghost() { return null; }\n"
         "    public RawStockItemsClient raw() { return null; }\n}\n"),
        (f"{base}/stockitems/StockItemsClient.java",
         "package com.shop.resources.stockitems;\n\nimport com.shop.resources.stockitems.extra.ExtraClient;\n\n"
         "public class StockItemsClient {\n    public ExtraClient more() { return null; }\n}\n"),
        (f"{base}/stockitems/extra/ExtraClient.java", "package com.shop.resources.stockitems.extra;\n\npublic class ExtraClient {}\n"),
        (f"{base}/stockitems/AsyncRawStockItemsClient.java", "package com.shop.resources.stockitems;\n"),
    ]
    rows = F.inline(F.array(*[F.struct(F.lit(a).alias("path"), F.lit(b).alias("content")) for a, b in wiring]))
    return raw.unionByName(repos.select("repo_id", rows))


def typescript_files(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p")
    template = F.regexp_replace("call_path", r"\{(\w+)\}", r"\${core.url.encodePathParam($1)}")
    url = _choose(p % 5, [
        F.concat(F.lit('core.url.join(this._options.baseUrl, `'), template, F.lit("`)")),
        F.concat(F.lit('core.url.join((await core.Supplier.get(this._options.baseUrl)) ?? "https://x", `'), template, F.lit("`)")),
        F.concat(F.lit('`https://example.org/'), F.regexp_replace("call_path", r"\{(\w+)\}", r"\${$1}"), F.lit("`")),
        F.concat(F.lit('`${this._options.baseUrl}/'), template, F.lit("`")),
        F.concat(F.lit("core.url.join(this._options.baseUrl, `/"), template, F.lit("`)"))])
    binding = _choose(p % 6, [
        "", '        const { "X-Trace": _trace, payload: _body } = request;\n', '        const { "X-Trace": _trace, ..._body } = request;\n',
        "        const { trace, _body } = request;\n", "", '        const { "the-body": _body } = request;\n'])
    body = F.when(p % 6 == 0, "            body: request,\n").when(p % 6 == 4, "").otherwise("            body: _body,\n")
    method = text(
        "    public op<p>(request: Op): core.HttpResponsePromise<unknown> { return core.HttpResponsePromise.from(this.__op<p>(request)); }\n"
        "    private async __op<p>(request: Op = {}, options?: Options): Promise<core.WithRawResponse<unknown>> {\n<binding>"
        "        const _response = await core.fetcher({\n            url: <url>,\n            method: \"<verb>\",\n"
        "            headers: { a: 1, method: 2 },\n<body>        });\n"
        "        if (!_response.ok) {\n            throw new Error({ statusCode: 500, body: _response });\n        }\n        return _response;\n    }\n",
        p=p, binding=binding, url=url, verb=F.upper("verb"), body=body)
    path = F.when(p % 2 == 0, "src/api/resources/items/client/Client.ts").otherwise(
        "src/api/resources/items/resources/extra/client/Client.ts")
    return _source_files(_sdk_keys(spark, sf), method, path,
                         F.lit('import * as core from "core";\n\nexport class ItemsClient {\n'), F.lit("}\n"))


# Contracts over `part` alone, with parameters, bodies, responses and schemas of every kind.

TAG = ('{"type": "object", "required": ["label"], "properties": {"weight": {"type": "number"}, "label": {"type": "string"}, '
       '"next": {"$ref": "#/components/schemas/item_Tag"}}}')
SHARED_SCHEMAS = (
    '"item_Role": {"type": "string", "enum": ["user", "assistant", "sys-tem"]}, "item_Part_Mode": {"type": "string", "enum": ["on", "off"]}, '
    '"item_Audit": {"type": "object", "required": ["created_by"], "properties": {"created_by": {"type": "string"}, "audit_note": {"type": "boolean"}}}, '
    '"item_Tag": ' + TAG)


def contract_parts(spark: SparkSession, sf: str, repos: DataFrame | None = None) -> DataFrame:
    """The parts of the contract corpus with their repo; of `repos(repo_id)` alone where given, dropped before anything is made of them."""
    rows = table(spark, sf, "part").withColumn("repo_id", F.floor(F.col("p_partkey") / PARTS_PER_DOC))
    return rows if repos is None else joined(rows, repos, "repo_id", "left_semi")


def contract_operations(rows: DataFrame) -> DataFrame:
    """One operation per part of `rows(repo_id, p_partkey, p_size)` with its contract text: (repo_id, p, raw_path, verb, item, schema)."""
    p = F.col("p_partkey")
    size = F.col("p_size")
    ref = lambda name: f'{{"$ref": "#/components/schemas/{name}"}}'
    own_ref = text('{"$ref": "#/components/schemas/item_Part<p>"}', p=p)
    path_params = ('[{"name": "itemID", "in": "path", "required": true, "schema": {"type": "string"}}, '
                   '{"$ref": "#/components/parameters/PageSize"}, {"$ref": "#/components/parameters/Missing"}]')
    op_params = F.concat(
        F.lit('[{"name": "tagId", "in": "path", "required": true, "schema": ' + ref("item_Role") + "}, "),
        F.when(p % 3 == 0, '{"name": "page_size", "in": "query", "schema": {"type": "integer"}}, ').otherwise(""),
        F.lit('{"name": "X-Trace", "in": "header"}]'))
    inline = ('{"type": "object", "required": ["size", "size"], "properties": {"owner": ' + ref("item_Tag") + ', "size": {"type": "integer"}, '
              '"extra": {"type": "object", "properties": {"deep": {"type": "string"}}}}}')
    bodies = [
        F.lit(None).cast("string"),
        text('{"application/json": {"schema": <ref>, "example": {"name": "n<p>", "role": "user"}}}', ref=own_ref, p=p),
        text('{"application/x+json": {"schema": ' + inline + ', "examples": {"z": {"summary": "s"}, "b": {"value": {"size": <size>}}}}}', size=size),
        '{"text/plain": {"example": "t"}, "application/merge+json": {"schema": {"type": "array", "items": ' + ref("item_Tag")
        + '}, "example": null, "examples": {"a": {"value": 1}}}}',
        text('{"application/merge+json": {"schema": {"type": "string"}}, "application/json": {"schema": <ref>}}', ref=own_ref),
        text('{"application/json": {"schema": {"oneOf": [' + ref("item_Tag") + ', {"type": "string"}]}, "example": "text <p>"}}', p=p),
    ]
    responses = [
        '{"200": {"content": {"text/event-stream": {}, "application/json": {"example": 1}}}}',
        text('{"201": {"content": {"application/json": {"example": {"late": <p>}}}}, "200": {"content": {"application/json": {"example": {"ok": <p>}}}}}', p=p),
        text('{"2XX": {"content": {"application/json": {"examples": {"a": {"value": [<p>]}}}}}, "404": {"content": {"application/json": {"example": 4}}}}', p=p),
        '{"204": {}}',
        '{"default": {"content": {"application/json": {"example": 5}}}}',
    ]
    body = _choose(p % 6, bodies)
    op = F.concat(F.lit('{"parameters": '), op_params,
                  F.coalesce(F.concat(F.lit(', "requestBody": {"content": '), body, F.lit("}")), F.lit("")),
                  F.lit(', "responses": '), _choose(p % 5, responses), F.lit("}"))
    verb = _choose(p % 5, VERBS)
    plain = text(
        '"item_Part<p>": {"type": "object", "required": ["name", "sku"], "properties": {"note_text": {"type": "string"}, "name": {"type": "string"}, '
        '"sku": {"type": ["integer", "null"], "enum": [<size>, 7]}, "role": ' + ref("item_Role") + ', "mode": ' + ref("item_Part_Mode")
        + ', "tags": {"type": "array", "items": ' + ref("item_Tag") + '}, "parent": {"$ref": "#/components/schemas/item_Part<p>"}}}',
        p=p, size=size)
    combined = text(
        '"item_Part<p>": {"allOf": [' + ref("item_Audit") + ', {"type": "object", "required": ["label", "created_by"], "properties": '
        '{"label": {"type": "string"}, "created_by": {"type": "number"}}}]}', p=p)
    return rows.select(
        "repo_id", p.alias("p"),
        text("/parts/<p>/{tagId}/x/{itemID}", p=p).alias("raw_path"), verb.alias("verb"),
        F.concat(F.lit('{"parameters": ' + path_params + ', "summary": "s", "'), verb, F.lit('": '), op, F.lit("}")).alias("item"),
        F.when(p % 6 == 1, plain).when(p % 6 == 4, combined).alias("schema"))


def contract_documents(spark: SparkSession, sf: str, repos: DataFrame | None = None) -> DataFrame:
    """`specs(repo_id, doc)`: PARTS_PER_DOC operations per document."""
    ordered = lambda value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", value))), lambda r: r[value]), ", ")
    rows = contract_operations(_gathered(contract_parts(spark, sf, repos), "repo_id")).withColumn(
        "member", F.concat(F.lit('"'), F.col("raw_path"), F.lit('": '), F.col("item")))
    docs = rows.groupBy("repo_id").agg(
        ordered("member").alias("paths"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("schema").isNotNull(), F.struct("p", "schema")))), lambda r: r["schema"]), ", ").alias("schemas"))
    page = '"parameters": {"PageSize": {"name": "page_size", "in": "query", "required": true, "schema": {"type": "string"}}}'
    own = F.when(F.col("schemas") == "", "").otherwise(F.concat(F.lit(", "), F.col("schemas")))
    return docs.select("repo_id", F.concat(
        F.lit('{"openapi": "3.0.0", "info": {"version": "v1"}, "paths": {'), F.col("paths"), F.lit('}, "components": {' + page + ', "schemas": {'),
        F.lit(SHARED_SCHEMAS), own, F.lit("}}}")).alias("doc"))


def contract_languages(spark: SparkSession, sf: str, repos: DataFrame | None = None) -> DataFrame:
    """(repo_id, language) of the contract documents."""
    return (contract_parts(spark, sf, repos).select("repo_id").distinct()
            .withColumn("language", _choose(F.col("repo_id") % 3, ["python", "java", "typescript"])))


def contract_mappings(spark: SparkSession, sf: str, repos: DataFrame | None = None) -> DataFrame:
    """One SDK call per contract operation."""
    p = F.col("p_partkey")
    language = _choose(F.col("repo_id") % 3, ["python", "java", "typescript"])
    only = lambda name, value: F.when(F.col("language") == name, value)
    return (contract_parts(spark, sf, repos).select("repo_id", p.alias("p"))
            .withColumn("language", language).select(
        "repo_id", F.lit("client").alias("path"), F.col("p").alias("ord"), F.upper(_choose(F.col("p") % 5, VERBS)).alias("http_method"),
        text("/parts/<p>/{tag_id}/x/{item_id}", p=F.col("p")).alias("http_path"),
        F.array(F.lit("shop"), F.lit("items"), text("op<p>", p=F.col("p"))).alias("method_chain"),
        text("op<p>", p=F.col("p")).alias("method_name"),
        only("java", F.when(F.col("p") % 4 != 0, text("Op<p>Request", p=F.col("p")))).alias("request_class_name"),
        only("python", F.when(F.col("p") % 2 == 0, F.array(F.lit("tag_id"), F.lit("item")))).alias("path_param_names"),
        only("python", F.create_map(F.lit("name"), F.lit("name_"), F.lit("page_size"), F.lit("limit"))).alias("body_kwarg_by_json_key"),
        only("python", F.when(F.col("p") % 2 == 0, "payload")).alias("body_kwarg_for_passthrough"),
        only("typescript", F.when(F.col("p") % 7 == 0, "body")).alias("body_wrapper_key")))
