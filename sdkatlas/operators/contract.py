"""Contract documents shredded into operations, parameters, examples and responses.

Everything here is a projection over one document or one operation: no step shuffles.
Input `specs(repo_id, doc)`; a document that is not JSON goes to `quarantine`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sdkatlas.functions.jsontext import TEXT_MAP, key_order, member_json, members, once
from sdkatlas.functions.rows import joined, keep
from sdkatlas.functions.text import bind, first_group, normalize_placeholders

# The operation keys that count as HTTP methods.
HTTP_METHODS = ["get", "post", "put", "delete", "patch"]

ENDPOINT_KEY = ["repo_id", "path_ord", "method_ord"]

_PARAM = "struct<`$ref`:string,`in`:string,name:string,required:string,schema:string>"


def is_document(doc: Column) -> Column:
    """True for a JSON object and nothing behind it: put before a last item in an array, it is the first of two."""
    last = "end of document"
    items = F.from_json(F.concat(F.lit("["), doc, F.lit(f',"{last}"]')), "array<string>")
    alone = (F.size(items) == 2) & (F.get(items, F.lit(1)) == last)
    return F.coalesce(F.get_json_object(doc, "$").startswith("{") & alone, F.lit(False))


def quarantine(specs: DataFrame) -> DataFrame:
    return specs.filter(~is_document(F.col("doc")))


def _parameters(listed: Column, registry: Column) -> Column:
    """Parameter entries with references looked up: array<struct<found, location, name, required, schema>>."""
    read = F.transform(listed, lambda p: F.from_json(p, _PARAM))

    def target(p):
        name = first_group(p["$ref"], r"\A#/components/parameters/(.+)\z")
        return F.try_element_at(registry, name)

    looked_up = F.transform(read, lambda p: F.when(p["$ref"].isNotNull(), F.from_json(target(p), _PARAM)).otherwise(p))
    return F.transform(looked_up, lambda p: F.struct(
        p.isNotNull().alias("found"),
        p["in"].alias("location"),
        p["name"].alias("name"),
        F.coalesce(~p["required"].isin("false", "0", ""), F.lit(False)).alias("required"),
        p["schema"].alias("schema"),
    ))


def _merged(inherited: Column, own: Column) -> Column:
    """Path-level entries the operation does not redeclare, then the operation's own."""
    same = lambda a, b: a["location"].eqNullSafe(b["location"]) & a["name"].eqNullSafe(b["name"])
    kept = F.filter(inherited, lambda h: ~h["found"] | ~F.exists(own, lambda o: o["found"] & same(h, o)))
    return F.concat(kept, own)


def operations(specs: DataFrame) -> DataFrame:
    """One row per operation with the document's order, its text and its parameters.

    References to shared parameters are looked up while the document is still one row, so the
    registry is neither copied to each operation nor joined.
    """
    # Read in one piece: of fields that are picked out of the reading, Spark reads the text again for each.
    doc = lambda text: F.from_json(text, f"struct<paths:{TEXT_MAP},components:struct<parameters:{TEXT_MAP}>>")
    read = (keep(specs, ["repo_id"], bind(F.col("doc"), lambda text: F.when(is_document(text), doc(text))))
            .select("repo_id", "paths", F.coalesce(F.col("components.parameters"), F.create_map().cast(TEXT_MAP)).alias("registry")))
    nothing = F.array().cast("array<string>")

    def listed(text):
        # Most texts list no parameters; the cheap test spares them the reading. A name can be written otherwise with backslashes only.
        named = F.contains(text, F.lit("parameters")) | F.contains(text, F.lit("\\"))
        return F.coalesce(F.when(named, F.from_json(text, "struct<parameters:array<string>>")["parameters"]), nothing)

    def of_path(path, path_pos):
        inherited = _parameters(listed(path["value"]), F.col("registry"))
        entries = F.transform(members(path["value"]), lambda m, i: F.struct(
            key_order(m["key"], i).alias("method_ord"), m["key"].alias("method"), m["value"].alias("op")))
        return F.transform(F.filter(entries, lambda m: m["method"].isin(HTTP_METHODS)), lambda m: F.struct(
            path["key"].alias("raw_path"), key_order(path["key"], path_pos).alias("path_ord"),
            m["method_ord"].alias("method_ord"), m["method"].alias("method"), m["op"].alias("op"),
            inherited.alias("path_params_listed"),
            _parameters(listed(m["op"]), F.col("registry")).alias("op_params_listed")))

    found = F.flatten(F.transform(once(F.map_entries("paths")), of_path))
    return (read.select("repo_id", F.inline(found))
            .withColumn("http_method", F.upper("method"))
            .withColumn("http_path", normalize_placeholders(F.col("raw_path"))))


def load_status(specs: DataFrame, ops: DataFrame) -> DataFrame:
    """Per repo: paths, endpoints, and whether paths without any endpoint make the load an error."""
    paths = F.from_json("doc", f"struct<paths:{TEXT_MAP}>")["paths"]
    declared = specs.select("repo_id", is_document(F.col("doc")).alias("readable"),
                            F.coalesce(F.cardinality(F.map_keys(paths)), F.lit(0)).cast("bigint").alias("paths"))
    loaded = ops.groupBy("repo_id").agg(F.count("*").alias("endpoints"))
    endpoints = F.coalesce("endpoints", F.lit(0))
    status = (F.when(~F.col("readable"), "unreadable")
              .when((F.col("paths") > 0) & (endpoints == 0), "no_endpoints").otherwise("ok"))
    return (joined(declared, loaded, "repo_id", "left")
            .select("repo_id", "paths", endpoints.alias("endpoints"), status.alias("status")))


def require_ok(status: DataFrame) -> DataFrame:
    """Strict mode: reading the result fails on the first row whose status is not ok."""
    message = F.concat(F.lit("repo "), F.col("repo_id").cast("string"), F.lit(": "), F.col("status"))
    return status.withColumn(
        "status", F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(message).cast("string")))


def merge_parameters(ops: DataFrame) -> DataFrame:
    return ops.withColumn("params", _merged(F.col("path_params_listed"), F.col("op_params_listed")))


def parameters_at(params: Column, location: str) -> Column:
    kept = F.filter(params, lambda p: p["found"] & (p["location"] == location))
    return F.transform(kept, lambda p: F.struct(p["name"].alias("name"), p["required"].alias("required"),
                                                p["schema"].alias("schema")))


def split_parameters(ops: DataFrame) -> DataFrame:
    """Path and query parameters; the other locations are dropped."""
    return (ops.withColumn("path_params", parameters_at(F.col("params"), "path"))
            .withColumn("query_params", parameters_at(F.col("params"), "query")))


def json_media(content: Column) -> Column:
    """The JSON media entry as struct<content_type, media>: exact type first, else the first that contains 'json'."""
    ranked = F.transform(members(content), lambda m, i: F.struct(
        (m["key"] != "application/json").alias("inexact"), key_order(m["key"], i).alias("ord"),
        m["key"].alias("content_type"), m["value"].alias("media")))
    best = F.array_min(F.filter(ranked, lambda m: F.contains(m["content_type"], F.lit("json")) & m["media"].isNotNull()))
    return bind(best, lambda b: F.when(b.isNotNull(), F.struct(b["content_type"].alias("content_type"), b["media"].alias("media"))))


def example_of(media: Column) -> Column:
    """JSON text of the example. A present null counts and stops the search through named examples."""
    named = F.transform(members(F.from_json(media, "struct<examples:string>")["examples"]), lambda m, i: F.struct(
        key_order(m["key"], i).alias("ord"), member_json(m["value"], "value").alias("json")))
    first = F.array_min(F.filter(named, lambda m: m["json"].isNotNull()))["json"]
    return F.coalesce(member_json(media, "example"), first)


def success_response(responses: Column) -> Column:
    """struct<is_streaming, example> over the 2xx responses; streaming suppresses the example."""
    coded = F.transform(members(responses), lambda m, i: F.struct(
        key_order(m["key"], i).alias("ord"), m["key"].alias("code"),
        F.from_json(m["value"], "struct<content:string>")["content"].alias("content")))
    ok = F.filter(coded, lambda r: r["code"].startswith("2"))

    def picked(found):
        streaming = F.exists(found, lambda r: F.coalesce(
            F.map_contains_key(F.from_json(r["content"], TEXT_MAP), "text/event-stream"), F.lit(False)))
        bodies = F.transform(found, lambda r: F.struct(
            r["ord"].alias("ord"), bind(json_media(r["content"])["media"], example_of).alias("json")))
        first = F.array_min(F.filter(bodies, lambda b: b["json"].isNotNull()))["json"]
        return bind(F.coalesce(streaming, F.lit(False)), lambda s: F.struct(s.alias("is_streaming"), F.when(~s, first).alias("example")))

    return bind(ok, picked)


def endpoints(specs: DataFrame) -> DataFrame:
    """The endpoint record: one row per operation, schemas still as contract text."""
    op = F.from_json("op", "struct<requestBody:struct<content:string>,responses:string>")
    read = (split_parameters(merge_parameters(operations(specs)))
            .withColumn("request_media", json_media(op["requestBody"]["content"])["media"])
            .withColumn("response", success_response(op["responses"])))
    return read.select(
        "repo_id", "path_ord", "method_ord", "http_method", "http_path", "path_params", "query_params",
        F.from_json("request_media", "struct<schema:string>")["schema"].alias("body_schema"),
        example_of(F.col("request_media")).alias("request_example"),
        F.col("response.example").alias("response_example"),
        F.col("response.is_streaming").alias("is_streaming"))


def components(specs: DataFrame) -> DataFrame:
    """Named schemas: (repo_id, name, text)."""
    doc = F.from_json("doc", f"struct<components:struct<schemas:{TEXT_MAP}>>")
    return specs.filter(is_document(F.col("doc"))).select("repo_id", F.inline(F.transform(once(F.map_entries(doc["components"]["schemas"])), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("text")))))
