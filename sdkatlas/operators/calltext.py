"""Call text for many request bodies at once.

Bodies are taken apart into rows, each row meets its field by one join, and the text is put together
from the leaves up: one grouping per level of the deepest body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sdkatlas.functions.jsontext import json_kind, quote
from sdkatlas.operators.contract import ENDPOINT_KEY
from sdkatlas.operators.render import render_rules, separator
from sdkatlas.operators.values import shred
from sdkatlas.session import checkpointed

CALL = [*ENDPOINT_KEY, "call_id"]
_PART = [*CALL, "part", "group", "field_ord"]


def literal(json: Column, constants: Column | None = None) -> Column:
    """A scalar's text by the language's rules, which are columns of the row."""
    kind = json_kind(json)
    inner = F.substr(json, F.lit(2), F.length(json) - 2)
    text = F.replace("stringLiteral", F.lit("{{value}}"), inner)
    if constants is not None:
        text = F.coalesce(F.try_element_at(constants, inner), text)
    return (F.when(kind == "null", F.col("nullLiteral")).when(json == "true", F.col("trueLiteral")).when(json == "false", F.col("falseLiteral"))
            .when(kind == "number", F.replace("numberLiteral", F.lit("{{value}}"), json)).when(kind == "string", text).otherwise(json))


def _with_fields(nodes: DataFrame, offered: DataFrame, fields: DataFrame) -> DataFrame:
    """Value rows below each offered field, with what the catalogue says about them."""
    steps = F.regexp_extract_all("at", F.lit("/[^/]*"), F.lit(0))
    top = nodes.withColumn("steps", steps).withColumn("top_key", F.when(F.size("steps") > 0, F.col("steps")[0]))
    # Two ways in: the whole value, or one member of it.
    whole = offered.filter("passthrough").withColumn("skipped", F.lit(0)).withColumn("top_key", F.lit(None).cast("string"))
    member = offered.filter("not passthrough").withColumn("skipped", F.lit(1)).withColumn(
        "top_key", F.concat(F.lit("/"), F.replace(F.replace("json_key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))))
    about = [*ENDPOINT_KEY, "part", "group", F.col("ord").alias("field_ord"), "root_id", F.col("path").alias("field_path"), "skipped",
             F.col("field_template").alias("top_template"), F.col("enum_constants").alias("top_constants"), F.col("wrap").alias("top_wrap"), F.col("kind").alias("top_kind")]
    placed = (top.drop("top_key").join(whole.select(*about), ENDPOINT_KEY)
              .unionByName(top.filter("top_key is not null").join(member.select(*about, "top_key"), [*ENDPOINT_KEY, "top_key"]).drop("top_key")))
    # The same steps as the catalogue spells them.
    below = F.slice("steps", F.col("skipped") + 1, F.size("steps"))
    item_or_property = F.zip_with(below, F.slice("within", F.col("skipped") + 1, F.size("steps")), lambda s, k: F.when(
        k == "array", "/items").otherwise(F.concat(F.lit("/properties"), s)))
    placed = placed.withColumn("catalog_path", F.concat("field_path", F.array_join(item_or_property, "")))
    hits = fields.select("repo_id", "root_id", F.col("path").alias("catalog_path"), F.col("group").alias("nested_group"), F.col("ord").alias("nested_ord"),
                         "field_template", "enum_constants", "wrap", "kind", F.lit(True).alias("hit"))
    inner = (placed.filter(F.size("steps") > F.col("skipped")).withColumnRenamed("kind", "value_kind")
             .join(hits.withColumnRenamed("kind", "field_kind"), ["repo_id", "root_id", "catalog_path"], "left"))
    outer = (placed.filter(F.size("steps") == F.col("skipped")).withColumnRenamed("kind", "value_kind")
             .withColumn("nested_group", F.lit(0)).withColumn("nested_ord", F.lit(0).cast("bigint")).withColumn("field_template", F.col("top_template"))
             .withColumn("enum_constants", F.col("top_constants")).withColumn("wrap", F.col("top_wrap")).withColumn("field_kind", F.col("top_kind")).withColumn("hit", F.lit(True)))
    keep = [*_PART, "at", "parent", "key", "ord", "depth", "skipped", "value_kind", "json", "nested_group", "nested_ord", "field_template", "enum_constants", "wrap", "field_kind", "hit"]
    return outer.select(keep).unionByName(inner.select(keep))


def render_calls(calls: DataFrame, templates: DataFrame, offered: DataFrame, fields: DataFrame) -> DataFrame:
    """Text of each call.

    `calls(ENDPOINT_KEY…, call_id, body, path_values)` with JSON text in `body` and in the map's values,
    `templates` from `with_call_template`, `offered` from `top_fields`, `fields` from `catalog`.
    """
    spark = calls.sparkSession
    rules = F.broadcast(render_rules(spark))
    nodes = shred(calls.select(*CALL, F.col("body").alias("json")), CALL)
    languages = templates.select(*ENDPOINT_KEY, "language")
    rows = checkpointed(_with_fields(nodes, offered, fields).join(languages, ENDPOINT_KEY).join(rules, "language"))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    place = [*_PART, "at"]
    below, finished = None, None
    for depth in range(deepest, -1, -1):
        level = rows.filter(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("items", F.lit("")).withColumn("fields", F.lit("")).withColumn("members", F.lit(""))
        else:
            level = level.join(below, place, "left").na.fill("", ["items", "fields", "members"])
        constants = F.when(F.col("field_kind") == "enum", F.col("enum_constants"))
        plain = F.concat(F.lit("{"), "members", F.lit("}"))
        text = (F.when(F.col("value_kind") == "array", F.replace("listLiteral", F.lit("{{items}}"), "items"))
                .when(F.col("value_kind") == "object", F.coalesce(F.replace("wrap", F.lit("{{__body__}}"), "fields"), plain))
                .otherwise(literal(F.col("json"), constants)))
        level = level.withColumn("text", text)
        filled = F.replace("field_template", F.lit("{{value}}"), "text")
        top = level.filter(F.col("depth") == F.col("skipped")).select(*_PART, filled.alias("text"), "language")
        finished = top if finished is None else finished.unionByName(top)
        listed = lambda rows, sep: F.call_function("array_join", F.transform(F.sort_array(rows), lambda r: r["text"]), sep)
        # The children of one container: no more than its text lists.
        below = (level.filter(F.col("depth") > F.col("skipped")).groupBy(*_PART, F.col("parent").alias("at")).agg(
            F.collect_list(F.when(F.col("key").isNull(), F.struct("ord", "text"))).alias("item_list"),
            F.collect_list(F.when(F.col("key").isNotNull() & F.col("hit"), F.struct("nested_group", "nested_ord", filled.alias("text")))).alias("field_list"),
            F.collect_list(F.when(F.col("key").isNotNull(), F.struct("ord", F.concat(quote(F.col("key")), F.lit(": "), "text").alias("text")))).alias("member_list"),
            F.first("listSeparator").alias("sep"), F.first("language").alias("spoken"))
            .select(*place, listed(F.col("item_list"), F.col("sep")).alias("items"),
                    listed(F.col("field_list"), separator(F.col("spoken"))).alias("fields"), listed(F.col("member_list"), F.lit(", ")).alias("members")))
    bodies = finished.groupBy(CALL).agg(F.sort_array(F.collect_list(F.struct("part", "group", "field_ord", "text"))).alias("list"), F.first("language").alias("spoken"))
    body = bodies.select(*CALL, F.call_function("array_join", F.col("list.text"), separator(F.col("spoken"))).alias("body_text"))
    value = lambda p: F.coalesce(F.try_element_at("path_values", p["name"]), F.lit("null"))
    filled = F.aggregate("params", F.col("call_template"), lambda acc, p: F.replace(acc, F.concat(F.lit("{{"), p["name"], F.lit("}}")), literal(value(p))))
    return (calls.join(templates.select(*ENDPOINT_KEY, "http_method", "http_path", "language", "call_template", "params"), ENDPOINT_KEY)
            .join(rules, "language").join(body, CALL, "left")
            .select(*CALL, "http_method", "http_path", F.replace(filled, F.lit("{{__body__}}"), F.coalesce("body_text", F.lit(""))).alias("call_text")))
