"""Render schemas: how each matched endpoint is called in its SDK's language.

Field catalogues depend only on a root schema and a language, so they are built once per distinct
root and joined to the endpoints that use it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.functions.jsontext import quote
from sdkatlas.functions.rows import joined
from sdkatlas.functions.text import (
    bind, camel_to_snake, pascal_case, placeholders, screaming_snake, snake_to_camel, strip_schema_prefix,
)
from sdkatlas.operators.contract import ENDPOINT_KEY
from sdkatlas.operators.schema import ROOT, resolve, root_id, roots_of
from sdkatlas.session import checkpointed

# Literals of each language.
RENDER_RULES = [
    ("typescript", '"{{value}}"', "{{value}}", "true", "false", "null", "[{{items}}]", ", "),
    ("python", '"{{value}}"', "{{value}}", "True", "False", "None", "[{{items}}]", ", "),
    ("java", '"{{value}}"', "{{value}}", "true", "false", "null", "Arrays.asList({{items}})", ", "),
]
RULE_COLUMNS = ["language", "stringLiteral", "numberLiteral", "trueLiteral", "falseLiteral", "nullLiteral", "listLiteral", "listSeparator"]

# A root used as a body offers its properties; one used as a field is a field itself.
BODY, FIELD = "body", "field"
SLOTS = ("properties", "items")


def render_rules(spark: SparkSession) -> DataFrame:
    """Three rows, one per language."""
    return spark.createDataFrame(RENDER_RULES, ", ".join(f"{c} string" for c in RULE_COLUMNS))


def infer_kind(type_: Column, enum: Column) -> Column:
    return (F.when(enum.isNotNull(), "enum").when(type_ == "string", "string").when(type_.isin("number", "integer"), "number")
            .when(type_ == "boolean", "boolean").when(type_ == "array", "list").otherwise("object"))


def separator(language: Column) -> Column:
    return F.when(language == "java", "").otherwise(", ")


def builder_wrap(class_name: Column) -> Column:
    return F.concat(class_name, F.lit(".builder(){{__body__}}.build()"))


def field_template(key: Column, language: Column, kwarg: Column) -> Column:
    return (F.when(language == "python", F.concat(kwarg, F.lit("={{value}}")))
            .when(language == "typescript", F.concat(quote(key), F.lit(": {{value}}")))
            .otherwise(F.concat(F.lit("."), snake_to_camel(key), F.lit("({{value}})"))))


def enum_constants(enum: Column, ref_name: Column, language: Column) -> Column:
    """Map from wire value to constant; NULL for Python, inline enums and names that fit two classes."""
    def constants(cls):
        case = lambda v: F.when(language == "java", screaming_snake(v)).otherwise(pascal_case(v))
        return F.when(cls.isNotNull(), F.map_from_entries(F.transform(F.array_distinct(enum), lambda v: F.struct(
            v.alias("key"), F.concat(cls, F.lit("."), case(v)).alias("value")))))

    return F.when((language != "python") & enum.isNotNull(), bind(strip_schema_prefix(ref_name), constants))


def schemas_in_use(endpoints: DataFrame) -> DataFrame:
    """(repo_id, usage, text) of every schema an endpoint mentions, in one pass over the endpoints."""
    used = lambda usage, text: F.struct(F.lit(usage).alias("usage"), text.alias("text"))
    params = F.transform(F.concat("path_params", "query_params"), lambda p: used(FIELD, p["schema"]))
    return endpoints.select("repo_id", F.inline(F.concat(F.array(used(BODY, F.col("body_schema"))), params)))


def resolved_nodes(endpoints: DataFrame, components: DataFrame, languages: DataFrame) -> DataFrame:
    """Resolved nodes of all schemas in use, with usage, language and kind."""
    roots = checkpointed(roots_of(schemas_in_use(endpoints)))
    nodes = resolve(roots, components, SLOTS).withColumn("kind", infer_kind(F.col("type"), F.col("enum")))
    return checkpointed(joined(joined(nodes, roots.select(*ROOT, "usage"), ROOT), languages.select("repo_id", "language"), "repo_id"))


def _steps(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit("/properties/[^/]*|/items"), F.lit(0))


def _descent(parent: str) -> Column:
    """Does the renderer go from this parent into its child at the current row's slot?"""
    p = lambda name: F.col(f"{parent}.{name}")
    is_body = (p("path") == "") & (F.col("usage") == BODY)
    class_known = (p("language") == "typescript") | ((p("language") == "java") & strip_schema_prefix(p("ref_name")).isNotNull())
    nested = (p("kind") == "object") & p("ref_name").isNotNull() & p("has_properties") & class_known
    into_items = (p("kind") == "list") & ~(is_body & (p("property_count") > 0))
    return F.coalesce(F.when(F.col("slot") == "items", into_items).otherwise(is_body | nested), F.lit(False))


def reachable(nodes: DataFrame) -> DataFrame:
    """Nodes the renderer visits, with their parent: every step from the root must be one it takes."""
    parents = nodes.select(*ROOT, F.col("path").alias("parent_path"), F.struct(
        "path", "kind", "ref_name", "has_properties", "property_count", "required", "language").alias("parent"))
    steps = joined(nodes.filter("path <> ''"), parents, [*ROOT, "parent_path"]).withColumn("taken", _descent("parent"))
    taken = steps.filter("taken").drop("taken")
    # Only nodes two or more steps down can hang below a step that is not taken.
    above = F.transform(F.sequence(F.lit(1), F.size(_steps(F.col("path"))) - 1), lambda i: F.array_join(F.slice(_steps(F.col("path")), F.lit(1), i), ""))
    ways = taken.filter("parent_path <> ''").select(*ROOT, "path", F.explode(above).alias("above"))
    blocked = (joined(ways, steps.filter("not taken").select(*ROOT, F.col("path").alias("above")), [*ROOT, "above"], "left_semi")
               .select(*ROOT, "path").distinct())
    return joined(taken, blocked, [*ROOT, "path"], "left_anti")


def catalog(nodes: DataFrame) -> DataFrame:
    """Fields per root, flat.

    Required ones come first in the order they are listed in (a repeated name is a repeated field),
    then the others as declared. Templates use the wire name; see `top_fields` for Python's own names.
    """
    visited = reachable(nodes)
    listed = F.filter(F.transform("parent.required", lambda name, i: F.when(name == F.col("key"), i)), lambda i: i.isNotNull())
    optional = F.array(F.struct(F.lit(False).alias("required"), F.lit(1).alias("group"), F.col("ord").alias("ord")))
    placed = bind(listed, lambda at: F.when(F.size(at) > 0, F.transform(at, lambda i: F.struct(
        F.lit(True).alias("required"), F.lit(0).alias("group"), i.cast("bigint").alias("ord")))).otherwise(optional))
    common = [*ROOT, "usage", "language", "path", "parent_path", "slot", "key", "kind", "ref_name", "enum", "has_properties", "property_count"]
    properties = visited.filter("slot = 'properties'").select(*common, F.inline(placed))
    single = lambda rows: rows.select(*common, F.lit(True).alias("required"), F.lit(0).alias("group"), F.lit(0).cast("bigint").alias("ord"))
    items = single(visited.filter("slot = 'items'"))

    # A body without named properties is one field that stands for all of it; a field root is itself.
    whole = single(nodes.filter("path = '' and (usage = 'field' or property_count = 0)").withColumn(
        "slot", F.when(F.col("usage") == BODY, "passthrough").otherwise("root")))
    fields = properties.unionByName(items).unionByName(whole)
    is_nested = (~F.col("slot").isin("passthrough") & (F.col("kind") == "object") & F.col("ref_name").isNotNull()
                 & F.col("has_properties") & (F.col("language") != "python"))
    wrap = F.when(is_nested, F.when(F.col("language") == "java", builder_wrap(strip_schema_prefix(F.col("ref_name")))).otherwise("{ {{__body__}} }"))
    fields = fields.withColumn("wrap", wrap)
    empty_nested = (fields.filter("wrap is not null and property_count = 0").withColumn("parent_path", F.col("path"))
                    .withColumn("path", F.concat("path", F.lit("/passthrough"))).withColumn("slot", F.lit("passthrough"))
                    .withColumn("required", F.lit(True)).withColumn("enum", F.lit(None).cast("array<string>")).withColumn("wrap", F.lit(None).cast("string")))
    unnamed = ~F.col("slot").isin("properties")
    json_key = F.when(unnamed, "").otherwise(F.col("key"))
    return (fields.unionByName(empty_nested)
            .withColumn("json_key", json_key)
            .withColumn("field_template", F.when(unnamed, "{{value}}").otherwise(field_template(F.col("key"), F.col("language"), F.col("key"))))
            .withColumn("passthrough", F.col("slot") == "passthrough")
            .withColumn("enum_values", F.when((F.col("kind") == "enum") & ~F.col("passthrough"), F.col("enum")))
            .withColumn("enum_constants", F.when(F.col("enum_values").isNotNull(), enum_constants(F.col("enum"), F.col("ref_name"), F.col("language"))))
            .withColumn("depth", F.size(_steps(F.col("path"))) + F.when(F.col("path").endswith("/passthrough"), 1).otherwise(0))
            .select(*ROOT, "usage", "language", "path", "parent_path", "slot", "depth", "group", "ord", "json_key", "field_template", "kind",
                    "required", "passthrough", "enum_values", "enum_constants", "wrap"))


def is_top(field: str = "") -> Column:
    """Fields an endpoint itself offers, as against those nested in another field."""
    c = lambda name: F.col(field + name)
    return (c("path") == "") | ((c("usage") == BODY) & (c("depth") == 1) & (c("slot") == "properties"))


def _own_extras() -> Column:
    strings = lambda values: F.concat(F.lit("["), F.array_join(F.transform(values, quote), ","), F.lit("]"))
    pairs = F.transform(F.map_entries("enum_constants"), lambda e: F.concat(quote(e["key"]), F.lit(":"), quote(e["value"])))
    part = lambda name, value: F.coalesce(F.concat(F.lit(f',"{name}":'), value), F.lit(""))
    return F.concat(F.when(F.col("passthrough"), ',"passthroughBody":true').otherwise(""), part("enumValues", strings(F.col("enum_values"))),
                    part("enumConstants", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))))


def field_json(template: Column, extras: Column) -> Column:
    return F.concat(F.lit('{"jsonKey":'), quote(F.col("json_key")), F.lit(',"fieldTemplate":'), quote(template), F.lit(',"kind":"'), F.col("kind"),
                    F.lit('","required":'), F.col("required").cast("string"), extras, F.lit("}"))


def with_nested_json(fields: DataFrame) -> DataFrame:
    """Top fields with `extras`: the JSON of all that hangs below them, put together from the leaves up."""
    rows = checkpointed(fields.withColumn("own", _own_extras()))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(deepest, -1, -1):
        level = rows.filter(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("extras", F.col("own"))
        else:
            nested = F.concat(F.lit(',"nested":{"fieldSeparator":'), quote(separator(F.col("language"))), F.lit(',"fields":['), F.col("inner_fields"),
                              F.lit('],"wrap":'), quote(F.col("wrap")), F.lit("}"))
            level = joined(level, below, [*ROOT, "path"], "left").withColumn("extras", F.concat(
                "own", F.coalesce(F.concat(F.lit(',"items":'), "item"), F.lit("")), F.coalesce(nested, F.lit(""))))
        done = level.filter(is_top()) if depth == deepest else done.unionByName(level.filter(is_top()), allowMissingColumns=True)
        json = field_json(F.col("field_template"), F.col("extras"))
        # The fields of one object: no more than its declaration lists.
        below = (level.filter(~is_top()).groupBy(*ROOT, F.col("parent_path").alias("path")).agg(
            F.max(F.when(F.col("slot") == "items", json)).alias("item"),
            F.sort_array(F.collect_list(F.when(F.col("slot") != "items", F.struct("group", "ord", json.alias("json"))))).alias("list"))
            .withColumn("inner_fields", F.when(F.size("list") > 0, F.array_join(F.col("list.json"), ","))).drop("list"))
    return done.select(*fields.columns, "extras")


def top_fields(endpoints: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields of each endpoint: those of its body, then its query parameters.

    `endpoints` come from `with_shape`. In Python a field goes by the name the SDK gave it.
    """
    kwarg = F.coalesce(F.try_element_at("body_kwarg_by_json_key", F.col("json_key")), F.col("json_key"))
    named = lambda: F.when(F.col("passthrough"), "{{value}}").otherwise(field_template(F.col("json_key"), F.col("language"), kwarg))
    keep = ["kind", "required", "passthrough", "enum_values", "enum_constants", "wrap", *(["extras"] if "extras" in fields.columns else [])]
    about = [*ENDPOINT_KEY, "http_method", "http_path", "language", "body_kwarg_by_json_key"]
    top = fields.filter(is_top())

    body = (joined(endpoints.select(*about, F.col("body_root").alias("root_id")), top.filter("usage = 'body'").drop("language", "usage"), ROOT)
            .select(*about, F.lit(0).alias("part"), "group", "ord", "root_id", "path", "json_key", *keep))
    asked = (endpoints.filter("folds_query").select(*about, F.posexplode("query_params").alias("pos", "param"))
             .select(*about, "pos", F.col("param.name").alias("json_key"), F.col("param.required").alias("is_required"),
                     root_id(F.lit(FIELD), F.col("param.schema")).alias("root_id"), F.col("param.schema").isNotNull().alias("has_schema"))
             .withColumn("root_id", F.when(F.col("has_schema"), F.col("root_id"))))
    roots = top.filter("usage = 'field'").drop("language", "usage", "required", "group", "ord", "json_key", "field_template")
    query = (joined(asked, roots, ROOT, "left")
             .withColumn("kind", F.coalesce("kind", F.lit("object"))).withColumn("required", F.col("is_required"))
             .withColumn("passthrough", F.lit(False)))
    if "extras" in keep:
        query = query.withColumn("extras", F.coalesce("extras", F.lit("")))
    query = query.select(*about, F.lit(1).alias("part"), F.lit(0).alias("group"), F.col("pos").cast("bigint").alias("ord"), "root_id", "path", "json_key", *keep)
    return body.unionByName(query).withColumn("field_template", named()).drop("body_kwarg_by_json_key")


def root_kinds(nodes: DataFrame) -> DataFrame:
    return nodes.filter("path = ''").select(*ROOT, "usage", "kind", "property_count")


def params_in_url_order(params: Column, http_path: Column) -> Column:
    """Path parameters as the URL names them, then those it does not name."""
    def order(declared):
        hits = F.array_compact(F.transform(F.array_distinct(placeholders(http_path)), lambda key: F.try_element_at(
            F.filter(declared, lambda d: d["snake"] == key), F.lit(-1))))
        return bind(hits, lambda found: F.concat(found, F.filter(declared, lambda d: ~F.exists(found, lambda f: f["pos"] == d["pos"]))))

    snaked = F.transform(params, lambda p, i: F.struct(i.alias("pos"), p["name"].alias("name"), p["kind"].alias("kind"), camel_to_snake(p["name"]).alias("snake")))
    return F.transform(bind(snaked, order), lambda p: F.struct(p["name"].alias("name"), p["kind"].alias("kind")))


def with_params(endpoints: DataFrame, kinds: DataFrame) -> DataFrame:
    """Adds `params`: name and kind of each path parameter in URL order."""
    asked = endpoints.select(*ENDPOINT_KEY, "http_path", F.posexplode("path_params").alias("pos", "param"))
    kind_of = kinds.filter("usage = 'field'").select(*ROOT, "kind")
    # As many rows per endpoint as it has parameters.
    known = (joined(asked.withColumn("root_id", root_id(F.lit(FIELD), F.col("param.schema"))), kind_of, ROOT, "left")
             .groupBy(*ENDPOINT_KEY).agg(F.sort_array(F.collect_list(F.struct(
                 "pos", F.col("param.name").alias("name"),
                 F.when(F.col("param.schema").isNull(), "object").otherwise(F.coalesce("kind", F.lit("object"))).alias("kind")))).alias("declared")))
    none = F.array().cast("array<struct<name:string,kind:string>>")
    return (joined(endpoints, known, ENDPOINT_KEY, "left")
            .withColumn("params", F.coalesce(params_in_url_order(F.col("declared"), F.col("http_path")), none)).drop("declared"))


def with_shape(endpoints: DataFrame, kinds: DataFrame) -> DataFrame:
    """Matched endpoints with all that decides how their body is called.

    Adds `body_root`, `is_passthrough`, `has_body`, `folds_query`, `drops_query`, `java_unrenderable`.
    """
    body_kind = kinds.filter("usage = 'body'").select("repo_id", F.col("root_id").alias("body_root"), "property_count")
    rooted = endpoints.withColumn("body_root", F.when(F.col("body_schema").isNotNull(), root_id(F.lit(BODY), F.col("body_schema"))))
    shaped = joined(rooted, body_kind, ["repo_id", "body_root"], "left")
    has_query = F.size("query_params") > 0
    passthrough = F.coalesce(F.col("property_count") == 0, F.lit(False))
    blocked = passthrough | F.col("body_wrapper_key").isNotNull()
    has_body = F.col("body_root").isNotNull() | (has_query & ~blocked)
    return (shaped.withColumn("is_passthrough", passthrough).withColumn("has_body", has_body)
            .withColumn("folds_query", has_query & ~blocked).withColumn("drops_query", has_query & blocked)
            .withColumn("java_unrenderable", (F.col("language") == "java") & has_body & ~passthrough & F.col("request_class_name").isNull())
            .drop("property_count"))


def warnings(shaped: DataFrame) -> DataFrame:
    """What could not go into a call, one row each."""
    reason = F.when(F.col("body_wrapper_key").isNotNull(), "query_dropped_wrapped_body").otherwise("query_dropped_passthrough_body")
    found = F.array_compact(F.array(F.when(F.col("drops_query"), reason), F.when(F.col("java_unrenderable"), F.lit("java_body_without_request_class"))))
    return shaped.select(*ENDPOINT_KEY, "http_method", "http_path", F.explode(found).alias("warning"))


def body_slot() -> Column:
    """The body's place in the call; NULL without a body."""
    body = F.lit("{{__body__}}")
    python, typescript = F.col("language") == "python", F.col("language") == "typescript"
    bare = F.when(F.col("is_passthrough"), body).otherwise("{ {{__body__}} }")
    wrapped = F.when(F.col("body_wrapper_key").isNull(), bare).otherwise(
        F.concat(F.lit("{ "), quote(F.col("body_wrapper_key")), F.lit(": "), bare, F.lit(" }")))
    slot = (F.when(F.col("is_passthrough") & python, F.concat(F.coalesce("body_kwarg_for_passthrough", F.lit("request")), F.lit("={{__body__}}")))
            .when(typescript, wrapped).when(F.col("is_passthrough"), body)
            .when(F.col("request_class_name").isNotNull() & (F.col("language") == "java"), builder_wrap(F.col("request_class_name")))
            .otherwise(body))
    return F.when(F.col("has_body") & ~F.col("java_unrenderable"), slot)


def call_template() -> Column:
    """The call with a placeholder for each argument."""
    slot = lambda p: F.concat(F.lit("{{"), p["name"], F.lit("}}"))
    label = lambda p, i: F.coalesce(F.get("path_param_names", i), p["name"])
    args = F.transform("params", lambda p, i: F.when(
        F.col("language") == "python", F.concat(label(p, i), F.lit("="), slot(p))).otherwise(slot(p)))
    accessors = F.transform(F.slice("method_chain", F.lit(1), F.size("method_chain") - 1), lambda s: F.when(
        F.col("language") == "java", F.concat(s, F.lit("()"))).otherwise(s))
    chain = F.array_join(F.concat(F.array(F.lit("client")), accessors, F.array("method_name")), ".")
    return F.concat(chain, F.lit("("), F.array_join(F.array_compact(F.concat(args, F.array("body_slot"))), ", "), F.lit(")"))


def with_call_template(shaped: DataFrame, kinds: DataFrame) -> DataFrame:
    return (with_params(shaped, kinds).withColumn("body_slot", body_slot()).withColumn("call_template", call_template()))


def render_schemas(endpoints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Matched endpoints (with `language`) plus `render`, the JSON of their render schema."""
    kinds = checkpointed(root_kinds(nodes))
    shaped = with_call_template(with_shape(endpoints, kinds), kinds)
    offered = top_fields(shaped, with_nested_json(catalog(nodes)))
    # The fields of one endpoint: no more than its contract declares.
    bodies = offered.groupBy(ENDPOINT_KEY).agg(F.sort_array(F.collect_list(F.struct(
        "part", "group", "ord", field_json(F.col("field_template"), F.col("extras")).alias("json")))).alias("list"))
    params = F.array_join(F.transform("params", lambda p: F.concat(
        F.lit('{"name":'), quote(p["name"]), F.lit(',"kind":"'), p["kind"], F.lit('"}'))), ",")
    body = F.concat(F.lit(',"body":{"fieldSeparator":'), quote(separator(F.col("language"))), F.lit(',"fields":['), F.array_join(F.col("list.json"), ","), F.lit("]}"))
    return (joined(shaped, bodies, ENDPOINT_KEY, "left")
            .withColumn("render", F.concat(F.lit('{"callTemplate":'), quote(F.col("call_template")), F.lit(',"params":['), params, F.lit("]"),
                                           F.when(F.col("has_body"), body).otherwise(""), F.lit("}")))
            .drop("list"))
