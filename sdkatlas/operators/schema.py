"""Schema references resolved into flat node tables.

A resolved schema is a tree of unbounded depth, which no Spark type holds, so it is one row per node
with a JSON-pointer path. Work goes in two parts:

1. Every named schema, and every root, is taken apart once, down to its references (`own_nodes`). This is the only part that
   reads JSON, and its rounds are bounded by how deep one schema's text is nested.
2. Roots grow by grafting (`expand`): each open reference is replaced by the own nodes of the schema it names, moved to its place, by one equi-join.
   Each round goes one name deeper for all roots at once, so rounds are bounded by the longest way through the reference graph
   without a repeated name. Every node is made once, in its final place. A name already on the way to a node is not entered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sdkatlas.functions.jsontext import key_order, once
from sdkatlas.functions.rows import joined, keep
from sdkatlas.functions.text import bind, first_group
from sdkatlas.session import checkpointed

ROOT = ["repo_id", "root_id"]

# The schema types that are kept.
TYPES = ["string", "number", "integer", "boolean", "array", "object"]

_NODE = ("struct<type:string,format:string,required:array<string>,enum:array<string>,properties:map<string,string>,items:string,"
         "additionalProperties:string,oneOf:array<string>,anyOf:array<string>,allOf:array<string>>")

# `open` rows wait for a round; the others are finished nodes. `path` is the node's place in the
# flattened tree, `real_path` its place in the document. A member of an allOf shares the path of its
# `owner` and has a `chain` of member numbers; `object` and `def_chain` say where a property was declared.
_FIELDS = {
    "open": "boolean", "real_path": "string", "path": "string", "parent_path": "string", "slot": "string", "key": "string",
    "ord": "bigint", "owner": "string", "chain": "array<int>", "object": "string", "def_chain": "array<int>",
    "declared_in_allof": "boolean", "contested": "array<string>", "visited": "array<string>", "ref_name": "string", "text": "string",
    "ref": "string", "in_allof": "boolean", "type": "string", "format": "string", "enum": "array<string>", "required": "array<string>",
    "has_properties": "boolean", "property_count": "int", "additional": "boolean",
}


def _row(**values: Column) -> Column:
    return F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _FIELDS.items()])


def reference_of(text: Column) -> Column:
    """Target of a node that is a reference."""
    return F.when(F.contains(text, F.lit('"$ref"')), F.get_json_object(text, "$['$ref']"))


def roots_of(schemas: DataFrame) -> DataFrame:
    """Distinct root schemas of `schemas(repo_id, usage, text)`, named by a digest: each is resolved once."""
    return (schemas.filter("text is not null")
            .withColumn("root_id", root_id(F.col("usage"), F.col("text")))
            .select("repo_id", "root_id", "usage", "text").distinct())


def root_id(usage: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", usage, text), 256)


UNIT = ["repo_id", "unit"]


def _open_texts(texts: DataFrame, unit: list[str]) -> DataFrame:
    """`texts(unit…, text)` as open nodes."""
    none = F.array().cast("array<int>")
    names = F.array().cast("array<string>")
    return texts.select(*unit, F.inline(F.array(_row(
        open=F.lit(True), real_path=F.lit(""), path=F.lit(""), slot=F.lit("root"), ord=F.lit(0), owner=F.lit(""), chain=none,
        contested=names, visited=names, text=F.col("text"), ref=reference_of(F.col("text")), declared_in_allof=F.lit(False)))))


def _children(node: Column, in_allof: Column, slots: tuple[str, ...]) -> Column:
    """Open rows for the parts of a parsed node."""
    real, path = F.col("real_path"), F.col("path")
    is_member = F.size("chain") > 0
    escaped = lambda key: F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))

    def child(suffix: Column, slot: str, text: Column, **more: Column) -> Column:
        values = dict(
            open=F.lit(True), real_path=F.concat(real, suffix), path=F.concat(path, suffix), parent_path=path, slot=F.lit(slot), ord=F.lit(0),
            owner=F.concat(real, suffix), chain=F.array().cast("array<int>"), contested=F.col("contested"), visited=F.col("visited"),
            text=text, ref=reference_of(text), declared_in_allof=F.lit(False))
        return _row(**{**values, **more})

    def property_(entry, pos):
        suffix = F.concat(F.lit("/properties/"), escaped(entry["key"]))
        contested = F.when(in_allof, F.array_append("contested", F.concat(real, suffix))).otherwise(F.col("contested"))
        return child(suffix, "properties", entry["value"], key=entry["key"], ord=key_order(entry["key"], pos), object=F.col("owner"),
                     def_chain=F.col("chain"), contested=contested, declared_in_allof=in_allof)

    def listed(name):
        return F.transform(node[name], lambda text, i: child(
            F.concat(F.lit(f"/{name}/"), i.cast("string")), name, text, ord=i, object=F.col("owner")))

    def single(name, when):
        return F.when(when & ~is_member, F.array(child(F.lit(f"/{name}"), name, node[name], object=F.col("owner"))))

    members = F.transform(node["allOf"], lambda text, i: child(
        F.concat(F.lit("/allOf/"), i.cast("string")), "allOf", text, path=path, parent_path=F.col("parent_path"), ord=i,
        owner=F.col("owner"), chain=F.array_append("chain", i)))
    parts = {
        "properties": F.transform(once(F.map_entries(node["properties"])), property_),
        "items": single("items", node["items"].isNotNull()),
        "additionalProperties": single("additionalProperties", node["additionalProperties"].startswith("{")),
        "oneOf": F.when(~is_member, listed("oneOf")), "anyOf": F.when(~is_member, listed("anyOf")),
    }
    nothing = F.array().cast(f"array<struct<{','.join(f'{n}:{k}' for n, k in _FIELDS.items())}>>")
    return F.concat(*[F.coalesce(parts[s], nothing) for s in slots], F.coalesce(members, nothing))


def _taken_apart(slots: tuple[str, ...]) -> Column:
    """An open node without a reference as rows: the finished node and its open children. Other rows stay."""
    same = ["real_path", "path", "parent_path", "slot", "key", "ord", "owner", "chain", "object", "def_chain", "declared_in_allof", "contested", "ref_name"]

    def rows(node):
        in_allof = (F.size("chain") > 0) | (F.coalesce(F.size(node["allOf"]), F.lit(0)) > 0)
        additional = node["additionalProperties"]
        finished = _row(
            open=F.lit(False), **{name: F.col(name) for name in same}, in_allof=in_allof,
            type=F.when(node["type"].isin(TYPES), node["type"]), format=node["format"], enum=F.transform(node["enum"], lambda v: F.coalesce(v, F.lit("null"))),
            required=node["required"], has_properties=node["properties"].isNotNull(),
            property_count=F.coalesce(F.cardinality(F.map_keys(node["properties"])), F.lit(0)),
            additional=F.when(additional.isin("true", "false"), additional.cast("boolean")))
        return F.concat(F.array(finished), _children(node, in_allof, slots))

    # A schema that is no object reads as an empty one.
    parsed = F.coalesce(F.from_json("text", _NODE), F.from_json(F.lit("{}"), _NODE))
    as_it_is = F.array(_row(**{name: F.col(name) for name in _FIELDS}))
    return F.inline(F.when(F.col("open") & F.col("ref").isNull(), bind(parsed, rows)).otherwise(as_it_is))


ALL_SLOTS = ("properties", "items", "additionalProperties", "oneOf", "anyOf")


def own_nodes(texts: DataFrame, unit: list[str], slots: tuple[str, ...] = ALL_SLOTS) -> DataFrame:
    """The nodes of each text (`texts(unit…, text)`) as far as the text itself goes; references stay open. One round takes two levels apart."""
    apart = _taken_apart(slots)
    frontier, finished = _open_texts(texts, unit), None
    while True:
        step = checkpointed(frontier.select(*unit, apart).select(*unit, apart))
        unfinished = F.col("open") & F.col("ref").isNull()
        done = step.filter(~unfinished)
        finished = done if finished is None else finished.unionByName(done)
        frontier = step.filter(unfinished)
        if frontier.isEmpty():
            return finished


def _grafted(at: dict[str, Column], own: dict[str, Column], name: Column) -> dict[str, Column]:
    """An own node of the schema `name`, moved to the place of the reference `at`.

    At a member of an allOf only properties and members count, the object is the member's owner, and properties are contested.
    """
    is_root = (own["real_path"] == "")
    of_object = (own["owner"] == "")  # the named schema itself and the members of its allOf
    declared_by_object = own["object"] == ""
    is_member = F.size(at["chain"]) > 0
    below_root = lambda value: F.concat(at["real_path"], value)
    # The property of the named object that this node is, or lies below; further in, own contests say all.
    top_property = F.regexp_extract(own["real_path"], r"\A/properties/[^/]+", 0)
    newly_contested = F.when(is_member & (top_property != ""), F.array(below_root(top_property))).otherwise(F.array().cast("array<string>"))
    moved_contests = F.concat(at["contested"], newly_contested, F.transform(own["contested"], below_root))
    return {
        "open": own["open"],
        "real_path": below_root(own["real_path"]),
        "path": F.concat(at["path"], own["path"]),
        # Members of the object share its path, so they share its parent too.
        "parent_path": F.when(own["path"] == "", at["parent_path"]).otherwise(F.concat(at["path"], own["parent_path"])),
        "slot": F.when(is_root, at["slot"]).otherwise(own["slot"]),
        "key": F.when(is_root, at["key"]).otherwise(own["key"]),
        "ord": F.when(is_root, at["ord"]).otherwise(own["ord"]),
        "owner": F.when(of_object, at["owner"]).otherwise(below_root(own["owner"])),
        "chain": F.when(of_object, F.concat(at["chain"], own["chain"])).otherwise(own["chain"]),
        "object": F.when(is_root, at["object"]).when(declared_by_object, at["owner"]).otherwise(below_root(own["object"])),
        "def_chain": F.when(is_root, at["def_chain"]).when(declared_by_object, F.concat(at["chain"], own["def_chain"])).otherwise(own["def_chain"]),
        "declared_in_allof": F.when(is_root, at["declared_in_allof"]).otherwise(
            own["declared_in_allof"] | (is_member & (own["real_path"] == top_property))),
        "contested": moved_contests,
        "visited": F.when(own["open"], F.array_append(at["visited"], name)),
        "ref_name": F.when(is_root, F.coalesce(at["ref_name"], name)).otherwise(own["ref_name"]),
        "ref": own["ref"],
        "in_allof": own["in_allof"] | (of_object & is_member),
        **{n: own[n] for n in ("type", "format", "enum", "required", "has_properties", "property_count", "additional")},
    }


def _graft(frontier: DataFrame, own: DataFrame) -> DataFrame:
    """Each open reference becomes the nodes of its target, or a finished marker if that is unknown or already entered."""
    named = frontier.withColumn("name", first_group(F.col("ref"), r"\A#/components/schemas/(.+)\z"))
    named = named.withColumn("unit", F.when(~F.array_contains("visited", F.col("name")), F.col("name")))
    moved = own.select(*UNIT, F.struct(*_FIELDS).alias("own"))
    rows = joined(named, moved, UNIT, "left")
    at, node = {n: F.col(n) for n in _FIELDS}, {n: F.col("own")[n] for n in _FIELDS}
    marker = {**at, "open": F.lit(False), "ref": F.lit(None), "ref_name": F.coalesce("ref_name", "name"), "visited": F.lit(None),
              "in_allof": F.size("chain") > 0, "has_properties": F.lit(False), "property_count": F.lit(0)}
    grafted = _grafted(at, node, F.col("name"))
    # What a member of an allOf says besides properties and members is lost.
    lost = (F.size("chain") > 0) & F.rlike(node["real_path"], F.lit(r"\A/(?:items|additionalProperties|oneOf|anyOf)(?:/|\z)"))
    row = F.when(F.col("own").isNull(), _row(**marker)).when(~lost, _row(**grafted))
    return keep(rows, ROOT, row)


def expand(roots: DataFrame, components: DataFrame, slots: tuple[str, ...] = ALL_SLOTS) -> DataFrame:
    """All nodes below the roots, members of an allOf still on their own."""
    named = components.select("repo_id", F.col("name").alias("unit"), F.lit(None).cast("string").alias("root_id"), "text")
    texts = named.unionByName(roots.select(*ROOT, F.lit(None).cast("string").alias("unit"), "text"))
    apart = own_nodes(texts, [*UNIT, "root_id"], slots)
    own, step = apart.filter("unit is not null").drop("root_id"), apart.filter("unit is null").drop("unit")
    finished = None
    while True:
        done = step.filter("not open")
        finished = done if finished is None else finished.unionByName(done)
        frontier = step.filter("open")
        if frontier.isEmpty():
            return finished.drop("open", "text", "ref", "visited")
        step = checkpointed(_graft(frontier, own))


def flatten_members(nodes: DataFrame) -> DataFrame:
    """Members of an allOf merged into their owner.

    The last declaration of a property wins and stands where the first one stood; `type` is the first
    that is given; `required` is the ordered union. What else a member says is lost.
    """
    # Only properties declared around an allOf can collide; all others skip these shuffles.
    declared = nodes.filter("declared_in_allof")
    same = Window.partitionBy(*ROOT, "object", "key")
    placed = (declared.withColumn("_loses", F.col("def_chain") < F.max("def_chain").over(same))
              .withColumn("_place", F.min(F.struct("def_chain", "ord")).over(same)))
    index_first = F.when(F.col("ord") < (1 << 33), F.col("ord")).otherwise(F.lit(1 << 33))
    ordered = placed.withColumn("ord", F.row_number().over(
        Window.partitionBy(*ROOT, "object", "_loses").orderBy(index_first, "_place")).cast("bigint"))
    losers = ordered.filter("_loses").select(*ROOT, F.col("real_path").alias("loser"))
    contests = nodes.filter(F.size("contested") > 0).select(*ROOT, "real_path", F.explode("contested").alias("loser"))
    dead = joined(contests, losers, [*ROOT, "loser"], "left_semi").select(*ROOT, "real_path").distinct()
    alive = joined(nodes.filter("not declared_in_allof").unionByName(ordered.drop("_loses", "_place")), dead, [*ROOT, "real_path"], "left_anti")

    own = ["path", "parent_path", "slot", "key", "ord", "ref_name", "type", "format", "enum", "required", "has_properties", "property_count", "additional"]
    whole = alive.filter("not in_allof").select(*ROOT, *own)
    parts = alive.filter("in_allof").groupBy(*ROOT, "owner").agg(
        F.min_by(F.struct(*own), "chain").alias("own"),
        F.min_by("type", F.when(F.col("type").isNotNull(), F.col("chain"))).alias("type"),
        # One entry per member, so no longer than the declaration itself.
        F.sort_array(F.collect_list(F.struct("chain", "required"))).alias("lists"),
        F.max("property_count").alias("property_count"))
    first, rest = F.col("own.required"), F.flatten(F.filter(F.col("lists.required"), lambda r: r.isNotNull()))
    none = F.array().cast("array<string>")
    union = F.concat(F.coalesce(first, none), F.array_except(F.array_distinct(rest), F.coalesce(first, none)))
    merged = {
        "type": F.col("type"), "property_count": F.col("property_count"), "required": F.when(F.size(union) > 0, union).otherwise(first),
        "has_properties": F.col("own.has_properties") | (F.col("property_count") > 0),
    }
    return whole.unionByName(parts.select(*ROOT, *[merged.get(c, F.col(f"own.{c}")).alias(c) for c in own]))


def resolve(roots: DataFrame, components: DataFrame, slots: tuple[str, ...] = ALL_SLOTS) -> DataFrame:
    """Resolved schemas: `roots(repo_id, root_id, text)` to one row per node."""
    return flatten_members(expand(roots, components, slots))
