"""JSON values as rows: taken apart level by level, merged, put together again.

`id` columns name the value a row belongs to. `at` is the row's place as a pointer; keys are escaped,
so every step starts with a slash and holds no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sdkatlas.functions.jsontext import json_kind, key_order, marked, members, quote, string_or
from sdkatlas.functions.rows import joined, task_count
from sdkatlas.session import checkpointed

_CHILD = "array<struct<step:string,key:string,ord:bigint,json:string>>"


def escape_key(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _members(json: Column) -> Column:
    return F.transform(members(json), lambda e, i: F.struct(
        F.concat(F.lit("/"), escape_key(e["key"])).alias("step"), e["key"].alias("key"), key_order(e["key"], i).alias("ord"),
        string_or(e["value"], lambda r: r).alias("json")))


def _items(json: Column) -> Column:
    return F.transform(F.from_json(json, "array<string>"), lambda raw, i: F.struct(
        F.concat(F.lit("/"), i.cast("string")).alias("step"), F.lit(None).cast("string").alias("key"), i.cast("bigint").alias("ord"),
        string_or(raw, lambda r: r).alias("json")))


def shred(values: DataFrame, ids: list[str]) -> DataFrame:
    """`values(ids…, json)` to one row per node: (ids…, at, parent, key, ord, depth, kind, within, json).

    `within` lists the kinds of the containers around a node, outermost first: a step that is a number
    may be a key or an index. `json` is a scalar's text; a container's own text has its strings marked. One round per level.
    """
    marks = F.when(json_kind(F.col("json")) == "string", F.col("json")).otherwise(marked(F.col("json")))
    frontier = values.filter("json is not null").withColumn("json", marks).select(
        *ids, F.lit("").alias("at"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("key"),
        F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("depth"), json_kind(F.col("json")).alias("kind"),
        F.array().cast("array<string>").alias("within"), "json")
    children = F.when(F.col("kind") == "object", _members(F.col("json"))).otherwise(_items(F.col("json"))).cast(_CHILD)
    levels = None
    while True:
        level = checkpointed(frontier)
        levels = level if levels is None else levels.unionByName(level)
        containers = level.filter(F.col("kind").isin("object", "array"))
        if containers.isEmpty():
            return levels
        frontier = (containers.select(*ids, F.col("at").alias("parent"), (F.col("depth") + 1).alias("depth"),
                                          F.array_append("within", F.col("kind")).alias("within"), F.inline(children))
                    .select(*ids, F.concat("parent", "step").alias("at"), "parent", "key", "ord", "depth",
                            json_kind(F.col("json")).alias("kind"), "within", "json"))


def assemble(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """`nodes` as `shred` makes them back to (ids…, json), from the deepest level up. Rows are dealt out by their number, for the join as for the groups."""
    rows = checkpointed(nodes)
    tasks = task_count(rows)
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(deepest, -1, -1):
        level = rows.filter(F.col("depth") == depth)
        if below is not None:
            inner = F.coalesce("inner", F.lit(""))
            text = (F.when(F.col("kind") == "object", F.concat(F.lit("{"), inner, F.lit("}")))
                    .when(F.col("kind") == "array", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.col("json")))
        else:
            text = F.col("json")
        level = (level if below is None else joined(level.repartition(tasks, *ids, "at"), below, [*ids, "at"], "left")).withColumn("json", text)
        member = F.when(F.col("key").isNotNull(), F.concat(quote(F.col("key")), F.lit(":"), "json")).otherwise(F.col("json"))
        if depth:
            # The children of one container: no more than its text lists.
            below = level.repartition(tasks, *ids, "parent").groupBy(*ids, F.col("parent").alias("at")).agg(F.array_join(F.transform(
                F.sort_array(F.collect_list(F.struct("ord", member.alias("text")))), lambda c: c["text"]), ",").alias("inner"))
    return level.select(*ids, "json")


def merge(base: DataFrame, over: DataFrame, ids: list[str]) -> DataFrame:
    """Deep merge of two values per id: objects combine, anything else of `over` replaces what it meets.

    Members of `base` keep their place; new ones follow in the order of `over`.

    Both sides are taken apart in one loop. Rows of a value are then brought together once; in the order of their places a
    container stands right before what it holds, so the last replaced place before a row tells whether the row lies below it.
    """
    sides = base.select(*ids, F.lit(False).alias("over"), "json").unionByName(over.select(*ids, F.lit(True).alias("over"), "json"))
    nodes = shred(sides, [*ids, "over"])
    nodes = nodes.repartition(task_count(nodes), *ids)  # both windows below keep this partitioning, and it holds as many rows a task at any size
    here = Window.partitionBy(*ids, "at")
    of_side = lambda column, is_over: F.max(F.when(F.col("over") == is_over, F.col(column))).over(here)
    # Only below objects on both sides do two values meet; below a list everything is one side's.
    in_objects = F.min((F.array_position("within", "array") == 0).cast("int")).over(here) == 1
    rows = (nodes.withColumn("low_kind", of_side("kind", False)).withColumn("high_kind", of_side("kind", True))
            .withColumn("low_ord", of_side("ord", False)).withColumn("in_objects", in_objects))
    meets = F.col("in_objects") & F.col("low_kind").isNotNull() & F.col("high_kind").isNotNull()
    replaced = meets & ~((F.col("low_kind") == "object") & (F.col("high_kind") == "object"))
    # A separator below every character puts a place right before what lies under it.
    so_far = Window.partitionBy(*ids).orderBy(F.replace("at", F.lit("/"), F.lit("\u0000"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("cut", F.last(F.when(replaced, F.col("at")), ignorenulls=True).over(so_far))
    below_cut = F.coalesce(F.startswith("at", F.concat("cut", F.lit("/"))), F.lit(False))
    kept = rows.filter(F.col("over") | (F.col("high_kind").isNull() & ~below_cut))
    # No position reaches this far, so new members come after all old ones.
    after = F.col("ord") + F.lit(1 << 40)
    place = F.when(F.col("over"), F.when(meets, F.col("low_ord")).otherwise(after)).otherwise(F.col("ord"))
    return assemble(kept.withColumn("ord", place).drop("over", "low_kind", "high_kind", "low_ord", "in_objects", "cut"), ids)
