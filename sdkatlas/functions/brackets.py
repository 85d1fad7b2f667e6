"""Bracket-aware text expressions that stay inside one row, so they need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sdkatlas.functions.text import WS, bind, count_of

MARK = "\u0001"
#: How deep brackets stand in others where one pattern cuts a balanced text. Its loops are possessive: they neither backtrack nor recurse.
NESTED = 4


def nested_pattern(opening: str, closing: str) -> tuple[str, str]:
    """Text without these brackets, and a pair of them with at most NESTED more inside each other."""
    plain = rf"[^\{opening}\{closing}]*+"
    nested = rf"\{opening}{plain}\{closing}"
    for _ in range(NESTED):
        nested = rf"\{opening}{plain}(?:{nested}{plain})*+\{closing}"
    return plain, nested


def cut_balanced(text: Column, opening: str, closing: str) -> Column:
    """Prefix of `text` up to the bracket that closes its first opening one; NULL if none does.

    Where the first bracket is an opening one and brackets stand at most NESTED deep in it, one pattern finds the prefix. For other texts
    the text is cut behind every bracket, so the fold runs over brackets, not characters; what follows the last one counts for nothing.
    """
    plain, nested = nested_pattern(opening, closing)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("used"), F.lit(False).alias("opened"), F.lit(False).alias("done"))

    def step(acc, piece):
        opens = F.endswith(piece, F.lit(opening))
        closes = F.endswith(piece, F.lit(closing))
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        opened = acc["opened"] | opens
        return F.when(acc["done"], acc).otherwise(F.struct(
            depth.alias("depth"), (acc["used"] + 1).alias("used"), opened.alias("opened"),
            (closes & opened & (depth == 0)).alias("done")))

    def prefix(pieces):
        used = F.aggregate(pieces, start, step, lambda acc: F.when(acc["done"], acc["used"]))
        return F.array_join(F.slice(pieces, F.lit(1), used), "")

    def cut(whole):
        folded = bind(F.regexp_extract_all(whole, F.lit(rf"\G{plain}[\{opening}\{closing}]"), F.lit(0)), prefix)
        return bind(F.regexp_extract(whole, rf"\A{plain}{nested}", 0), lambda found: F.when(found != "", found).otherwise(folded))

    return bind(text, cut)


def opens_and_closes(text: Column) -> Column:
    """Whether the first bracket is `(` and none of them stays open. Texts in which all brackets pair up are told by one pattern."""
    plain, nested = nested_pattern("(", ")")
    counted = (count_of(text, "(") <= count_of(text, ")")) & F.rlike(text, F.lit(r"\A[^()]*\("))
    return F.rlike(text, F.lit(rf"\A{plain}(?:{nested}{plain})++\z")) | counted


def inside(bracketed: Column) -> Column:
    """Text without its first and last character."""
    return bind(bracketed, lambda t: F.substr(t, F.lit(2), F.length(t) - 2))


def argument_value(call: Column, name: str) -> Column:
    """Text behind the first `name=` that stands directly inside the call's own brackets."""
    def depth(text):
        return count_of(text, "([{") - count_of(text, ")]}")

    def value(parts):
        head = lambda i: F.array_join(F.slice(parts, F.lit(1), i), "")
        hits = F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: bind(head(i), depth) == 1)
        return F.when(F.size(parts) > 1, bind(
            F.get(hits, F.lit(0)), lambda hit: F.array_join(F.slice(parts, hit + 1, F.size(parts)), "")))

    # Most calls lack the argument; the cheap test spares them the search. Without the name and the mark there is one part only.
    possible = F.contains(call, F.lit(name)) | F.contains(call, F.lit(MARK))
    return F.when(possible, bind(F.split(F.regexp_replace(call, rf"(\b{name}{WS}*=)", f"$1{MARK}"), MARK, -1), value))


def innermost_identifier(expr: Column) -> Column:
    """`a(b(c))` and `c` both give `c`; anything that is not an identifier in plain calls gives NULL."""
    shape = rf"\A{WS}*(?:\w+{WS}*\({WS}*)*(\w+)(?:{WS}*\))*{WS}*\z"
    return bind(expr, lambda e: F.when(
        F.rlike(e, F.lit(shape)) & (count_of(e, "(") == count_of(e, ")")), F.regexp_extract(e, shape, 1)))


def keep_last(entries: Column) -> Column:
    """Drop struct(key, value) entries whose key comes again later. Costs nothing extra without repeats."""
    later = lambda rows, e, i: F.exists(F.slice(rows, i + 2, F.size(rows)), lambda x: x["key"] == e["key"])

    def kept(rows):
        keys = F.transform(rows, lambda e: e["key"])
        return (F.when(F.size(F.array_distinct(keys)) == F.size(rows), rows)
                .otherwise(F.filter(rows, lambda e, i: ~later(rows, e, i))))

    return bind(entries, kept)
