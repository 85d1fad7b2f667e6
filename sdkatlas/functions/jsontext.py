"""JSON kept as text, read in document order.

A member's value travels as valid JSON text, so its first character tells its type and
nothing is lost that a typed column cannot hold (a present null, member order).

Spark's reader gives a member's text without the quotes of a string, so "1" and 1 come out alike, and a variant refuses
an object that repeats a key. Therefore strings are marked in the text before it is read: the lexer of `marked` cuts
the text at its quotes, where every second piece is a string, and a string before a colon is a key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sdkatlas.functions.text import bind

TEXT_MAP = "map<string,string>"

# Stand for an escaped backslash and an escaped quote; valid JSON holds neither character as it is.
_BACKSLASH, _QUOTE = "\u0001", "\u0002"
# Before the text of a string value. No other JSON value starts with it.
_MARK = "s"

# Behind every integer-like key: those are at most 2^32 - 2.
_AFTER_INDEXES = 1 << 33


def key_order(key: Column, pos: Column) -> Column:
    """Sort key for object members: integer-like keys first and ascending, then document order."""
    is_index = F.rlike(key, F.lit(r"\A(?:0|[1-9][0-9]{0,9})\z"))
    number = F.when(is_index, key.cast("bigint"))
    return (F.when(is_index & (number < 4294967295), number)
            .otherwise(F.lit(_AFTER_INDEXES) + pos.cast("bigint")))


def once(entries: Column) -> Column:
    """Map entries with each key once: at its first place, with its last value. Spark's reader keeps all."""
    def kept(found):
        names = lambda: F.array_distinct(F.transform(found, lambda e: e["key"]))
        of_name = lambda name: F.element_at(F.filter(found, lambda e: e["key"] == name), -1)
        return F.when(F.size(names()) == F.size(found), found).otherwise(F.transform(names(), of_name))

    return bind(entries, kept)


def members(text: Column) -> Column:
    """Object members as array<struct<key, value>>, value as raw text (strings without quotes)."""
    return once(F.map_entries(F.from_json(text, TEXT_MAP)))


def _strings(text: Column, change) -> Column:
    """`text` with the text of each string value replaced by `change` of it; keys and everything else stay."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))

    def each(pieces):
        is_key = lambda i: F.rlike(F.coalesce(F.get(pieces, i + 1), F.lit("")), F.lit(r"\A\s*:"))
        return F.array_join(F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & ~is_key(i), change(p)).otherwise(p)), '"')

    changed = bind(F.split(plain, '"', -1), each)
    whole = F.replace(F.replace(changed, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    return F.when(F.contains(text, F.lit('"')), whole).otherwise(text)


def marked(text: Column) -> Column:
    """The same JSON with a mark before the text of every string value, at any depth."""
    return bind(text, lambda t: _strings(t, lambda s: F.concat(F.lit(_MARK), s)))


def unmarked(text: Column) -> Column:
    return bind(text, lambda t: _strings(t, lambda s: F.substr(s, F.lit(2))))


def string_or(raw: Column, other) -> Column:
    """JSON text of a value read out of marked text: a string or null as it is known here, `other(raw)` for the rest."""
    return bind(raw, lambda r: F.when(r.isNull(), F.lit("null")).when(F.startswith(r, F.lit(_MARK)), quote(F.substr(r, F.lit(2)))).otherwise(other(r)))


def member_json(text: Column, key: str) -> Column:
    """JSON text of one member: 'null' when it is null, NULL when it is absent. Of a repeated key the last one counts."""
    def value(entries):
        hits = F.filter(entries, lambda e: e["key"] == key)
        return bind(hits, lambda h: F.when(F.size(h) > 0, string_or(F.get(h, F.size(h) - 1)["value"], unmarked)))

    # Most objects lack the key; the cheap test spares them the reading.
    return bind(text, lambda t: F.when(F.contains(t, F.lit(f'"{key}"')), value(F.map_entries(F.from_json(marked(t), TEXT_MAP)))))


def json_kind(json: Column) -> Column:
    return bind(F.substring(F.ltrim(json), 1, 1), lambda head: (
        F.when(head == "{", "object").when(head == "[", "array").when(head == '"', "string")
        .when(head.isin("t", "f"), "boolean").when(head == "n", "null").otherwise("number")))


def quote(text: Column) -> Column:
    """Text as a JSON string literal."""
    return F.when(text.isNotNull(), bind(F.to_json(F.struct(text.alias("s"))), lambda w: F.substr(w, F.lit(6), F.length(w) - 6)))
