"""Column expressions for paths, identifiers and schema names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as JavaScript defines it. Java's \s knows only the ASCII part.
_UNICODE_WS = r"\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = rf"[\s{_UNICODE_WS}]"
# The same without the line feed, for patterns that must stay on one line.
LINE_WS = rf"[ \t\x0B\f\r{_UNICODE_WS}]"


def bind(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, however often `use` mentions it.

    Inside higher-order functions Spark does not share common subexpressions by itself.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(value: Column) -> Column:
    """`regexp_extract` yields '' where nothing matched; make that NULL."""
    return bind(value, lambda v: F.when(v != "", v))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL without a match. The group must not be able to match ''."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def count_of(text: Column, chars: str) -> Column:
    """How many characters of `text` belong to the ASCII `chars`. Mentions `text` twice.

    Byte-wise replacement is many times faster than `translate`, which works code point by code point.
    """
    without = text
    for char in chars:
        without = F.replace(without, F.lit(char), F.lit(""))
    return F.octet_length(text) - F.octet_length(without)


def cut_lines(text: Column, pattern: str, start: str = "") -> Column:
    """`text` cut in front of every line but the first that starts with `start` and then matches `pattern`.

    What the search looks for first is plain text, the line feed and `start`: that is many times faster than a look-ahead at every character.
    It is put back where it was.
    """
    return bind(F.split(text, rf"\n{start}(?={pattern})", -1), lambda pieces: F.transform(pieces, lambda piece, i: F.concat(
        F.when(i > 0, start).otherwise(""), piece, F.when(i < F.size(pieces) - 1, "\n").otherwise(""))))


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def camel_to_snake(name: Column) -> Column:
    words = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(words, "([a-z0-9])([A-Z])", "$1_$2"))


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def snake_to_camel(name: Column) -> Column:
    words = F.split(name, "_(?=[a-z0-9])", -1)
    return F.array_join(
        F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(_capitalised(w))), "")


def pascal_case(name: Column) -> Column:
    return _capitalised(snake_to_camel(F.translate(name, "-", "_")))


def screaming_snake(name: Column) -> Column:
    return F.upper(F.translate(name, "-", "_"))


def strip_schema_prefix(name: Column) -> Column:
    """Bare class name behind a resource prefix.

    NULL when several capitalised segments follow underscores: the name could then be one
    joined class or a nested one. Names without such a segment stay as they are.
    """
    segments = F.regexp_extract_all(name, F.lit("_[A-Z][A-Za-z0-9]*"), F.lit(0))
    tail = first_group(name, r"_([A-Z][A-Za-z0-9]*)\z")
    return F.when(F.size(segments) <= 1, F.coalesce(tail, name))


def normalize_path(path: Column) -> Column:
    """Forward slashes, one leading slash, at most one trailing slash removed."""
    slashed = F.translate(path, "\\", "/")
    rooted = F.when(F.startswith(slashed, F.lit("/")), slashed).otherwise(F.concat(F.lit("/"), slashed))
    return F.when(F.length(rooted) > 1, F.regexp_replace(rooted, r"/\z", "")).otherwise(rooted)


def placeholders(path: Column) -> Column:
    """Names inside `{name}`, in order."""
    return F.regexp_extract_all(path, F.lit(r"\{(\w+)\}"), F.lit(1))


def normalize_placeholders(path: Column) -> Column:
    """`{codeID}` becomes `{code_id}`; text outside placeholders is untouched."""
    pieces = F.split(path, r"(?<=\})|(?=\{)", -1)
    renamed = F.transform(
        pieces, lambda p: F.when(F.rlike(p, F.lit(r"\A\{\w+\}\z")), camel_to_snake(p)).otherwise(p))
    return F.when(F.contains(path, F.lit("{")), F.array_join(renamed, "")).otherwise(path)
