"""Endpoint calls in generated Python clients.

A file is cut where a client class or a public method starts. Each piece then holds at most the one
call its method owns, so the whole extraction is a projection; only the removal of repeated
endpoints shuffles, and it moves extracted rows, not source text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sdkatlas.functions.brackets import argument_value, cut_balanced, innermost_identifier, inside, keep_last, opens_and_closes
from sdkatlas.functions.rows import keep
from sdkatlas.functions.text import (
    LINE_WS, WS, bind, blank_to_null, count_of, cut_lines, first_group, normalize_path, normalize_placeholders, placeholders,
)

FILE_PATTERN = r"raw_client\.py\z"
CALL_TARGET = r"self\._client_wrapper\.httpx_client\."

_CLASS = rf"{LINE_WS}+(?:Async)?Raw\w+Client"  # behind "class"
_SYNC_CLASS = rf"\Aclass{LINE_WS}+Raw\w+Client"
# Most lines start with four spaces: they are read as such, and not tried again one by one.
_METHOD = rf"(?> {{4}}|{LINE_WS}{{4}})def{LINE_WS}+([A-Za-z0-9]\w*){LINE_WS}*\("


def method_chain(path: Column, package_root: Column) -> Column:
    """Directories between the package root and the file, without `resources`."""
    relative = F.regexp_replace(F.substr(path, F.length(package_root) + 2), r"/raw_client\.py\z", "")
    return F.filter(F.split(relative, "/"), lambda part: part != "resources")


def method_pieces(files: DataFrame, call_target: str = CALL_TARGET) -> DataFrame:
    """One row per public method that owns a call: (…, ord, method_name, call_source).

    `call_source` starts with the line of the call. It ends with the method, and goes on to the end
    of the file only where the method's brackets do not add up.
    """
    call = rf"{call_target}(?:request|stream){LINE_WS}*\("
    chunks = cut_lines(F.col("content"), _CLASS, "class")

    def of_chunk(chunk, number):
        piece = lambda text: F.struct(
            number.alias("chunk"), text.alias("text"),
            first_group(text, rf"\A{_METHOD}").alias("method_name"),
            F.rlike(text, F.lit(call)).alias("calls"))
        # the line of the class belongs to no piece
        pieces = F.transform(cut_lines(chunk, _METHOD), lambda text, i: F.when(
            i == 0, bind(F.regexp_replace(text, r"\A[^\n]*", ""), piece)).otherwise(piece(text)))
        return F.when(F.rlike(chunk, F.lit(_SYNC_CLASS)), pieces).otherwise(F.slice(pieces, 1, 0))

    cut = files.withColumn("_chunks", chunks).withColumn(
        "_pieces", F.flatten(F.transform("_chunks", of_chunk)))

    def owner(piece, i):
        # A piece without a public method (the head of a class) continues the previous method,
        # unless a call was seen since.
        before = F.slice("_pieces", F.lit(1), i)
        last = F.element_at(F.filter(F.transform(before, lambda p, j: F.struct(p["method_name"].alias("method_name"), j.alias("at"))),
                                     lambda p: p["method_name"].isNotNull()), -1)
        used = F.exists(F.slice(before, last["at"] + 1, F.size(before)), lambda p: p["calls"])
        return F.when(piece["method_name"].isNotNull(), piece["method_name"]).when(
            (i > 0) & piece["calls"], F.when(~used, last["method_name"]))

    def source(piece, i):
        to_file_end = lambda own: F.concat(
            own,
            F.array_join(F.transform(F.filter(
                F.slice("_pieces", i + 2, F.size("_pieces")), lambda p: p["chunk"] == piece["chunk"]), lambda p: p["text"]), ""),
            F.array_join(F.slice("_chunks", piece["chunk"] + 2, F.size("_chunks")), ""))
        # the call and all behind it, and what its line has before it
        before = lambda called: F.substring_index(F.left(piece["text"], F.length(piece["text"]) - F.length(called)), "\n", -1)
        from_call = bind(F.regexp_extract(piece["text"], rf"(?s){call}.*", 0), lambda called: F.concat(before(called), called))
        return bind(from_call, lambda own: F.when(opens_and_closes(own), own).otherwise(to_file_end(own)))

    owned = F.transform("_pieces", lambda piece, i: F.when(piece["calls"], F.struct(
        i.alias("ord"), owner(piece, i).alias("method_name"), source(piece, i).alias("call_source"))))
    kept = F.filter(owned, lambda o: o["method_name"].isNotNull())
    return cut.select(*files.drop("content").columns, F.inline(kept))


def call_spans(pieces: DataFrame) -> DataFrame:
    """The call's text up to its closing bracket, however many lines that takes."""
    return (pieces.withColumn("call_text", F.coalesce(cut_balanced(F.col("call_source"), "(", ")"), F.col("call_source")))
            .drop("call_source"))


def request_path(call: Column) -> Column:
    template = first_group(call, r'f"(?<![A-Za-z0-9_]f")([^"]+)"')
    literal = first_group(call, rf'\({WS}*"([^"]+)"{WS}*[,)]')
    return F.coalesce(F.regexp_replace(template, r"\{\w+\((\w+)\)\}", r"{$1}"), literal)


def request_verb(call: Column) -> Column:
    return first_group(call, rf'method{WS}*={WS}*"(\w+)"')


def path_parameter_names(raw_path: Column) -> Column:
    return placeholders(F.regexp_replace(raw_path, r"\{\w+\((\w+)\)\}", r"{$1}"))


def dict_entries(body: Column) -> Column:
    """`"wire": identifier` pairs as a map. Commas always separate, nested or not."""
    pattern = F.lit(rf'"([^"]+)"{WS}*:{WS}*([^,]+)')
    pairs = lambda b: F.zip_with(
        F.regexp_extract_all(b, pattern, F.lit(1)), F.regexp_extract_all(b, pattern, F.lit(2)),
        lambda k, v: F.struct(k.alias("key"), innermost_identifier(v).alias("value")))
    return F.map_from_entries(keep_last(F.filter(bind(body, pairs), lambda p: p["value"].isNotNull())))


def _dict_text(value: Column) -> Column:
    """Inside of the dict literal that `value` starts with."""
    return bind(F.regexp_replace(value, rf"\A{WS}+", ""),
                lambda v: F.when(v.startswith("{"), inside(cut_balanced(v, "{", "}"))))


def _passthrough_identifier(value: Column) -> Column:
    """Identifier that is the whole argument, bare or inside plain calls."""
    shape = rf"\A{WS}*((?:\w+{WS}*\({WS}*)*)(\w+){WS}*((?:\){WS}*)*)"

    def read(v):
        opened = count_of(F.regexp_extract(v, shape, 1), "(")
        closed = count_of(F.regexp_extract(v, shape, 3), ")")
        ended = F.rlike(v, F.lit(shape + r"(?:[,\]}]|\z)"))
        return F.when((closed > opened) | ((closed == opened) & ended), blank_to_null(F.regexp_extract(v, shape, 2)))

    return bind(value, read)


def body_arguments(calls: DataFrame) -> DataFrame:
    """`body_kwargs` for a dict body, `body_passthrough` for a body handed on whole."""
    value = F.col("_json")
    return (calls.withColumn("_json", argument_value(F.col("call_text"), "json"))
            .withColumn("body_kwargs", dict_entries(_dict_text(value)))
            .withColumn("body_passthrough", F.when(~F.rlike(value, F.lit(rf"\A{WS}*\{{")), _passthrough_identifier(value)))
            .drop("_json"))


def query_arguments(calls: DataFrame) -> DataFrame:
    return calls.withColumn("query_kwargs", dict_entries(_dict_text(argument_value(F.col("call_text"), "params"))))


def merge_arguments(calls: DataFrame) -> DataFrame:
    """`merged_kwargs`: query entries win over body entries of the same key."""
    body, query = F.col("body_kwargs"), F.col("query_kwargs")
    kept = F.map_filter(body, lambda k, v: ~F.array_contains(F.map_keys(query), k))
    return calls.withColumn("merged_kwargs", F.coalesce(F.map_concat(kept, query), body, query))


def first_per_file(rows: DataFrame) -> DataFrame:
    """First row of each endpoint in its file. The rank limit runs before the shuffle too."""
    by = Window.partitionBy("repo_id", "path", "http_method", "http_path").orderBy("ord")
    return rows.withColumn("_rank", F.row_number().over(by)).filter("_rank = 1").drop("_rank")


def calls_with_targets(spans: DataFrame) -> DataFrame:
    """Calls that give both a path and a verb: adds raw_path, http_method, http_path."""
    def target(path, verb):
        return F.when(path.isNotNull() & verb.isNotNull(), F.struct(
            path.alias("raw_path"), verb.alias("http_method"),
            normalize_placeholders(normalize_path(path)).alias("http_path")))

    text = F.col("call_text")
    record = bind(request_path(text), lambda path: bind(request_verb(text), lambda verb: target(path, verb)))
    return keep(spans, spans.columns, record)


def python_endpoints(files: DataFrame) -> DataFrame:
    """Mappings from `files(repo_id, path, content, package_root)`; only raw clients are read."""
    clients = (files.filter(F.rlike("path", F.lit(FILE_PATTERN))
                            & F.col("path").startswith(F.concat("package_root", F.lit("/"))))
               .withColumn("chain", method_chain(F.col("path"), F.col("package_root")))
               .filter(~F.array_contains("chain", "core")))
    calls = merge_arguments(query_arguments(body_arguments(calls_with_targets(call_spans(method_pieces(clients))))))
    names = path_parameter_names(F.col("raw_path"))
    return first_per_file(calls.select(
        "repo_id", "path", F.col("ord").cast("bigint").alias("ord"), "http_method", "http_path",
        F.concat("chain", F.array("method_name")).alias("method_chain"), "method_name",
        names.alias("path_param_names"),
        F.col("merged_kwargs").alias("body_kwarg_by_json_key"),
        F.col("body_passthrough").alias("body_kwarg_for_passthrough")))
