import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sdkatlas.functions import text as tx
from sdkatlas.functions.brackets import argument_value, cut_balanced, innermost_identifier, opens_and_closes
from sdkatlas.functions.jsontext import json_kind, key_order, marked, member_json, quote, unmarked


def column_of(spark, values, fn):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", fn(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


@pytest.mark.parametrize("fn, cases", [
    (tx.normalize_path, {"a/b": "/a/b", "/a/b/": "/a/b", "/": "/", "": "/", "a\\b": "/a/b", "/a//": "/a/"}),
    (tx.normalize_placeholders, {"/x/{codeID}": "/x/{code_id}", "/x/{a-B}/{HTTPPath}": "/x/{a-B}/{http_path}", "/noBraces": "/noBraces", "{{aB}}": "{{a_b}}"}),
    (tx.camel_to_snake, {"codeID": "code_id", "HTTPServer": "http_server", "x1Y": "x1_y", "plain": "plain"}),
    (tx.snake_to_camel, {"a_b_1": "aB1", "__a": "_A", "a_B": "a_B", "x": "x"}),
    (tx.pascal_case, {"sys-tem_x": "SysTemX", "a": "A", "": ""}),
    (tx.screaming_snake, {"a-b_c": "A_B_C"}),
    (tx.strip_schema_prefix, {"stock_item_Item": "Item", "agent_Chat_Role": None, "Role": "Role", "agent_role": "agent_role"}),
    (innermost_identifier, {"a": "a", "f(g( a ))": "a", "a.b": None, "f(a, b)": None, "f(a": None, "(a)": None}),
    (json_kind, {'{"a":1}': "object", "[1]": "array", '"s"': "string", "true": "boolean", "null": "null", " -1": "number"}),
    (quote, {'a"b\n': '"a\\"b\\n"', "": '""'}),
])
def test_expressions(spark, fn, cases):
    assert column_of(spark, cases, fn) == list(cases.values())


def test_brackets(spark):
    assert column_of(spark, ["f(a(b)c)d)", "f(a", "x"], lambda c: cut_balanced(c, "(", ")")) == ["f(a(b)c)", None, None]
    calls = ["f(x, json=a)", "f(g(json=b), json = c)", "f(myjson=a)", "f(h(json=b))"]
    assert column_of(spark, calls, lambda c: argument_value(c, "json")) == ["a)", " c)", None, None]


def test_json_members(spark):
    texts = ['{"v": null}', '{"v": "1"}', '{"v": {"b": 1, "a": [2]}}', '{"w": 1}', '{"v": 1.5}']
    assert column_of(spark, texts, lambda c: member_json(c, "v")) == ["null", '"1"', '{"b":1,"a":[2]}', None, "1.5"]
    keys = ["x", "2XX", "201", "200", "01"]
    ordered = sorted(zip(column_of(spark, keys, lambda c: key_order(c, F.col("i"))), keys))
    assert [k for _, k in ordered] == ["200", "201", "x", "2XX", "01"]


def test_member_types_come_from_the_text(spark):
    """Also beside a repeated key, where no typed reader takes the object."""
    values = ['"123"', "123", '"true"', "true", '"null"', "null", '"{}"', "{}", '"s"', '""', '"a\\\\"', '"q\\"x\\" : y"', '["1",1,"s"]', '{"k":"v","n":[{"z":"1"}]}', '"é\\u00e9"']
    repeated = [f'{{"x":{{"a":1,"a":"2"}},"v":{v}}}' for v in values]
    last = [f'{{"v":"first", "v" : {v} , "s":"v"}}' for v in values]
    expected = [json.loads(v) for v in values]
    for texts in (repeated, last):
        found = column_of(spark, texts, lambda c: member_json(c, "v"))
        assert [json.loads(f) for f in found] == expected


@given(st.lists(st.dictionaries(st.text(max_size=5), st.recursive(
    st.none() | st.booleans() | st.integers(-10**9, 10**9) | st.text(max_size=6), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=4), inner, max_size=3), max_leaves=8), max_size=3), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_marks_come_off_again(spark, documents):
    texts = [json.dumps(d) for d in documents]
    assert column_of(spark, texts, lambda c: unmarked(marked(c))) == texts
    wrapped = [json.dumps({"v": d, "w": 1}) for d in documents]
    assert [json.loads(f) for f in column_of(spark, wrapped, lambda c: member_json(c, "v"))] == documents


def test_cut_lines_keeps_every_character(spark):
    """As a look-ahead in front of every line cuts, with the text searched for as a pattern or as plain text."""
    texts = ["", "x", "\n", "def a\ndef b\n", "\ndef a\n\n    def\ndef b", "a\r\ndef b\r\n", "undef\ndefdef\n\n"]
    for pattern, start in (("def", ""), ("f", "de")):
        assert column_of(spark, texts, lambda t: tx.cut_lines(t, pattern, start)) == [re.split(r"(?<=\n)(?=def)", t) for t in texts]


def test_brackets_nested_or_not(spark):
    """A pattern takes what is nested a few times, a fold the rest: the same from both, and neither recurses deeply."""
    def brute(t):
        depth, opened = 0, False
        for i, c in enumerate(t):
            depth, opened = depth + (c == "(") - (c == ")"), opened or c == "("
            if c == ")" and opened and not depth:
                return t[:i + 1]
        return None

    rng = random.Random(5)
    texts = ["", "a", "f(x", ")(a)) b", "f(a)(b)", "x)(", *("f" + "(" * n + "a" + ")" * n + " (z)" for n in range(1, 12)), "f(" + "(a, [b])" * 20_000 + ") tail",
             "f(" * 300 + ")" * 301, *("".join(rng.choice("(()) a\n") for _ in range(rng.randint(1, 40))) for _ in range(500))]
    assert column_of(spark, texts, lambda t: cut_balanced(t, "(", ")")) == [brute(t) for t in texts]
    assert column_of(spark, texts, opens_and_closes) == [t.count("(") <= t.count(")") and t.strip(" a\nfxbz,[]")[:1] == "(" for t in texts]


def test_calls_are_not_folded_or_looked_ahead_for(spark):
    """Files are not searched with a look-ahead at every character, and calls of few nested brackets not bracket by bracket."""
    from sdkatlas.operators.py_calls import call_spans, method_pieces
    files = spark.createDataFrame([], "repo_id bigint, path string, content string")
    plan = call_spans(method_pieces(files))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?=^" not in plan and "\\nclass" in plan
