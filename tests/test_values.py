import json
import random

import pytest

from sdkatlas.operators.values import merge


@pytest.mark.parametrize("base, over, expected", [
    ({"a": 1, "b": {"c": 2}}, {"b": {"d": 3}, "e": None}, {"a": 1, "b": {"c": 2, "d": 3}, "e": None}),
    ({"a": [1, {"x": 1}]}, {"a": [{"y": 2, "x": 3}]}, {"a": [{"y": 2, "x": 3}]}),
    ({"a": {"b": {"c": 1}}}, {"a": {"b": 5}}, {"a": {"b": 5}}),
    ({"a": 5, "z": "s"}, {"a": {"b": {}}}, {"a": {"b": {}}, "z": "s"}),
    ([1, 2, 3], [4], [4]),
    ({"k/~": {"1": True}}, {}, {"k/~": {"1": True}}),
    ({"a": [{"p": 1, "q": 2}]}, {"a": [{"q": 3, "p": 4}]}, {"a": [{"q": 3, "p": 4}]}),
])
def test_merge(spark, base, over, expected):
    frame = lambda v: spark.createDataFrame([(1, json.dumps(v))], "id int, json string")
    text = merge(frame(base), frame(over), ["id"]).first().json
    assert json.loads(text) == expected
    assert json.dumps(json.loads(text)) == json.dumps(expected)


def rebuilt(value, over):
    """Deep merge by plain recursion."""
    if isinstance(value, dict) and isinstance(over, dict):
        return {**{k: rebuilt(v, over[k]) if k in over else v for k, v in value.items()}, **{k: v for k, v in over.items() if k not in value}}
    return over


def test_merge_at_random(spark):
    rng = random.Random(7)

    def made(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.4:
            return rng.choice([1, 2.5, True, None, "x", "1", "true", "null", "{}", "[1]", 's"q', "back\\slash", "", "é", {}, []])
        if kind < 0.6:
            return [made(depth + 1) for _ in range(rng.randrange(3))]
        return {k: made(depth + 1) for k in rng.sample(["a", "b", "c/d", "e~", "a!", "10x", "a-", "s", ":"], rng.randrange(5))}

    pairs = [(i, made(0), made(0)) for i in range(60)]
    frame = lambda at: spark.createDataFrame([(p[0], json.dumps(p[at], ensure_ascii=rng.random() < 0.5)) for p in pairs], "id int, json string")
    found = {r.id: r.json for r in merge(frame(1), frame(2), ["id"]).collect()}
    for i, base, over in pairs:
        assert json.dumps(json.loads(found[i])) == json.dumps(rebuilt(base, over)), (base, over)


def test_types_survive_a_repeated_key(spark):
    base = '{"n":"123","t":"true","x":{"a":"1","a":"2"},"l":["null",null,"7",7],"x2":{"q":{"z":1,"z":"1"}}}'
    frame = lambda text: spark.createDataFrame([(1, text)], "id int, json string")
    assert merge(frame(base), frame('{"t":"false"}'), ["id"]).first().json == (
        '{"n":"123","t":"false","x":{"a":"2"},"l":["null",null,"7",7],"x2":{"q":{"z":"1"}}}')
