import json
import random

import pytest

from sdkatlas.operators import schema

ref = lambda name: {"$ref": f"#/components/schemas/{name}"}
COMPONENTS = {
    "Alias": ref("Obj"),
    "Obj": {"type": "object", "required": ["b"], "properties": {"a": {"type": "string"}, "b": ref("Alias"), "7": {"enum": [1, None, "x"]}, "3": {"type": ["string", "null"]}},
            "additionalProperties": {"type": "number"}},
    "Base": {"type": "object", "required": ["x"], "properties": {"x": {"type": "object", "properties": {"deep": {"type": "string"}}}, "y": {"type": "number"}}},
    "Kid": {"allOf": [ref("Base"), {"allOf": [{"required": ["z", "x"], "properties": {"z": {"type": "string"}, "x": {"type": "boolean"}}}], "items": {}}, ref("Nope")],
            "properties": {"y": {"type": "string"}, "q": ref("Base")}, "required": ["q", "q"], "additionalProperties": False},
    "Union": {"oneOf": [ref("Base"), {"type": "array", "items": ref("Union")}], "anyOf": [{"type": "string", "format": "uuid"}]},
}
ROOTS = {"alias": ref("Alias"), "kid": ref("Kid"), "union": ref("Union"), "unknown": {"items": ref("Nope")}, "foreign": {"$ref": "other.json#/X", "type": "string"},
         "sibling": {"$ref": "#/components/schemas/Base", "type": "array"}, "slash": {"properties": {"a/b": {"type": "string"}}}}


@pytest.fixture(scope="module")
def trees(spark):
    components = spark.createDataFrame([(1, k, json.dumps(v)) for k, v in COMPONENTS.items()], "repo_id bigint, name string, text string")
    roots = spark.createDataFrame([(1, k, json.dumps(v)) for k, v in ROOTS.items()], "repo_id bigint, root_id string, text string")
    found = {}
    for row in schema.resolve(roots, components).collect():
        found.setdefault(row.root_id, {})[row.path] = row
    return found


def children(tree, parent):
    return [r.key for r in sorted((r for r in tree.values() if r.parent_path == parent and r.slot == "properties"), key=lambda r: r.ord)]


def test_alias_keeps_the_outer_name_and_a_cycle_ends_in_a_marker(trees):
    tree = trees["alias"]
    assert (tree[""].ref_name, tree[""].type, tree[""].required) == ("Alias", "object", ["b"])
    assert (tree["/properties/b"].ref_name, tree["/properties/b"].type) == ("Alias", None)
    assert children(tree, "") == ["3", "7", "a", "b"]
    assert (tree["/properties/7"].enum, tree["/properties/3"].type) == (["1", "null", "x"], None)
    assert tree["/additionalProperties"].type == "number"


def test_allof(trees):
    tree = trees["kid"]
    assert (tree[""].type, tree[""].required, tree[""].ref_name, tree[""].additional) == ("object", ["q", "q", "x", "z"], "Kid", False)
    assert children(tree, "") == ["y", "q", "x", "z"]
    assert (tree["/properties/y"].type, tree["/properties/x"].type) == ("number", "boolean")
    # The beaten declaration of x took its own properties with it; the one below q is another x.
    assert "/properties/x/properties/deep" not in tree and "/properties/q/properties/x/properties/deep" in tree
    assert "/items" not in tree


def test_other_slots_and_unknown_references(trees):
    assert (trees["union"]["/oneOf/0"].ref_name, trees["union"]["/oneOf/1/items"].ref_name, trees["union"]["/anyOf/0"].format) == ("Base", "Union", "uuid")
    assert trees["unknown"]["/items"].ref_name == "Nope"
    assert (trees["foreign"][""].ref_name, trees["foreign"][""].type) == (None, None)
    assert trees["sibling"][""].type == "object"
    assert set(trees["slash"]) == {"", "/properties/a~1b"}


def resolved_by_hand(text, components, visited=(), ref_name=None):
    """A resolved node as nested dicts, by plain recursion."""
    if "$ref" in text:
        name = text["$ref"].removeprefix("#/components/schemas/") if text["$ref"].startswith("#/components/schemas/") else None
        outer = ref_name or name
        if name is None or name in visited or name not in components:
            return {"ref_name": outer, "type": None, "properties": {}, "items": None}
        return resolved_by_hand(components[name], components, (*visited, name), outer)
    parts = [resolved_by_hand(m, components, visited) for m in text.get("allOf", [])]
    properties = {k: resolved_by_hand(v, components, visited) for k, v in text.get("properties", {}).items()}
    for part in parts:
        properties.update(part["properties"])
    items = resolved_by_hand(text["items"], components, visited) if "items" in text else None
    kind = text.get("type") or next((p["type"] for p in parts if p["type"]), None)
    return {"ref_name": ref_name, "type": kind, "properties": properties, "items": items}


def flat(node, path=""):
    yield path, (node["ref_name"], node["type"])
    for key, child in node["properties"].items():
        yield from flat(child, f"{path}/properties/{key}")
    if node["items"] is not None:
        yield from flat(node["items"], f"{path}/items")


def resolve_all(spark, components, roots):
    made = schema.resolve(spark.createDataFrame([(1, k, json.dumps(v)) for k, v in roots.items()], "repo_id bigint, root_id string, text string"),
                          spark.createDataFrame([(1, k, json.dumps(v)) for k, v in components.items()], "repo_id bigint, name string, text string"))
    found = {}
    for r in made.collect():
        assert r.path not in found.setdefault(r.root_id, {})
        found[r.root_id][r.path] = (r.ref_name, r.type)
    return found


def test_a_chain_of_thirty_and_a_cycle_of_five(spark, monkeypatch):
    chain = {f"C{i}": {"type": "object", "properties": {"next": ref(f"C{i + 1}"), "own": {"type": "string"}}} for i in range(29)} | {"C29": {"type": "number"}}
    cycle = {f"R{i}": {"type": "object", "properties": {"on": ref(f"R{(i + 1) % 5}"), "list": {"type": "array", "items": ref("C27")}}} for i in range(5)}
    components = chain | cycle
    roots = {"chain": ref("C0"), "cycle": ref("R3"), "both": {"allOf": [ref("R1"), {"properties": {"x": ref("C28")}}], "properties": {"on": ref("C29")}}}
    parsed = []
    original = schema.own_nodes
    monkeypatch.setattr(schema, "own_nodes", lambda texts, unit, slots: parsed.append(texts.count()) or original(texts, unit, slots))
    found = resolve_all(spark, components, roots)
    assert parsed == [len(components) + len(roots)]  # each schema and root is taken apart once
    for name, text in roots.items():
        assert found[name] == dict(flat(resolved_by_hand(text, components)))
    deepest = "/properties/next" * 29
    assert found["chain"][deepest] == ("C29", "number") and found["cycle"]["/properties/on" * 5] == ("R3", None)


def test_random_reference_graphs(spark):
    """Cycles, aliases, nested and contested members of allOf, against plain recursion."""
    rng = random.Random(12)
    names = [f"S{i}" for i in range(7)]

    def made(depth):
        kind = rng.random()
        if kind < 0.45 or depth > 2:
            return ref(rng.choice([*names, "Gone"])) if rng.random() < 0.7 else {"type": rng.choice(["string", "number"])}
        text = {"properties": {rng.choice("abc"): made(depth + 1) for _ in range(rng.randrange(3))}}
        if rng.random() < 0.4:
            text["allOf"] = [made(depth + 1) for _ in range(rng.randrange(1, 3))]
        if rng.random() < 0.3:
            text["items"] = made(depth + 1)
        if rng.random() < 0.5:
            text["type"] = "object"
        return text

    components = {name: made(0) for name in names}
    roots = {f"r{i}": made(0) for i in range(12)} | {name: ref(name) for name in names}
    found = resolve_all(spark, components, roots)
    for name, text in roots.items():
        assert found[name] == dict(flat(resolved_by_hand(text, components))), name
