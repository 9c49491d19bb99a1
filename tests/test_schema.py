"""The schema compiler against a plain validator on generated records; references, cycles, alternatives."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import schema

SCHEMA = {
    "type": "object", "required": ["name", "kind"], "additionalProperties": False,
    "$defs": {
        "name": {"type": "string", "minLength": 2, "maxLength": 6, "pattern": "^[a-z]"},
        "id": {"oneOf": [{"type": "integer", "minimum": 0}, {"$ref": "#/$defs/name"}, {"type": "number", "maximum": 2}]},
        "person": {"type": "object", "properties": {"name": {"$ref": "#/$defs/name"}, "ids": {"type": "array", "items": {"$ref": "#/$defs/id"}, "minItems": 1, "maxItems": 2}}, "additionalProperties": {"type": ["null", "boolean"]}},
    },
    "properties": {
        "name": {"$ref": "#/$defs/name", "not": {"const": "never"}}, "kind": {"enum": ["a", 1, None, True]}, "exact": {"const": {"a": [1, "x"]}},
        "who": {"anyOf": [{"$ref": "#/$defs/person"}, {"type": "array", "items": {"$ref": "#/$defs/person"}}]},
        "both": {"allOf": [{"type": "number"}, {"minimum": -1, "maximum": 1.5}]}, "none": False, "any": True,
    },
}


def plain(x, rule, path="(root)"):
    if rule is True:
        return []
    if rule is False:
        return [(path, "is not allowed")]
    out = []
    is_number = isinstance(x, (int, float)) and not isinstance(x, bool)
    kinds = {"object": isinstance(x, dict), "array": isinstance(x, list), "string": isinstance(x, str), "integer": is_number and isinstance(x, int), "number": is_number, "boolean": isinstance(x, bool), "null": x is None}
    inside = lambda k: k if path == "(root)" else f"{path}.{k}"
    same = lambda a, b: type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b
    met = lambda rules: sum(not plain(x, r, path) for r in rules)
    if "$ref" in rule:
        at = SCHEMA
        for part in rule["$ref"][2:].split("/"):
            at = at[part]
        out += plain(x, at, path)
    if "type" in rule:
        allowed = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
        out += [] if any(kinds[t] for t in allowed) else [(path, "is not of type " + " or ".join(allowed))]
    if "enum" in rule and not any(same(x, v) for v in rule["enum"]):
        out.append((path, "is none of " + ", ".join(map(schema.shown, rule["enum"]))))
    if "const" in rule and not same(x, rule["const"]):
        out.append((path, "is not " + schema.shown(rule["const"])))
    if isinstance(x, str):
        out += [(path, f"does not match {rule['pattern']}")] if "pattern" in rule and not re.search(rule["pattern"], x) else []
        out += [(path, f"is shorter than {rule['minLength']}")] if len(x) < rule.get("minLength", 0) else []
        out += [(path, f"is longer than {rule['maxLength']}")] if len(x) > rule.get("maxLength", 99) else []
    if is_number:
        out += [(path, f"is less than {rule['minimum']}")] if x < rule.get("minimum", x) else []
        out += [(path, f"is more than {rule['maximum']}")] if x > rule.get("maximum", x) else []
    if isinstance(x, dict):
        out += [(path, f"has no {k}") for k in rule.get("required", ()) if k not in x]
        for k, r in rule.get("properties", {}).items():
            out += plain(x[k], r, inside(k)) if k in x else []
        for k in sorted(set(x) - set(rule.get("properties", ()))):
            more = rule.get("additionalProperties", True)
            out += [(path, f"has no place for {k}")] if more is False else plain(x[k], more, inside(k))
    if isinstance(x, list):
        out += [(path, f"has fewer than {rule['minItems']} items")] if len(x) < rule.get("minItems", 0) else []
        out += [(path, f"has more than {rule['maxItems']} items")] if len(x) > rule.get("maxItems", 99) else []
        for i, y in enumerate(x):
            out += plain(y, rule.get("items", True), inside(str(i)))
    for r in rule.get("allOf", ()):
        out += plain(x, r, path)
    if "anyOf" in rule and met(rule["anyOf"]) == 0:
        out.append((path, "meets none of the alternatives"))
    if "oneOf" in rule and (n := met(rule["oneOf"])) != 1:
        out.append((path, "meets several alternatives" if n else "meets none of the alternatives"))
    if "not" in rule and met([rule["not"]]):
        out.append((path, "is what it must not be"))
    return out


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 6:
        return [None, rng.random() < 0.5, rng.randrange(-3, 4), rng.choice([0.5, 1.25, 2.5, -1.75]), rng.choice(["a", "ab", "never", "Upper", "longer text", "é"]), "abc"][kind]
    if kind == 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {k: value(rng, depth + 1) for k in rng.sample(["name", "ids", "x", "kind"], rng.randrange(4))}


def record(rng):
    if rng.random() < 0.05:
        return value(rng)
    if rng.random() < 0.2:
        return {"name": "ab", "kind": rng.choice(["a", 1, None]), "who": {"ids": [rng.choice([1, "ab", 0.5]) for _ in range(rng.randrange(1, 4))]}, "both": rng.choice([0.5, 1])}
    out = {"name": rng.choice(["ab", "never", "A", 3]), "kind": rng.choice(["a", 1, 1.0, None, True, "b", 2])}
    for k in rng.sample(["name", "kind", "exact", "who", "both", "none", "any", "more"], rng.randrange(7)):
        out[k] = value(rng)
    if rng.random() < 0.4:
        out["who"] = {"name": rng.choice(["ab", "x"]), "ids": [rng.choice([1, -1, "ab", 0.5, 9]) for _ in range(rng.randrange(4))]}
    if rng.random() < 0.3:
        out["exact"] = {"a": [1, rng.choice(["x", "y"])]}
    return out


def test_compiler_equals_a_plain_validator(spark):
    rng = random.Random(21)
    records = [record(rng) for _ in range(400)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, json string")
    for r in df.select("i", schema.errors(F.col("json"), SCHEMA).alias("e")).collect():
        x = records[r.i]
        assert [(e.path, e.message) for e in r.e] == plain(x, SCHEMA), x
    assert sum(not plain(x, SCHEMA) for x in records) > 10


def test_no_json_and_null(spark):
    df = spark.createDataFrame([("{",), (None,), ("",)], "json string")
    assert {tuple(r.e[0]) for r in df.select(schema.errors(F.col("json"), {"type": "object"}).alias("e")).collect()} == {("(root)", "is no JSON")}


@pytest.mark.parametrize(("rule", "why"), [({"$ref": "#"}, "itself"), ({"$defs": {"a": {"items": {"$ref": "#/$defs/b"}}, "b": {"anyOf": [{"$ref": "#/$defs/a"}]}}, "$ref": "#/$defs/a"}, "itself"), ({"$ref": "#/$defs/none"}, "has no"), ({"$ref": "https://example.org/x"}, "within the schema"), ({"$defs": {"a": [1]}, "$ref": "#/$defs/a"}, "no schema")])
def test_references_that_are_refused(spark, rule, why):
    with pytest.raises(ValueError, match=why):
        schema.errors(F.lit("{}"), rule)


def test_a_record_is_parsed_once_and_each_value_typed_once(spark):
    """The expression names the record's parse once, and the type of a value once for each place of the schema, not once for each keyword."""
    rule = {"type": "object", "required": ["a", "b"], "properties": {"a": {"allOf": [{"type": "string"}, {"minLength": 2, "maxLength": 3, "pattern": "^x"}]}, "b": {"type": "array", "items": {"type": "integer", "minimum": 1, "maximum": 2}}}}
    df = spark.createDataFrame([('{"a": "y", "b": [3]}',)], "s string").select(schema.errors(F.col("s"), rule).alias("e"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(") == 1 and plan.count("schema_of_variant(") == 4  # the record, a, b, an item of b
    assert [x.path for x in df.first().e] == ["a", "a", "b.0"]
