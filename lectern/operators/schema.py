"""A JSON Schema compiled to expressions over a record's JSON text.

Keywords: type, enum, const, required, properties, additionalProperties, items, minItems, maxItems, pattern, minLength, maxLength, minimum, maximum,
allOf, anyOf, oneOf, not, and $ref within the schema. References are written out where they stand; one that leads to itself is refused."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types of JSON Schema by how schema_of_variant() begins for them.
TYPES = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "null": ("VOID",)}
ERRORS = "array<struct<path:string,message:string>>"
ROOT = "(root)"


def resolved(schema: dict, reference: str) -> dict | bool:
    """The part of the schema that a reference such as #/$defs/person names."""
    if not reference.startswith("#"):
        raise ValueError(f"only references within the schema are known: {reference}")
    at: object = schema
    for part in filter(None, reference[1:].split("/")):
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            at = at[int(part)] if isinstance(at, list) else at[part]
        except (KeyError, IndexError, TypeError, ValueError):
            raise ValueError(f"the schema has no {reference}") from None
    if not isinstance(at, (dict, bool)):
        raise ValueError(f"{reference} is no schema")
    return at


def shown(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class Compiler:
    def __init__(self, schema: dict):
        self.schema = schema

    def below(self, v: Column, rule: dict | bool, path: Column, open_: tuple[str, ...] = ()) -> Column:
        """The errors of a variant and what is in it; open_: references on the way to the rule."""
        # The array of one element binds the value and its type, so that they are made once and not for each keyword.
        return F.flatten(F.transform(F.array(F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind"))), lambda x: self.bound(x["v"], x["kind"], rule, path, open_)))

    def bound(self, v: Column, kind: Column, rule: dict | bool, path: Column, open_: tuple[str, ...]) -> Column:
        """The errors of a variant whose type is known."""
        if isinstance(rule, bool):
            return self.none() if rule else self.error(F.lit(True), path, "is not allowed")
        return F.concat(self.none(), *(e for keyword, make in self.RULES.items() if keyword in rule for e in make(self, v, kind, rule, path, open_)))

    @staticmethod
    def is_a(kind: Column, *types: str) -> Column:
        return reduce(lambda a, b: a | b, (kind.startswith(begins) for t in types for begins in TYPES[t]))

    @staticmethod
    def none() -> Column:
        return F.array().cast(ERRORS)

    @classmethod
    def error(cls, bad: Column, path: Column, what: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(what).alias("message")))).otherwise(cls.none())

    @staticmethod
    def inside(path: Column, name: Column) -> Column:
        return F.concat(F.when(path == ROOT, F.lit("")).otherwise(F.concat(path, F.lit("."))), name)

    @staticmethod
    def field(v: Column, name: str) -> Column:
        return F.try_variant_get(v, f"$['{name}']", "variant")

    @staticmethod
    def equals(v: Column, kind: Column, value: object) -> Column:
        if value is None:
            return kind == "VOID"
        if isinstance(value, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value)
        if isinstance(value, (int, float)):
            return Compiler.is_a(kind, "number") & (F.try_variant_get(v, "$", "double") == float(value))
        if isinstance(value, str):
            return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == value)
        return F.to_json(v) == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def _type(self, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
        allowed = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
        return [self.error(~self.is_a(kind, *allowed), path, "is not of type " + " or ".join(allowed))]

    def _enum(self, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
        among = reduce(lambda a, x: a | F.coalesce(self.equals(v, kind, x), F.lit(False)), rule["enum"], F.lit(False))
        return [self.error(~among, path, "is none of " + ", ".join(map(shown, rule["enum"])))]

    def _const(self, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
        return [self.error(~F.coalesce(self.equals(v, kind, rule["const"]), F.lit(False)), path, "is not " + shown(rule["const"]))]

    def _string(test: Callable[[Column, object], Column], keyword: str, what: str):  # noqa: N805
        def make(self: Compiler, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
            s = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            return [self.error(test(s, rule[keyword]), path, what.format(rule[keyword]))]

        return make

    def _number(test: Callable[[Column, object], Column], keyword: str, what: str):  # noqa: N805
        def make(self: Compiler, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
            x = F.when(self.is_a(kind, "number"), F.try_variant_get(v, "$", "double"))
            return [self.error(test(x, rule[keyword]), path, what.format(rule[keyword]))]

        return make

    def _count(test: Callable[[Column, object], Column], keyword: str, what: str):  # noqa: N805
        def make(self: Compiler, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
            n = F.when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")))
            return [self.error(test(n, rule[keyword]), path, what.format(rule[keyword]))]

        return make

    def _required(self, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
        return [self.error(kind.startswith("OBJECT") & self.field(v, k).isNull(), path, f"has no {k}") for k in rule["required"]]

    def _properties(self, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
        own = lambda k: F.when(kind.startswith("OBJECT"), self.field(v, k))
        each = lambda k, r: F.flatten(F.transform(F.filter(F.array(own(k)), lambda x: x.isNotNull()), lambda x: self.below(x, r, self.inside(path, F.lit(k)), open_)))
        return [each(k, r) for k, r in rule["properties"].items()]

    def _additional(self, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
        of = rule["additionalProperties"]
        if of is True or of == {}:
            return []
        names = F.array_sort(F.map_keys(F.when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.try_variant_get(v, "$", "map<string,variant>"))))
        more = F.filter(names, lambda k: ~k.isin(*rule.get("properties", {"": {}})))
        if of is False:
            return [F.coalesce(F.transform(more, lambda k: F.struct(path.alias("path"), F.concat(F.lit("has no place for "), k).alias("message"))), self.none())]
        values = F.try_variant_get(v, "$", "map<string,variant>")
        return [F.coalesce(F.flatten(F.transform(more, lambda k: self.below(values[k], of, self.inside(path, k), open_))), self.none())]

    def _items(self, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
        each = F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: self.below(x, rule["items"], self.inside(path, i.cast("string")), open_)))
        return [F.when(F.coalesce(kind.startswith("ARRAY"), F.lit(False)), each).otherwise(self.none())]

    def _all(self, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
        return [self.bound(v, kind, r, path, open_) for r in rule["allOf"]]

    def _met(self, v: Column, kind: Column, rules: list, path: Column, open_: tuple) -> Column:
        """How many of the rules hold."""
        return reduce(lambda a, r: a + (F.size(self.bound(v, kind, r, path, open_)) == 0).cast("int"), rules, F.lit(0))

    def _any(self, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
        return [self.error(self._met(v, kind, rule["anyOf"], path, open_) == 0, path, "meets none of the alternatives")]

    def _one(self, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
        n = self._met(v, kind, rule["oneOf"], path, open_)
        return [self.error(n == 0, path, "meets none of the alternatives"), self.error(n > 1, path, "meets several alternatives")]

    def _not(self, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
        return [self.error(self._met(v, kind, [rule["not"]], path, open_) == 1, path, "is what it must not be")]

    def _ref(self, v: Column, kind: Column, rule: dict, path: Column, open_: tuple) -> list[Column]:
        reference = rule["$ref"]
        if reference in open_:
            raise ValueError("the schema refers to itself: " + " -> ".join((*open_, reference)))
        return [self.bound(v, kind, resolved(self.schema, reference), path, (*open_, reference))]

    RULES = {  # in the order of their errors
        "$ref": _ref, "type": _type, "enum": _enum, "const": _const,
        "pattern": _string(lambda s, p: ~s.rlike(p), "pattern", "does not match {}"), "minLength": _string(lambda s, n: F.length(s) < n, "minLength", "is shorter than {}"),
        "maxLength": _string(lambda s, n: F.length(s) > n, "maxLength", "is longer than {}"),
        "minimum": _number(lambda x, n: x < float(n), "minimum", "is less than {}"), "maximum": _number(lambda x, n: x > float(n), "maximum", "is more than {}"),
        "required": _required, "properties": _properties, "additionalProperties": _additional,
        "minItems": _count(lambda n, k: n < k, "minItems", "has fewer than {} items"), "maxItems": _count(lambda n, k: n > k, "maxItems", "has more than {} items"),
        "items": _items, "allOf": _all, "anyOf": _any, "oneOf": _one, "not": _not,
    }


def errors(record: Column, schema: dict) -> Column:
    """array<struct<path, message>>: where a record's JSON text does not meet the schema, fields in the schema's order. A text that is no JSON, and a null, are one error at the root."""
    no_json = F.array(F.struct(F.lit(ROOT).alias("path"), F.lit("is no JSON").alias("message")))
    return F.transform(F.array(F.try_parse_json(record)), lambda v: F.when(v.isNull(), no_json).otherwise(Compiler(schema).below(v, schema, F.lit(ROOT))))[0]
