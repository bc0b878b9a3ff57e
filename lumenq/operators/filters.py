"""Metadata filters: a JSON filter becomes a boolean column over schemaless metadata.

Comparisons are typed: numbers compare with numbers, strings with strings, and across kinds nothing
is equal, smaller or larger. No row fails and no row is null: a missing path is false under every
operator but $ne, $nin, $not and $exists.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenq.functions.metrics import haversine_m

NUMBER = ("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT", "TIMESTAMP")
ORDER = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


class Metadata:
    """Access to one metadata column of type variant."""

    def __init__(self, column: Column):
        self.column = column

    def path(self, dotted: str) -> str:
        return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in dotted.split("."))

    def kind(self, dotted: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(self.column, self.path(dotted), "variant"))

    def get(self, dotted: str, kind: str) -> Column:
        return F.try_variant_get(self.column, self.path(dotted), kind)

    def is_number(self, dotted: str) -> Column:
        k = self.kind(dotted)
        return k.isin(*NUMBER) | k.startswith("DECIMAL")


def parse_metadata(text: Column) -> Column:
    """A variant from JSON text; null for null or malformed text."""
    return F.try_parse_json(text)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _equals(m: Metadata, path: str, value: object) -> Column:
    if value is None:
        return _sure(m.kind(path) == "VOID")
    if isinstance(value, bool):
        return _sure((m.kind(path) == "BOOLEAN") & (m.get(path, "boolean") == value))
    if isinstance(value, (int, float)):
        return _sure(m.is_number(path) & (m.get(path, "double") == float(value)))
    if isinstance(value, str):
        return _sure((m.kind(path) == "STRING") & (m.get(path, "string") == value))
    return _sure(F.to_json(m.get(path, "variant")) == F.to_json(F.parse_json(F.lit(json.dumps(value)))))


def _order(m: Metadata, path: str, op: str, value: object) -> Column:
    if isinstance(value, bool) or value is None or isinstance(value, (list, dict)):
        return F.lit(False)
    if isinstance(value, str):
        return _sure((m.kind(path) == "STRING") & ORDER[op](m.get(path, "string"), F.lit(value)))
    x = m.get(path, "double")
    return _sure(m.is_number(path) & ~F.isnan(x) & ORDER[op](x, F.lit(float(value))))


def _contains(m: Metadata, path: str, value: object) -> Column:
    items = m.get(path, "array<variant>")
    return _sure(m.kind(path).startswith("ARRAY") & F.exists(items, lambda v: _equals_item(v, value)))


def _equals_item(v: Column, value: object) -> Column:
    kind = F.schema_of_variant(v)
    if value is None:
        return _sure(kind == "VOID")
    if isinstance(value, bool):
        return _sure((kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value))
    if isinstance(value, (int, float)):
        return _sure((kind.isin(*NUMBER) | kind.startswith("DECIMAL")) & (F.try_variant_get(v, "$", "double") == float(value)))
    if isinstance(value, str):
        return _sure((kind == "STRING") & (F.try_variant_get(v, "$", "string") == value))
    return _sure(F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value)))))


def _geo(m: Metadata, path: str, spec: object) -> Column:
    if not isinstance(spec, dict) or not {"lat", "lon", "radius"} <= set(spec) or not all(isinstance(spec[k], (int, float)) and not isinstance(spec[k], bool) for k in ("lat", "lon", "radius")):
        raise ValueError("$geoRadius needs numbers lat, lon and radius")
    point = m.get(path, "array<double>")
    plain = m.kind(path).rlike(r"^ARRAY<(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))>$")
    d = haversine_m(F.lit(float(spec["lat"])), F.lit(float(spec["lon"])), F.get(point, F.lit(0)), F.get(point, F.lit(1)))
    return _sure(plain & (F.size(point) == 2) & (d <= float(spec["radius"])))


def check_pattern(value: str) -> None:
    """Patterns are those of automata: no look-around and no back-references; the JVM must know the rest."""
    plain = re.sub(r"\\Q.*?(\\E|$)", "", value, flags=re.S)
    escaped = re.findall(r"\\(.)", plain, re.S)
    bare = re.sub(r"\\.", "", plain, flags=re.S)
    if any(c.isdigit() and c != "0" or c == "k" for c in escaped) or re.search(r"\(\?(?:[=!>]|<[=!])", bare):
        raise ValueError("$regex has no look-around and no back-references")
    sc = SparkContext._active_spark_context
    try:
        sc._jvm.java.util.regex.Pattern.compile(value)
    except Exception as e:  # the JVM's PatternSyntaxException
        raise ValueError(f"bad $regex: {value}") from e


def _one(m: Metadata, path: str, op: str, value: object) -> Column:
    if op == "$eq":
        return _equals(m, path, value)
    if op == "$ne":
        return ~_equals(m, path, value)
    if op in ORDER:
        return _order(m, path, op, value)
    if op in ("$in", "$nin"):
        values = value if isinstance(value, list) else [value]
        hit = reduce(lambda a, b: a | b, [_equals(m, path, v) for v in values], F.lit(False))
        return hit if op == "$in" else ~hit
    if op == "$contains":
        return _contains(m, path, value)
    if op == "$regex":
        if not isinstance(value, str):
            raise ValueError("$regex needs a pattern")
        check_pattern(value)
        return _sure((m.kind(path) == "STRING") & m.get(path, "string").rlike(value))
    if op == "$exists":
        there = m.get(path, "variant").isNotNull()
        return there if value else ~there
    if op == "$geoRadius":
        return _geo(m, path, value)
    raise ValueError(f"unknown operator: {op}")


def compile_filter(spec: dict | str | None, metadata: Column) -> Column:
    """A boolean column, never null, of a filter in JSON form over a variant column."""
    if spec is None:
        return F.lit(True)
    if isinstance(spec, str):
        spec = json.loads(spec)
    if not isinstance(spec, dict):
        raise ValueError("a filter must be an object")
    m = Metadata(metadata)
    parts: list[Column] = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list):
                raise ValueError(f"{key} needs a list")
            terms = [compile_filter(v, metadata) for v in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), terms, F.lit(key == "$and")))
        elif key == "$not":
            if not isinstance(value, dict):
                raise ValueError("$not needs an object")
            parts.append(~compile_filter(value, metadata))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator: {key}")
        elif isinstance(value, dict):
            if not value:
                raise ValueError(f"no operator for {key}")
            parts += [_one(m, key, op, v) for op, v in value.items()]
        else:
            parts.append(_equals(m, key, value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
