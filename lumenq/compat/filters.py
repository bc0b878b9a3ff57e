"""Other services' filters and metric names in this engine's terms.

A foreign filter becomes a function of (metadata variant column, id column) that gives a boolean
column, which Index.records takes like a filter of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from fnmatch import translate
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenq.operators.filters import Metadata, compile_filter

# The services' names of metrics.
METRICS = {
    "pinecone": {"cosine": "cosine", "euclidean": "euclidean", "dotproduct": "inner-product"},
    "turbopuffer": {"cosine_distance": "cosine", "euclidean_squared": "squared-euclidean"},
    "s3vectors": {"cosine": "cosine", "euclidean": "euclidean"},
    "chroma": {"l2": "euclidean", "cosine": "cosine", "ip": "inner-product"},
    "qdrant": {"Cosine": "cosine", "Euclid": "euclidean", "Dot": "inner-product"},
}

Test = Callable[[Column, Column], Column]


def metric(service: str, name: str) -> str:
    known = METRICS[service]
    if name not in known:
        raise ValueError(f"{service} has no metric {name!r}; it has {', '.join(sorted(known))}")
    return known[name]


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(or_, parts, F.lit(False))


def _own(path: str, op: str, value: object) -> Callable[[Column], Column]:
    """A condition in this engine's own language."""
    return lambda m: compile_filter({path: {op: value}}, m)


def _holds(path: str, value: object) -> Callable[[Column], Column]:
    """Equal to the value, or an array with it."""
    return lambda m: compile_filter({"$or": [{path: {"$eq": value}}, {path: {"$contains": value}}]}, m)


def _text(path: str, pattern: str, flags: str = "") -> Callable[[Column], Column]:
    return lambda m: F.coalesce((Metadata(m).kind(path) == "STRING") & Metadata(m).get(path, "string").rlike(flags + pattern), F.lit(False))


# Attribute filters written as lists: [attribute, operator, value], ["And" or "Or", [...]], ["Not", ...]

LIST_OPERATORS: dict[str, Callable[[str, object], Callable[[Column], Column]]] = {
    "Eq": lambda a, v: _own(a, "$eq", v),
    "Lt": lambda a, v: _own(a, "$lt", v),
    "Lte": lambda a, v: _own(a, "$lte", v),
    "Gt": lambda a, v: _own(a, "$gt", v),
    "Gte": lambda a, v: _own(a, "$gte", v),
    "In": lambda a, v: _own(a, "$in", v),
    "Contains": lambda a, v: _own(a, "$contains", v),
    "ContainsAny": lambda a, v: lambda m: _any([_own(a, "$contains", x)(m) for x in v]),
    "Glob": lambda a, v: _text(a, translate(str(v)).replace(r"\Z", r"\z")),
    "IGlob": lambda a, v: _text(a, translate(str(v)).replace(r"\Z", r"\z"), "(?i)"),
    "Regex": lambda a, v: _own(a, "$regex", v),
}


def list_filter(f: object) -> Test | None:
    """The filter of a list or tuple; None is no filter. A word Not before an operator's name negates
    it (NotEq, NotIn, NotGlob)."""
    if f is None:
        return None
    if not isinstance(f, (list, tuple)) or not f:
        raise ValueError(f"not a filter: {f!r}")
    head = f[0]
    if len(f) == 2 and head in ("And", "Or"):
        parts, join = [list_filter(x) for x in f[1]], _all if head == "And" else _any
        return lambda m, i: join([p(m, i) for p in parts])
    if len(f) == 2 and head == "Not":
        inner = list_filter(f[1])
        return lambda m, i: ~inner(m, i)
    if len(f) == 3 and isinstance(f[1], str):
        word = f[1]
        bare = word.removeprefix("Not")
        if bare in LIST_OPERATORS:
            test = LIST_OPERATORS[bare](str(head), f[2])
            return (lambda m, i: test(m)) if bare == word else (lambda m, i: ~test(m))
    raise ValueError(f"not a filter: {f!r}")


# Condition trees: clauses must, should, must_not and min_should over conditions on the payload or the id


def plain(x: object) -> object:
    """Objects with attributes as dictionaries, without what is None."""
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items() if v is not None}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    if hasattr(x, "__dict__"):
        return plain(vars(x))
    return x


def _listed(x: object) -> list:
    return x if isinstance(x, list) else [x]


def _match(path: str, how: dict) -> Callable[[Column], Column]:
    kinds = {
        "value": lambda v: _holds(path, v),
        "any": lambda v: lambda m: _any([_holds(path, x)(m) for x in v]),
        "except": lambda v: lambda m: compile_filter({path: {"$exists": True}}, m) & ~_any([_holds(path, x)(m) for x in v]),
        "text": lambda v: lambda m: _all([_text(path, r"(?U)(?<!\w)\Q" + w.lower() + r"\E(?!\w)", "(?i)")(m) for w in str(v).split()]),
    }
    tests = [kinds[k](v) for k, v in how.items() if k in kinds]
    if not tests:
        raise ValueError(f"not a match: {how!r}")
    return lambda m: _all([t(m) for t in tests])


def _limits(path: str, how: dict) -> Callable[[Column], Column]:
    return lambda m: _all([compile_filter({path: {f"${k}": v}}, m) for k, v in how.items()])


def _amount(path: str, how: dict) -> Callable[[Column], Column]:
    compare = {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}

    def test(m: Column) -> Column:
        d = Metadata(m)
        there = d.get(path, "variant").isNotNull() & (d.kind(path) != "VOID")
        n = F.when(F.coalesce(d.kind(path).startswith("ARRAY"), F.lit(False)), F.size(d.get(path, "array<variant>"))).when(F.coalesce(there, F.lit(False)), 1).otherwise(0)
        return _all([compare[k](n, v) for k, v in how.items()])

    return test


def _circle(path: str, how: dict) -> Callable[[Column], Column]:
    return _own(path, "$geoRadius", {"lat": how["center"]["lat"], "lon": how["center"]["lon"], "radius": how["radius"]})


FIELD = {"match": _match, "range": _limits, "values_count": _amount, "geo_radius": _circle}
CLAUSES = {"must", "should", "must_not", "min_should"}


def _missing(path: str, empty: bool) -> Callable[[Column], Column]:
    def test(m: Column) -> Column:
        d = Metadata(m)
        null = F.coalesce(d.kind(path) == "VOID", F.lit(False))
        if not empty:
            return null
        none = F.coalesce(F.size(d.get(path, "array<variant>")) == 0, F.lit(False))
        return null | none | d.get(path, "variant").isNull()

    return test


def _condition(c: dict) -> Test:
    if not isinstance(c, dict):
        raise ValueError(f"not a condition: {c!r}")
    if CLAUSES & set(c):
        return _tree(c)
    if "has_id" in c:
        ids = [str(x) for x in _listed(c["has_id"])]
        return lambda m, i: i.isin(ids)
    for name in ("is_null", "is_empty"):
        if name in c:
            gone = _missing(c[name]["key"], name == "is_empty")
            return lambda m, i: gone(m)
    if "nested" in c:
        inner, path = _tree(c["nested"]["filter"]), c["nested"]["key"]
        return lambda m, i: F.coalesce(F.exists(Metadata(m).get(path, "array<variant>"), lambda v: inner(v, i)), F.lit(False))
    tests = [FIELD[k](str(c["key"]), v) for k, v in c.items() if k in FIELD] if "key" in c else []
    if not tests:
        raise ValueError(f"not a condition: {c!r}")
    return lambda m, i: _all([t(m) for t in tests])


def _tree(f: dict) -> Test:
    clause = {k: [_condition(c) for c in _listed(f[k]["conditions"] if k == "min_should" else f[k])] for k in CLAUSES & set(f)}
    least = f["min_should"]["min_count"] if "min_should" in f else 0

    def test(m: Column, i: Column) -> Column:
        on = {k: [t(m, i) for t in tests] for k, tests in clause.items()}
        parts = on.get("must", []) + [~t for t in on.get("must_not", [])]
        if on.get("should"):
            parts.append(_any(on["should"]))
        if "min_should" in on:
            parts.append(reduce(lambda a, b: a + b, [t.cast("int") for t in on["min_should"]], F.lit(0)) >= least)
        return _all(parts)

    return test


def condition_filter(f: object) -> Test | dict | None:
    """The filter of a tree of conditions (dictionaries or objects). None is no filter; a dictionary
    without clauses is taken as a filter of this engine."""
    tree = plain(f)
    if tree is None:
        return None
    if not isinstance(tree, dict):
        raise ValueError(f"not a filter: {f!r}")
    return _tree(tree) if CLAUSES & set(tree) else tree or None
