"""Distances between dense vectors: as Spark columns, and as numpy kernels over blocks of rows.

Every distance is smaller-is-better and computed in double precision. `strict` decides what a pair
for which a metric isn't defined gives: an error (the default) or null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The single-precision machine epsilon, the mean radius of the earth in metres, and
# the metrics' names with their aliases.
EPS = 1.1920929e-7
EARTH_RADIUS_M = 6_371_008.8
ALIASES = {
    "l2": "euclidean",
    "sqeuclidean": "squared-euclidean",
    "l2-squared": "squared-euclidean",
    "ip": "inner-product",
    "dot": "inner-product",
    "dot-product": "inner-product",
    "angle": "angular",
    "l1": "manhattan",
    "linf": "chebyshev",
    "matching": "simple-matching",
    "smc": "simple-matching",
    "chi2": "chi-square",
    "kl": "kullback-leibler",
    "js": "jensen-shannon",
    "emd": "wasserstein",
    "dtw": "dynamic-time-warping",
    "weighted-jaccard": "ruzicka",
}


def _zero() -> Column:
    return F.lit(0.0)


def _total(values: Column) -> Column:
    return F.aggregate(values, _zero(), lambda s, v: s + v)


def zip_sum(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """The sum of f over the pairs of coordinates."""
    return _total(F.zip_with(a, b, f))


def _fail(strict: bool, why: str) -> Column:
    return F.raise_error(F.lit(why)).cast("double") if strict else F.lit(None).cast("double")


def _dot(a: Column, b: Column) -> Column:
    return zip_sum(a, b, lambda x, y: x * y)


def _norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def _cos(a: Column, b: Column, degenerate: float, f: Callable[[Column], Column]) -> Column:
    na, nb = _norm(a), _norm(b)
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / (na * nb)))
    return F.when((na <= EPS) | (nb <= EPS), degenerate).otherwise(f(c))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den <= EPS, 0.0).otherwise(num / den)


def _correlation(a: Column, b: Column, strict: bool) -> Column:
    def centred(v: Column) -> Column:
        m = _total(v) / F.size(v)
        return F.transform(v, lambda x: x - m)

    ca, cb = centred(a), centred(b)
    sa, sb = _dot(ca, ca), _dot(cb, cb)
    return F.when((sa <= EPS) | (sb <= EPS), _fail(strict, "correlation needs vectors that vary")).otherwise(1 - _dot(ca, cb) / F.sqrt(sa * sb))


def _counts(a: Column, b: Column) -> dict[str, Column]:
    has = lambda x: F.abs(x) > EPS
    n11 = zip_sum(a, b, lambda x, y: F.when(has(x) & has(y), 1.0).otherwise(0.0))
    n00 = zip_sum(a, b, lambda x, y: F.when(~has(x) & ~has(y), 1.0).otherwise(0.0))
    n10 = zip_sum(a, b, lambda x, y: F.when(has(x) & ~has(y), 1.0).otherwise(0.0))
    n = F.size(a).cast("double")
    return {"n11": n11, "n00": n00, "n10": n10, "n01": n - n11 - n00 - n10, "n": n, "m": n - n11 - n00}


def _or_zero(num: Column, den: Column) -> Column:
    return F.when(den == 0, 0.0).otherwise(num / den)


def _non_negative(a: Column, b: Column, strict: bool, value: Column) -> Column:
    bad = F.exists(a, lambda x: x < 0) | F.exists(b, lambda x: x < 0)
    return F.when(bad, _fail(strict, "the metric needs non-negative vectors")).otherwise(value)


def _distributions(a: Column, b: Column, strict: bool, f: Callable[[Column, Column], Column]) -> Column:
    def share(v: Column) -> Column:
        s = _total(v)
        return F.transform(v, lambda x: x / s)

    empty = (_total(a) <= EPS) | (_total(b) <= EPS)
    value = F.when(empty, _fail(strict, "the metric needs vectors with a positive sum")).otherwise(f(share(a), share(b)))
    return _non_negative(a, b, strict, value)


def _kl(p: Column, q: Column, strict: bool) -> Column:
    off = F.exists(F.zip_with(p, q, lambda x, y: (x > EPS) & (y <= EPS)), lambda z: z)
    value = zip_sum(p, q, lambda x, y: F.when(x > EPS, x * F.log(x / y)).otherwise(0.0))
    return F.when(off, _fail(strict, "the divergence is infinite")).otherwise(value)


def _half_kl(p: Column, m: Column) -> Column:
    return zip_sum(p, m, lambda x, y: F.when(x > EPS, x * F.log(x / y)).otherwise(0.0)) / 2


def _jensen_shannon(p: Column, q: Column) -> Column:
    mid = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return F.sqrt(F.greatest(_zero(), _half_kl(p, mid) + _half_kl(q, mid)))


def _bhattacharyya(p: Column, q: Column, strict: bool) -> Column:
    c = zip_sum(p, q, lambda x, y: F.sqrt(x * y))
    return F.when(c <= EPS, _fail(strict, "the distributions don't overlap")).otherwise(-F.log(F.least(F.lit(1.0), c)))


def _wasserstein(p: Column, q: Column) -> Column:
    step = F.zip_with(p, q, lambda x, y: x - y)
    start = F.struct(_zero().alias("run"), _zero().alias("sum"))
    return F.aggregate(
        step,
        start,
        lambda s, d: F.struct((s["run"] + d).alias("run"), (s["sum"] + F.abs(s["run"] + d)).alias("sum")),
        lambda s: s["sum"],
    )


def _dtw_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dynamic time warping with absolute cost and no window, of every row of a with the same row of b:
    by anti-diagonals, so a step serves all rows at once."""
    n, wide, high = len(a), a.shape[1], b.shape[1]
    one, two = (np.full((n, wide + 1), np.inf) for _ in range(2))  # the last diagonal and the one before, by a's place + 1
    two[:, 0] = 0
    for s in range(wide + high - 1):
        lo, hi = max(0, s - high + 1), min(wide, s + 1)
        cur = np.full((n, wide + 1), np.inf)
        cost = np.abs(a[:, lo:hi] - b[:, s - np.arange(lo, hi)])
        cur[:, lo + 1 : hi + 1] = cost + np.minimum(np.minimum(one[:, lo:hi], one[:, lo + 1 : hi + 1]), two[:, lo:hi])
        one, two = cur, one
    return one[:, wide]


def _dtw(a: Column, b: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(x, y):  # noqa: ANN001, ANN202
        import pandas as pd

        sizes: dict[tuple[int, int], list[int]] = {}
        for i, (p, q) in enumerate(zip(x, y)):
            if p is not None and q is not None and len(p) and len(q):
                sizes.setdefault((len(p), len(q)), []).append(i)
        out = np.full(len(x), np.nan)
        for at in sizes.values():
            out[at] = _dtw_rows(*(np.array([v.iloc[i] for i in at], float) for v in (x, y)))
        return pd.Series([None if np.isnan(v) else float(v) for v in out], dtype=object)

    return run(a, b)


_COLUMNS: dict[str, Callable[[Column, Column, bool], Column]] = {
    "euclidean": lambda a, b, s: F.sqrt(zip_sum(a, b, lambda x, y: (x - y) * (x - y))),
    "squared-euclidean": lambda a, b, s: zip_sum(a, b, lambda x, y: (x - y) * (x - y)),
    "cosine": lambda a, b, s: _cos(a, b, 2.0, lambda c: 1 - c),
    "inner-product": lambda a, b, s: -_dot(a, b),
    "angular": lambda a, b, s: _cos(a, b, 1.0, lambda c: F.acos(c) / math.pi),
    "manhattan": lambda a, b, s: zip_sum(a, b, lambda x, y: F.abs(x - y)),
    "gower": lambda a, b, s: F.when(F.size(a) == 0, 0.0).otherwise(zip_sum(a, b, lambda x, y: F.abs(x - y)) / F.size(a)),
    "chebyshev": lambda a, b, s: F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), _zero()),
    "canberra": lambda a, b, s: zip_sum(a, b, lambda x, y: _ratio(F.abs(x - y), F.abs(x) + F.abs(y))),
    "bray-curtis": lambda a, b, s: F.when(
        zip_sum(a, b, lambda x, y: F.abs(x + y)) <= EPS, _fail(s, "bray-curtis of vectors that cancel")
    ).otherwise(zip_sum(a, b, lambda x, y: F.abs(x - y)) / zip_sum(a, b, lambda x, y: F.abs(x + y))),
    "correlation": _correlation,
    "hamming": lambda a, b, s: zip_sum(a, b, lambda x, y: F.when(F.abs(x - y) > EPS, 1.0).otherwise(0.0)),
    "jaccard": lambda a, b, s: (lambda c: F.when(c["n"] - c["n00"] == 0, 0.0).otherwise(1 - c["n11"] / (c["n"] - c["n00"])))(_counts(a, b)),
    "dice": lambda a, b, s: (lambda c: F.when(c["n"] - c["n00"] == 0, 0.0).otherwise(1 - 2 * c["n11"] / (2 * c["n11"] + c["m"])))(_counts(a, b)),
    "simple-matching": lambda a, b, s: (lambda c: _or_zero(c["m"], c["n"]))(_counts(a, b)),
    "russell-rao": lambda a, b, s: (lambda c: _or_zero(c["n"] - c["n11"], c["n"]))(_counts(a, b)),
    "rogers-tanimoto": lambda a, b, s: (lambda c: _or_zero(2 * c["m"], c["n11"] + c["n00"] + 2 * c["m"]))(_counts(a, b)),
    "sokal-sneath": lambda a, b, s: (lambda c: _or_zero(2 * c["m"], c["n11"] + 2 * c["m"]))(_counts(a, b)),
    "yule": lambda a, b, s: (lambda c: _or_zero(2 * c["n10"] * c["n01"], c["n11"] * c["n00"] + c["n10"] * c["n01"]))(_counts(a, b)),
    "hellinger": lambda a, b, s: _distributions(
        a, b, s, lambda p, q: F.sqrt(1 - F.greatest(_zero(), F.least(F.lit(1.0), zip_sum(p, q, lambda x, y: F.sqrt(x * y)))))
    ),
    "chi-square": lambda a, b, s: _non_negative(a, b, s, zip_sum(a, b, lambda x, y: _ratio((x - y) * (x - y), x + y))),
    "kullback-leibler": lambda a, b, s: _distributions(a, b, s, lambda p, q: _kl(p, q, s)),
    "jeffreys": lambda a, b, s: _distributions(a, b, s, lambda p, q: _kl(p, q, s) + _kl(q, p, s)),
    "jensen-shannon": lambda a, b, s: _distributions(a, b, s, _jensen_shannon),
    "bhattacharyya": lambda a, b, s: _distributions(a, b, s, lambda p, q: _bhattacharyya(p, q, s)),
    "wasserstein": lambda a, b, s: _distributions(a, b, s, _wasserstein),
    "dynamic-time-warping": lambda a, b, s: _dtw(a, b),
    "ruzicka": lambda a, b, s: _non_negative(a, b, s, (lambda top: F.when(top <= EPS, 0.0).otherwise(1 - zip_sum(a, b, lambda x, y: F.least(x, y)) / top))(zip_sum(a, b, lambda x, y: F.greatest(x, y)))),
    "squared-chord": lambda a, b, s: _non_negative(a, b, s, zip_sum(a, b, lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y)))),
    "wave-hedges": lambda a, b, s: _non_negative(a, b, s, zip_sum(a, b, lambda x, y: _ratio(F.abs(x - y), F.greatest(x, y)))),
    "lorentzian": lambda a, b, s: zip_sum(a, b, lambda x, y: F.log1p(F.abs(x - y))),
    "clark": lambda a, b, s: F.sqrt(zip_sum(a, b, lambda x, y: F.pow(_ratio(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(2)))),
}
NAMES = tuple(_COLUMNS)
CENTROID_BOUNDED = frozenset({"euclidean", "cosine", "angular", "manhattan", "gower", "chebyshev"})  # minkowski too
UNIT_GEOMETRY = frozenset({"cosine", "angular"})


def parse(name: str) -> tuple[str, float | None]:
    """The plain name of a metric and Minkowski's p; ValueError for unknown ones."""
    key = name.strip().lower().replace("_", "-")
    head, _, tail = key.partition(":")
    if head in ("minkowski", "lp") and tail:
        try:
            p = float(tail)
        except ValueError:
            p = math.nan
        if not (math.isfinite(p) and p >= 1):
            raise ValueError(f"minkowski needs a finite p of 1 or more: {name}")
        return "minkowski", p
    key = ALIASES.get(key, key)
    if key not in _COLUMNS:
        raise ValueError(f"unknown metric: {name}")
    return key, None


def distance(name: str, a: Column, b: Column, *, strict: bool = True) -> Column:
    """The distance of two array columns as a double. Null arrays give null. Vectors of different
    lengths, with null or non-finite coordinates, are an error when strict, else null."""
    key, p = parse(name)
    a, b = a.cast("array<double>"), b.cast("array<double>")
    if p is not None:
        value = F.pow(zip_sum(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1 / p))
    else:
        value = _COLUMNS[key](a, b, strict)
    odd = lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bad = (F.size(a) != F.size(b)) | odd(a) | odd(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(bad, _fail(strict, "vectors must be finite and equally long")).otherwise(value)


def supports_centroid_bound(name: str) -> bool:
    key, p = parse(name)
    return p is not None or key in CENTROID_BOUNDED


def block(name: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of every row of q (as the first argument) to every row of x; NaN where undefined."""
    key, p = parse(name)
    q, x = np.asarray(q, np.float64), np.asarray(x, np.float64)
    if key in ("cosine", "angular"):
        nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        with np.errstate(all="ignore"):
            c = np.clip((q @ x.T) / (nq[:, None] * nx[None, :]), -1, 1)
        d = 1 - c if key == "cosine" else np.arccos(c) / math.pi
        return np.where((nq <= EPS)[:, None] | (nx <= EPS)[None, :], 2.0 if key == "cosine" else 1.0, d)
    if key == "inner-product":
        return -(q @ x.T)
    return np.stack([_rows(key, p, v, x) for v in q]) if len(q) else np.zeros((0, len(x)))


def _rows(key: str, p: float | None, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of a to the rows of x."""
    d = np.abs(a - x)
    n = x.shape[1]
    with np.errstate(all="ignore"):
        if key == "euclidean":
            return np.sqrt((d * d).sum(1))
        if key == "squared-euclidean":
            return (d * d).sum(1)
        if key == "manhattan":
            return d.sum(1)
        if key == "gower":
            return d.mean(1) if n else np.zeros(len(x))
        if key == "chebyshev":
            return d.max(1) if n else np.zeros(len(x))
        if key == "minkowski":
            return (d**p).sum(1) ** (1 / p)
        if key in ("canberra", "clark"):
            den = np.abs(a) + np.abs(x)
            r = np.where(den <= EPS, 0, d / den)
            return r.sum(1) if key == "canberra" else np.sqrt((r * r).sum(1))
        if key == "bray-curtis":
            den = np.abs(a + x).sum(1)
            return np.where(den <= EPS, np.nan, d.sum(1) / den)
        if key == "correlation":
            ca, cx = a - a.mean(), x - x.mean(1, keepdims=True)
            sa, sx = (ca * ca).sum(), (cx * cx).sum(1)
            return np.where((sa <= EPS) | (sx <= EPS), np.nan, 1 - cx @ ca / np.sqrt(sa * sx))
        if key == "hamming":
            return (d > EPS).sum(1).astype(float)
        if key == "lorentzian":
            return np.log1p(d).sum(1)
        if key == "dynamic-time-warping":
            return _dtw_rows(np.tile(a, (len(x), 1)), x)
        if key in ("jaccard", "dice", "simple-matching", "russell-rao", "rogers-tanimoto", "sokal-sneath", "yule"):
            ha, hx = np.abs(a) > EPS, np.abs(x) > EPS
            n11, n00 = (ha & hx).sum(1), (~ha & ~hx).sum(1)
            n10 = (ha & ~hx).sum(1)
            n01 = n - n11 - n00 - n10
            m = n10 + n01
            num, den = {
                "jaccard": (m, n - n00),
                "dice": (m, 2 * n11 + m),
                "simple-matching": (m, np.full(len(x), n)),
                "russell-rao": (n - n11, np.full(len(x), n)),
                "rogers-tanimoto": (2 * m, n11 + n00 + 2 * m),
                "sokal-sneath": (2 * m, n11 + 2 * m),
                "yule": (2 * n10 * n01, n11 * n00 + n10 * n01),
            }[key]
            return np.where(den == 0, 0.0, num / den)
        bad = (a < 0).any() | (x < 0).any(1)
        if key == "chi-square":
            v = np.where(a + x <= EPS, 0, d * d / (a + x)).sum(1)
        elif key == "ruzicka":
            top = np.maximum(a, x).sum(1)
            v = np.where(top <= EPS, 0, 1 - np.minimum(a, x).sum(1) / top)
        elif key == "squared-chord":
            v = ((np.sqrt(a) - np.sqrt(x)) ** 2).sum(1)
        elif key == "wave-hedges":
            top = np.maximum(a, x)
            v = np.where(top <= EPS, 0, d / top).sum(1)
        else:
            sa, sx = a.sum(), x.sum(1)
            bad = bad | (sa <= EPS) | (sx <= EPS)
            pa, px = a / sa, x / sx[:, None]
            kl = lambda s, t: np.where(s > EPS, s * np.log(s / t), 0).sum(1)
            off = ((pa > EPS) & (px <= EPS)).any(1)
            back = ((px > EPS) & (pa <= EPS)).any(1)
            if key == "hellinger":
                v = np.sqrt(1 - np.clip(np.sqrt(pa * px).sum(1), 0, 1))
            elif key == "bhattacharyya":
                c = np.sqrt(pa * px).sum(1)
                v = np.where(c <= EPS, np.nan, -np.log(np.minimum(c, 1)))
            elif key == "kullback-leibler":
                v = np.where(off, np.nan, kl(np.broadcast_to(pa, px.shape), px))
            elif key == "jeffreys":
                v = np.where(off | back, np.nan, kl(np.broadcast_to(pa, px.shape), px) + kl(px, np.broadcast_to(pa, px.shape)))
            elif key == "jensen-shannon":
                mid = (pa + px) / 2
                v = np.sqrt(np.maximum(0, (kl(np.broadcast_to(pa, px.shape), mid) + kl(px, mid)) / 2))
            else:  # wasserstein
                v = np.abs(np.cumsum(pa - px, axis=1)).sum(1)
        return np.where(bad, np.nan, v)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres of points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def unit(a: Column) -> Column:
    """a over its Euclidean norm; the zero vector when that is nearly zero."""
    n = _norm(a.cast("array<double>"))
    return F.transform(a.cast("array<double>"), lambda x: F.when(n <= EPS, 0.0).otherwise(x / n))
