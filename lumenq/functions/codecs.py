"""Element types of vectors: rounding a value once to what a type can hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Exponent bits, mantissa bits, exponent bias and largest finite value of the 8-bit floats.
FP8 = {"float8-e4m3fn": (4, 3, 7, 448.0), "float8-e5m2": (5, 2, 15, 57344.0)}
ELEMENT_BYTES = {"float32": 4, "float16": 2, "bfloat16": 2, "float8-e4m3fn": 1, "float8-e5m2": 1, "int8": 1, "binary": 1}
ALIASES = {"f32": "float32", "f16": "float16", "half": "float16", "bf16": "bfloat16", "fp8": "float8-e4m3fn", "e4m3": "float8-e4m3fn", "e4m3fn": "float8-e4m3fn", "e5m2": "float8-e5m2", "i8": "int8", "bool": "binary", "bit": "binary"}


def element_type(name: str) -> str:
    key = name.strip().lower().replace("_", "-")
    key = ALIASES.get(key, key)
    if key not in ELEMENT_BYTES:
        raise ValueError(f"unknown element type: {name}")
    return key


def _all_fp8(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The finite non-negative values of an 8-bit float and their codes, in order."""
    ebits, mbits, bias, most = FP8[kind]
    code = np.arange(128)
    e, m = code >> mbits, code & ((1 << mbits) - 1)
    v = np.where(e == 0, m * 2.0 ** (1 - bias - mbits), (1 + m / (1 << mbits)) * 2.0 ** (e - bias))
    keep = v <= most
    return v[keep], code[keep]


def fp8_encode(x: np.ndarray, kind: str) -> np.ndarray:
    """The byte of each value: nearest, ties to even, beyond the range the largest finite value."""
    v, code = _all_fp8(kind)
    a = np.abs(np.asarray(x, np.float64))
    hi = np.clip(np.searchsorted(v, a), 1, len(v) - 1)
    lo = hi - 1
    up, down = v[hi] - a, a - v[lo]
    pick = np.where((up < down) | ((up == down) & (code[hi] % 2 == 0)), hi, lo)
    return (code[pick] | np.where(np.signbit(x), 128, 0)).astype(np.uint8)


def fp8_decode(b: np.ndarray, kind: str) -> np.ndarray:
    v, code = _all_fp8(kind)
    table = np.full(128, np.nan)
    table[code] = v
    b = np.asarray(b, np.uint8)
    return np.where(b >= 128, -1.0, 1.0) * table[b & 127]


def round_to(x: np.ndarray, kind: str) -> np.ndarray:
    """float32 values after storage in an element type; ValueError where a value isn't allowed."""
    kind = element_type(kind)
    x = np.asarray(x, np.float32)
    if not np.isfinite(x).all():
        raise ValueError("vector values must be finite")
    if kind == "float32":
        return x
    if kind == "float16":
        y = x.astype(np.float16).astype(np.float32)
        if not np.isfinite(y).all():
            raise ValueError("a value is beyond the range of float16")
        return y
    if kind == "bfloat16":
        b = x.view(np.uint32).astype(np.uint64)
        return ((b + 0x7FFF + ((b >> 16) & 1)) & 0xFFFF0000).astype(np.uint32).view(np.float32)
    if kind in FP8:
        return fp8_decode(fp8_encode(x, kind), kind).astype(np.float32)
    if kind == "int8" and not ((x == np.rint(x)) & (x >= -128) & (x <= 127)).all():
        raise ValueError("int8 values must be whole numbers from -128 to 127")
    if kind == "binary" and not np.isin(x, (0, 1)).all():
        raise ValueError("binary values must be 0 or 1")
    return x


def canonical(vector: Column, kind: str) -> Column:
    """array<float> as stored in an element type; null stays null."""
    kind = element_type(kind)
    if kind == "float32":
        return vector.cast("array<float>")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([None if v is None else round_to(np.asarray(v, np.float32), kind) for v in s])

    return run(vector)
