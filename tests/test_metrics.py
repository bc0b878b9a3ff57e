import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenq.functions import codecs, metrics

A, B = [1.0, 2.0, 0.0, 4.0], [1.0, 4.0, 3.0, 0.0]
GOLD = {"squared-euclidean": 29, "euclidean": math.sqrt(29), "manhattan": 9, "gower": 2.25, "chebyshev": 4, "hamming": 3, "jaccard": 0.5}
BITS = {"simple-matching": 0.5, "russell-rao": 0.75, "rogers-tanimoto": 2 / 3, "sokal-sneath": 0.8, "yule": 1.0}
OTHER = {"inner-product": -9, "lorentzian": 1.7917595, "clark": math.sqrt(2)}


@pytest.mark.parametrize(
    "a,b,gold", [(A, B, GOLD), ([1, 0, 1, 0], [1, 1, 0, 0], BITS), ([1, 0, 3], [0, 2, 3], OTHER)]
)
def test_golden(a, b, gold):
    for name, want in gold.items():
        assert metrics.block(name, np.array([a]), np.array([b]))[0, 0] == pytest.approx(want, abs=1e-6), name


def test_columns_agree_with_kernels(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.random(6).tolist(), rng.random(6).tolist()) for _ in range(20)]
    rows += [([0.0] * 6, [0.0] * 6), ([1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0])]
    rows = [([float(x) for x in a], [float(x) for x in b]) for a, b in rows]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    names = [*metrics.NAMES, "minkowski:3"]
    got = df.select("a", "b", *[metrics.distance(n, F.col("a"), F.col("b"), strict=False).alias(n.replace(":", "_")) for n in names]).collect()
    for r in got:
        for n in names:
            want = metrics.block(n, np.array([r["a"]]), np.array([r["b"]]))[0, 0]
            v = r[n.replace(":", "_")]
            assert (v is None and math.isnan(want)) or v == pytest.approx(want, abs=1e-9), n


def test_degenerate_and_errors(spark):
    z = np.zeros((1, 3))
    assert metrics.block("cosine", z, z)[0, 0] == 2.0 and metrics.block("angular", z, z)[0, 0] == 1.0
    df = spark.createDataFrame([([1.0, -1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(metrics.distance("hellinger", F.col("a"), F.col("b"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="non-negative"):
        df.select(metrics.distance("hellinger", F.col("a"), F.col("b"))).collect()
    with pytest.raises(Exception, match="equally long"):
        df.select(metrics.distance("euclidean", F.col("a"), F.lit([1.0]))).collect()
    for bad in ("nope", "minkowski:0.5", "lp:inf", "lp:x"):
        with pytest.raises(ValueError):
            metrics.parse(bad)
    assert metrics.parse("L2") == ("euclidean", None) and metrics.parse("lp:2.5") == ("minkowski", 2.5)


def test_element_types():
    enc = lambda v, k: codecs.fp8_encode(np.array(v), k).tolist()
    assert enc([1, -1, 448, 2**-9, 2**-6, 1e9], "float8-e4m3fn") == [0x38, 0xB8, 0x7E, 1, 8, 0x7E]
    assert enc([1, 57344, 2**-16, 2**-14], "float8-e5m2") == [0x3C, 0x7B, 1, 4]
    for kind in codecs.FP8:
        v, code = codecs._all_fp8(kind)
        assert codecs.fp8_encode(v, kind).tolist() == code.tolist() and codecs.fp8_decode(code, kind).tolist() == v.tolist()
    assert codecs.round_to(np.float32([1.00390625]), "bfloat16")[0] == 1.0
    assert codecs.round_to(np.float32([0.1]), "float16")[0] == np.float32(np.float16(0.1))
    for kind, bad in (("int8", 1.5), ("int8", 200), ("binary", 2), ("float32", math.inf)):
        with pytest.raises(ValueError):
            codecs.round_to(np.float32([bad]), kind)
