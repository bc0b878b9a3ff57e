from collections import Counter, defaultdict
from fractions import Fraction
from math import comb, log

import numpy as np
import pytest

from lumenq.llm import enrichment, rankfusion, terms

SCHEMA = "grp string, rec string, items array<struct<term:bigint,n:int>>, term string, __x int"


def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(300):
        words = rng.zipf(1.5, 12) % 200
        out.append(("a" if i % 3 else None, f"r{i}", [(int(w), int(rng.integers(0, 3))) for w in words] + [(1, 1)] * 2, "clash", i))
    out += [("a", "e", [], "c", 1), ("a", "n", None, "c", 1), ("b", "z", [(5, 0), (None, 3), (7, -1), (8, None)], "c", 1)]
    return out


@pytest.mark.parametrize("max_rows", [2_000_000, 5])
def test_counts_against_brute_force(spark, max_rows):
    occ, rec, total, held = Counter(), Counter(), Counter(), defaultdict(set)
    for g, r, items, *_ in rows():
        per = Counter()
        for t, n in items or []:
            if t is not None and n is not None and n > 0:
                per[t] += n
        for t, n in per.items():
            occ[g, t] += n
            rec[g, t] += 1
            total[g] += n
            held[g].add(r)
    got = terms.term_counts(spark.createDataFrame(rows(), SCHEMA), "grp", "items", "term", "n", max_rows=max_rows).collect()
    assert {(r["grp"], r["term"]): (r["occurrences"], r["records"]) for r in got if r["term"] is not None} == {k: (occ[k], rec[k]) for k in occ}
    assert {r["grp"]: (r["occurrences"], r["records"]) for r in got if r["term"] is None} == {g: (total[g], len(held[g])) for g in total}
    assert len(got) == len(occ) + len(total)


def test_marks_and_empty(spark):
    data = [("g", f"r{i}", [(1, 1), (100 + i, 1)]) for i in range(5)]
    df = spark.createDataFrame(data, "grp string, rec string, items array<struct<term:bigint,n:int>>")
    m = {r["term"]: r["mark"] for r in terms.marked_terms(terms.term_counts(df, "grp", "items", "term", "n")).collect()}
    assert m[1] == "common" and m[100] == "rare"
    empty = terms.term_counts(df.limit(0), "grp", "items", "term", "n")
    assert empty.count() == 0 and terms.marked_terms(empty).count() == 0


def test_string_terms(spark):
    df = spark.createDataFrame([("g", [("ä", 2), ("", 1)])], "grp string, items array<struct<t:string,c:bigint>>")
    got = {r["term"]: r["occurrences"] for r in terms.term_counts(df, "grp", "items", "t", "c").collect()}
    assert got == {"ä": 2, "": 1, None: 3}


def exact_tail(k, n, marked, total):
    return sum(Fraction(comb(marked, x) * comb(total - marked, n - x), comb(total, n)) for x in range(k, min(n, marked) + 1) if n - x <= total - marked)


def test_upper_tail_is_exact():
    cases = [(1, 10, 1, 1000), (3, 10, 5, 100), (0, 5, 5, 20), (2, 20, 300, 400), (9, 30, 70, 90000), (5, 5, 5, 5), (17, 60, 200, 500), (6, 5, 9, 50), (40, 400, 900, 5000)]
    got = enrichment.log_upper_tail(*(np.array(c) for c in zip(*cases)))
    for c, g in zip(cases, got):
        want = exact_tail(*c)
        assert (want == 0 and g == -np.inf) or g == pytest.approx(log(want) if want else 0, rel=1e-9, abs=1e-9), c
    x = np.array([0.5, 1, 2, 9.5, 10, 1e6])
    import math

    assert np.allclose(enrichment.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)


def test_enrichment_against_brute_force(spark):
    data = [r for r in rows() if r[0] == "a"]
    df = spark.createDataFrame(data, SCHEMA)
    wanted = df.select("grp", "rec").unionByName(df.select("grp", "rec").limit(3))
    got = enrichment.enrichment(df, wanted, "grp", "rec", "items", "term", "n").collect()
    per = {}
    for g, r, items, *_ in data:
        c = Counter()
        for t, n in items or []:
            if n > 0:
                c[t] += n
        if c:
            per[r] = c
    K = Counter()
    for c in per.values():
        K.update(c)
    M = sum(K.values())
    assert len(got) == sum(len(c) for c in per.values())
    by = defaultdict(list)
    for r in got:
        c = per[r["rec"]]
        want = -log(exact_tail(r["k"], sum(c.values()), K[r["term"]], M))
        assert r["k"] == c[r["term"]] and r["surprise"] == pytest.approx(want, rel=1e-8, abs=1e-8)
        by[r["rec"]].append((r["surprise"], r["score"]))
    for v in by.values():  # Benjamini-Hochberg by its definition
        v.sort(reverse=True)
        m = len(v)
        for i, (_, score) in enumerate(v):
            assert score == pytest.approx(max(0, max(v[j][0] - log(m / (j + 1)) for j in range(i, m))), abs=1e-9)
    none = enrichment.enrichment(df, wanted.limit(0), "grp", "rec", "items", "term", "n")
    assert none.count() == 0


def beta_cdf(k, m, x):
    return sum(comb(m, j) * x**j * (1 - x) ** (m - j) for j in range(k, m + 1))


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_rank_aggregation(spark, hot):
    rng = np.random.default_rng(5)
    scores, items = [], []
    for q in ("q1", "q2", None):
        for i in range(9):
            items += [(q, f"i{i}")] * (1 + i % 2)
            for leg in "xyz":
                if (i + ord(leg)) % 4:
                    scores.append((q, leg, f"i{i}", float(rng.integers(0, 5)) if leg == "x" else float(rng.random() * 10**i)))
    scores += [("q1", "x", "i3", float("nan")), ("q1", "y", "i3", None), ("q1", "x", "i4", 99.0), ("q1", "w", "i1", 1.0), ("q9", "x", "i1", 1.0)]
    s = spark.createDataFrame(scores, "query string, leg string, item string, score double")
    it = spark.createDataFrame([(*r, "clash") for r in items], "query string, item string, rank string")
    old, limit = rankfusion.mid_ranks, hot

    def small(rows, group, by, hot=limit):
        return old(rows, group, by, hot=hot)

    rankfusion.mid_ranks = small
    try:
        got = {(r["query"], r["item"]): r for r in rankfusion.aggregate_ranks(it, s, "query", "item", "leg", "score", list("xyz")).collect()}
    finally:
        rankfusion.mid_ranks = old
    assert set(got) == {(q, i) for q, i in items if q}
    for q in ("q1", "q2"):
        names = sorted({i for p, i in items if p == q})
        best = {}
        for p, leg, i, v in scores:
            if p == q and leg in "xyz" and v is not None and v == v:
                best[leg, i] = min(v, best.get((leg, i), v))
        for i in names:
            ranks = []
            for leg in "xyz":
                mine = best.get((leg, i))
                col = [v for (x, _), v in best.items() if x == leg]
                ranks.append(1.0 if mine is None else (sum(v < mine for v in col) + (sum(v == mine for v in col) + 1) / 2) / len(names))
            r = sorted(ranks)
            want = min(1.0, 3 * min(beta_cdf(k + 1, 3, r[k]) for k in range(3)))
            assert got[q, i]["significance"] == pytest.approx(want, abs=1e-12)
            assert got[q, i]["mean_rank"] == pytest.approx(sum(ranks) / 3)
    assert rankfusion.aggregate_ranks(it.limit(0), s, "query", "item", "leg", "score", ["x"]).count() == 0
