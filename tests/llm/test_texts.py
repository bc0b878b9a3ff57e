import random

import numpy as np
from pyspark.sql import functions as F

from lumenq.llm import bloom, leakage, mixing, stuffing

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]


def passage(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def test_leaked_passages(spark):
    items = [(n, passage(n, 40) + " please answer in one short line now") for n in range(6)] + [(7, None), (8, ""), (9, "two words")]
    part = lambda n, a, b: " ".join(passage(n, 40).split()[a:b])
    changed = part(2, 5, 27).split()
    changed[9] = "other"
    del changed[18]
    docs = [
        (0, passage(50, 80)),
        (1, passage(51, 300) + " " + part(1, 3, 17) + " " + passage(52, 5000)),
        (2, passage(53, 30) + " <b>" + "</b>, ".join(changed).upper() + "! " + passage(54, 30)),
        (3, passage(55, 30) + " " + part(3, 0, 11) + " " + passage(56, 30)),  # too short
        (4, passage(57, 30) + " please answer in one short line now " + passage(58, 9)),  # stock
        (5, None),
        (6, ""),
        (8, part(4, 0, 40)),
        (8, part(4, 0, 40)),
        (9, (part(5, 0, 20) + " ") * 300),
        (None, part(5, 0, 20)),
    ]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = leakage.leaked(d, i, "doc_id", "item_id")
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 1), (2, 2), (8, 4), (9, 5)]
    assert leakage.leaked(d, i.limit(0), "doc_id", "item_id").count() == 0
    assert leakage.leaked(d.limit(0), i, "doc_id", "item_id").count() == 0


def test_words_and_minima():
    assert leakage.words("Café <i>naïve</i>&amp;co­op X_Y") == ["cafe", "naive", "coop", "x", "y"]
    assert leakage.words("cafÃ©") == ["cafe"]
    h = leakage.shingles(leakage.word_ids(passage(1, 1000).split()))
    m = leakage.minima(h, leakage.size_class(len(h)))
    assert 0.7 < len(m) / len(np.unique(h)) < 1 and set(m.tolist()) <= set(h.tolist())
    a = np.arange(1, 21, dtype=np.uint64)
    assert leakage.align(a, a) == (20.0, 20, 20) and leakage.align(a, a[5:15])[1:] == (10, 10)


def test_fill():
    assert mixing.fill([0.5, 0.5], [100, 100], [1, 1], 200) == ([100, 100], [0, 0])
    assert mixing.fill([0.5, 0.3, 0.2], [10, 100, 100], [2, 5, 5], 210) == ([20.0, 114.0, 76.0], [1, 0, 0])
    assert mixing.fill([0.5, 0.5], [1, 1], [1, 1], 100) == ([1, 1], [1, 1])  # nothing can reach it
    assert mixing.fill([0.6, 0.3, 0.1], [10, 40, 400], [1, 1, 1], 100) == ([10, 40, 50.0], [1, 2, 0])  # the second by the excess only
    assert mixing.fill([1.0, 0.0], [5, 5], [1, 9], 5) == ([5, 0], [0, 0]) and mixing.fill([], [], [], 5) == ([], [])


def test_mix(spark):
    docs = [(n, "a b c d e", " Alpha " if n % 2 else "ALPHA") for n in range(1000)] + [(2000 + n, "x y", "beta\t") for n in range(50)]
    docs += [(1, "a b c d e", " Alpha "), (5000, None, "beta"), (5001, "t", None), (5002, "t", "  "), (None, "t", "beta")]
    d = mixing.sized(spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, text string, source string, size int"), "doc_id", "source", "text")
    sizes = {r["source"]: r["s"] for r in d.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    assert sizes == {"alpha": 5000, "beta": 100}
    t = spark.createDataFrame([("m", "alpha", 0.5, 1), ("m", "beta", 0.5, 3), ("m", "beta", 0.5, 3), ("z", "gone", 0.2, 9), ("z", "alpha", None, 1), (None, "alpha", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    plan = mixing.mix_plan(d.groupBy("source").agg(F.sum("size").alias("size")), t).persist()
    p = {(r["mix_id"], r["source"]): r for r in plan.collect()}
    assert len(p) == 4 and p["m", "beta"]["short"] and not p["m", "alpha"]["short"] and p["z", "gone"]["short"]
    assert p["m", "beta"]["epochs"] == 3.0 and p["m", "alpha"]["epochs"] <= 1
    made = mixing.composition(d, plan).persist()
    assert {(r["doc"], r["copies"]) for r in made.collect()} == {(r["doc"], r["copies"]) for r in mixing.composition(d, plan).collect()}
    assert {r["copies"] for r in made.where("source = 'beta' AND mix_id = 'm'").collect()} == {3}
    r = {(x["mix_id"], x["source"]): x for x in mixing.reached(made, plan).collect()}
    assert abs(r["m", "alpha"]["used"] - p["m", "alpha"]["amount"]) < 0.1 * 5000 and abs(sum(x["reached_share"] for k, x in r.items() if k[0] == "m") - 1) < 1e-9
    assert mixing.mix_plan(d.limit(0).groupBy("source").agg(F.sum("size").alias("size")), t).count() == 4
    assert mixing.mix_plan(d.groupBy("source").agg(F.sum("size").alias("size")), t.limit(0)).count() == 0


def test_tokenizer_sizes(spark):
    def make():
        import public_tokenizers as P
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]

    df = spark.createDataFrame([("hello world", ), ("", ), (None, )], "t string")
    assert [r[0] for r in df.select(mixing.tokens(make)(F.col("t"))).collect()] == [2, 0, 0]


def brute_repeats(ids):
    n = len(ids)
    again = lambda i, size: i + 1 >= size and sum(ids[k : k + size] == ids[i + 1 - size : i + 1] for k in range(n - size + 1)) >= 2
    return [max([size for size in range(n) if size == 0 or again(i, size)]) for i in range(n)]


def test_automaton_against_brute_force():
    r = random.Random(3)
    for n in (0, 1, 2, 5, 12, 25, 40):
        for _ in range(12):
            ids = [r.randrange(r.choice((2, 5, 15))) for _ in range(n)]
            assert stuffing.repeats(ids) == brute_repeats(ids)


def test_covered():
    ids = np.array([7, 8, 9, 7, 8, 9, 20, 9, 2, 2, 30, 30])
    page = np.array([0] * 10 + [1] * 2)
    run = np.array(stuffing.repeats(ids[:10].tolist()) + stuffing.repeats(ids[10:].tolist()))
    # 9 stands three times, the link (2) twice; 20 is alone, 30 twice only
    assert stuffing.covered(ids, run, page).tolist() == [True] * 6 + [False] + [True] * 3 + [False] * 2


PROSE = {
    "en": "The cat sleeps on the table while the rain falls slowly on the street. Grandmother bakes bread with flour from the nearby mill. ",
    "it": "Il gatto dorme sul tavolo mentre la pioggia cade lenta sulla strada. La nonna prepara il pane con la farina del mulino vicino. ",
    "pl": "Kot śpi na stole, podczas gdy deszcz powoli pada na ulicę. Babcia piecze chleb z mąki z pobliskiego młyna. ",
}


def test_pages(spark):
    prose = "The writer of a record keeps the index, and each reader that has it is sure. If the page is old, the cache drops it. "
    spam = "best vector database cheap vector database free vector database "
    links = "\n".join(f"- https://site{i}.example/p{i}" for i in range(20))
    goods = "garden chair,steel lamp,oak table,blue sofa,wall clock,desk fan,tea pot,red rug,bed frame,book shelf".split(",")
    pages = {
        1: prose * 3,
        2: spam * 10,
        3: links,
        4: prose * 5 + "\nReferences\n" + links[:200],
        5: ". ".join(["Vector database cheap", "Free vector database", "Vector database best"] * 9) + ".",
        6: "#Deal #New #DealNow " * 20,
        7: spam * 20_000,
        8: "",
        9: "!!!",
        10: None,
        11: "\n".join(f"SKU A{i:02}-12{i:02} {w} gpu rental {i}.99 EUR" for i, w in enumerate(WORDS[:30])),
        12: "\n".join(f"{w}_{i} = {i * 37}\nThe value of it is what the writer of the {w} keeps." for i, w in enumerate(WORDS[:20])),
        13: "\n".join(f"Item {i:03}/{80 + i} {w} EUR {40 + i}" for i, w in enumerate(goods)),
        14: "cheap hotels in Paris for the family, best hotels in Paris for the weekend, book hotels near the Louvre, cheap hotels in Paris " * 8,
        15: "Cheap hotels in Paris for the family, best hotels in Paris for the weekend, cheap hotels near the Louvre. " * 8,
        16: " ".join(f"{w} page - [{w}](http://a.example/{i})" for i, w in enumerate(WORDS[:30])),
        17: (PROSE["en"] * 8).lower().replace(".", ""),
    }
    pages |= {20 + n: text * 8 for n, text in enumerate(PROSE.values())}
    df = spark.createDataFrame([(k, v, 0.5) for k, v in pages.items()], "doc_id bigint, text string, stuffed double")
    got = {r["doc_id"]: r["stuffed"] for r in stuffing.page_scores(df, "doc_id", "text").collect()}
    assert {k for k, v in got.items() if v > 2 / 3} == {2, 3, 5, 6, 7, 11, 13, 14, 15, 16} and 10 not in got and got[8] == got[9] == 0
    assert stuffing.page_scores(df.limit(0), "doc_id", "text").count() == 0


def test_pages_in_batches_score_alike():
    texts = [PROSE["it"] * 4, None, "a b " * 50, "", "#x #y #x #y", "one\ntwo"] * 3
    want = stuffing.page_scores_of(texts)
    assert (want == [stuffing.page_scores_of([t])[0] for t in texts]).all()


def test_sketches():
    rng = np.random.default_rng(2)
    sizes = [3, 5, 40, 700, 0, 5000]
    ids = rng.integers(1, 2**63, sum(sizes)).astype(np.uint64)
    every = bloom.Bloom(1)
    every.words[:] = 255
    h, of, low = leakage.sketch_hits(np.array(sizes), ids, every)
    for t, n in enumerate(sizes):
        own = leakage.shingles(ids[sum(sizes[:t]) : sum(sizes[: t + 1])])
        assert sorted(h[of == t].tolist()) == sorted(own.tolist())
        assert sorted(h[low[of[low] == t]].tolist()) == (leakage.minima(own, leakage.size_class(len(own))).tolist() if len(own) else [])
    item = leakage.shingles(ids[:60])
    keys, least = leakage.window_minima(item)
    for cls in (4, 6, 9):
        got = set(np.concatenate([leakage.minima(item[lo : lo + leakage.STEP], cls) for lo in range(len(item) - leakage.STEP + 1)]).tolist())
        assert got == set(keys[least <= cls].tolist())
    b = bloom.Bloom(len(item))
    b.add(item)
    assert b.has(item).all() and b.has(ids[100:5000]).mean() < 0.01 and bloom.Bloom(0).has(item).sum() == 0


def test_stock_lines_and_equal_items(spark):
    lead = " ".join(f"lead{n}" for n in range(20))
    own = [" ".join(f"own{k}x{n}" for n in range(20)) for k in range(12)]
    shared = " ".join(f"mid{n}" for n in range(20))
    items = [(k, f"{lead} {own[k]}") for k in range(12)] + [(20 + n, t) for n, t in enumerate([" ".join(f"same{n}" for n in range(20))] * 4)]
    items += [(30 + n, " ".join(f"alike{k}" for k in range(20)) + f" last{n}") for n in range(3)]  # stock throughout, but nothing else
    items += [(40 + n, f"{own[n]} {shared} {own[n + 3]}") for n in range(3)]
    docs = [(1, f"about {lead} only"), (2, f"about {own[5]} only"), (3, "about " + items[12][1]), (4, " ".join(f"alike{k}" for k in range(20))), (5, f"of {shared}")]
    docs, items = spark.createDataFrame(docs, "d bigint, text string"), spark.createDataFrame(items, "i bigint, text string")
    got = {(r["d"], r["i"]) for r in leakage.leaked(docs, items, "d", "i").collect()}
    assert got == {(2, 5), (2, 42)} | {(3, 20 + n) for n in range(4)} | {(4, 30 + n) for n in range(3)} | {(5, 40 + n) for n in range(3)}


def test_many_items_against_brute_force(spark):
    """Every item against every document by alignment of the whole texts."""
    r = random.Random(11)
    items = [(n, passage(1000 + n, 30)) for n in range(60)]
    docs = []
    for n in range(80):
        w = items[n % 60][1].split()
        lo = r.randrange(0, 17)
        part = w[lo : lo + r.randrange(8, 24)]
        if n % 2:
            part[r.randrange(len(part))] = "changed"
        docs.append((n, " ".join([passage(5000 + n, r.randrange(0, 900)), *part, passage(9000 + n, r.randrange(0, 50))])))
    ids = lambda t: leakage.word_ids(leakage.words(t))
    want = set()
    for d, t in docs:
        for i, u in items:
            score, span, matched = leakage.align(ids(u), ids(t))
            if span >= leakage.WINDOW and (matched >= 0.88 * span or score >= leakage.WINDOW):
                want.add((d, i))
    got = {(x["doc_id"], x["item_id"]) for x in leakage.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), "doc_id", "item_id").collect()}
    assert got == want and 30 < len(want) < 80
