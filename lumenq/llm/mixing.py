"""Mixing sources to target weights with capped repetition.

Water-filling: every source is to give its share of the total; a source that can't, even when all
of it is used max_repeats times, is clamped there, and what it lacks is spread over the others in
proportion to their shares, until no more sources need clamping. Sources clamped in the first round
fall short of their own target; later ones only of the excess they were to take over. What a source must give,
divided by its size, is its number of epochs: whole ones take every document, the fraction takes
each document by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.util import broadcast_if_small, materialize


def plain_source(source: Column) -> Column:
    """A source without regard to case and outer blanks; blank ones are null."""
    trimmed = F.lower(F.regexp_replace(source, r"^[\s ]+|[\s ]+$", ""))
    return F.when(trimmed != "", trimmed)


def word_count(text: Column) -> Column:
    """The number of blank-separated words; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def tokens(encode: Callable[[], Callable[[list[str]], list[int]]]) -> Callable[[Column], Column]:
    """A size in tokens: encode() is called once per task and gives a function from texts to numbers
    of tokens, e.g. of a public tokenizer whose file the caller names."""

    @F.pandas_udf(T.LongType())
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = encode()
        for s in batches:
            yield pd.Series(count(s.fillna("").tolist()))

    return size


def fill(shares: list[float], sizes: list[float], repeats: list[float], total: float) -> tuple[list[float], list[int]]:
    """The amount each source gives, and the round in which it was clamped (0: never). In the first
    round each is to give its share of the total."""
    give = [s * total for s in shares]
    clamped = [0] * len(shares)
    wanted, step = sum(give), 0
    while True:
        step += 1
        over = [i for i, c in enumerate(clamped) if not c and give[i] > sizes[i] * repeats[i]]
        if not over:
            return give, clamped
        for i in over:
            give[i], clamped[i] = sizes[i] * repeats[i], step
        rest = wanted - sum(g for g, c in zip(give, clamped) if c)
        still = sum(s for s, c in zip(shares, clamped) if not c)
        for i, c in enumerate(clamped):
            if not c:
                give[i] = rest * shares[i] / still if still > 0 else 0.0


PLAN = "mix_id string, source string, target_share double, max_repeats bigint, size bigint, total bigint, amount double, epochs double, short boolean"


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: its size, the total, the amount it is to give, epochs, and whether the
    filling clamped it in the first round: its target share of the total exceeds what it can give (short).

    sizes: source (plain), size; targets: mix_id, source, target_share, max_repeats. Repeated rows
    of targets count once; null shares and repeats are 0; a source without documents has size 0 and
    is short if its share is above 0. The total is that of all sources, in the mix or not.
    """
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    t = targets.select(
        "mix_id", plain_source(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).cast("bigint").alias("max_repeats")
    ).where("mix_id IS NOT NULL AND source IS NOT NULL").distinct()
    joined = t.join(broadcast_if_small(sizes.select("source", "size"), 100_000), "source", "left").crossJoin(F.broadcast(total))  # total is one row

    numbers = [("max_repeats", pa.int64()), ("size", pa.int64()), ("total", pa.int64()), ("amount", pa.float64()), ("epochs", pa.float64())]
    schema = pa.schema([("mix_id", pa.string()), ("source", pa.string()), ("target_share", pa.float64()), *numbers, ("short", pa.bool_())])

    def per_mix(g: pa.Table) -> pa.Table:
        rows = sorted(g.to_pylist(), key=lambda r: r["source"])
        n = rows[0]["total"]
        give, clamped = fill([r["target_share"] for r in rows], [r["size"] for r in rows], [r["max_repeats"] for r in rows], n)
        for r, a, c in zip(rows, give, clamped):
            r |= {"amount": a, "epochs": a / r["size"] if r["size"] else 0.0, "short": c == 1}
        return pa.Table.from_pylist(rows, schema=schema)

    shaped = joined.select("mix_id", "source", "target_share", "max_repeats", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), F.col("total").cast("bigint"))
    return shaped.groupBy("mix_id").applyInArrow(per_mix, PLAN)


def sized(docs: DataFrame, doc: str, source: str, text: str, size: Callable[[Column], Column] = word_count) -> DataFrame:
    """doc, source (plain), size of the documents with a source; repeated ids count once (the
    largest of their sizes)."""
    shaped = docs.select(F.col(doc).alias("doc"), plain_source(F.col(source)).alias("source"), size(F.col(text)).alias("size"))
    return shaped.where("doc IS NOT NULL AND source IS NOT NULL").groupBy("doc", "source").agg(F.max("size").alias("size"))


def composition(documents: DataFrame, plan: DataFrame, *, seed: int = 1) -> DataFrame:
    """mix_id, doc, source, size, copies: how often each document is used. The fraction of an epoch
    takes a document when the leading 48 bits of the MD5 hash of seed, mix and document, as a part of
    1, are below it: the same ones every time, on any number of tasks, and in any engine."""
    bounded = broadcast_if_small(plan.where("epochs > 0").select("mix_id", "source", "epochs"), 200_000)
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), "mix_id", F.col("doc").cast("string")))
    u = F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    whole = F.floor("epochs")
    copies = (whole + F.when(u < F.col("epochs") - whole, 1).otherwise(0)).cast("bigint")
    return documents.join(bounded, "source").select("mix_id", "doc", "source", "size", copies.alias("copies")).where("copies > 0")


def reached(made: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with the size used of each source, and its share of the mix."""
    used = materialize(made.groupBy("mix_id", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("used")), "used")
    whole = used.groupBy("mix_id").agg(F.sum("used").alias("mix_size"))
    both = plan.join(used, ["mix_id", "source"], "left").join(whole, "mix_id", "left").fillna(0, ["used"])
    return both.withColumn("reached_share", F.when(F.col("mix_size") > 0, F.col("used") / F.col("mix_size")).otherwise(0.0)).drop("mix_size")
