"""Passages of held-out items inside corpus documents, by size-partitioned MinHash containment search.

Items are short, documents may be long, so resemblance says little and containment is searched for.
Documents are partitioned by the size of their shingle set; each size class has its own number of
one-permutation MinHash bins, in proportion to its upper size, so that a shingle of a document
survives as its bin's minimum with the same probability in every class. An item is sketched by its
windows of 14 words; a window's minimum in coarse bins is one in all finer bins too, so a shingle
needs one number, the smallest class it counts in. Documents and items that share a minimum of the
class are candidates: tasks send those minima of a document that a Bloom filter over the items'
minima lets through, with the words around them, and both sides meet by a join on the minimum.
Candidates are verified by exact shingle containment: at least CONTAINED of the shingles of some
window must stand in the document's stretch. The words are then aligned for the passage's exact extent.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.bloom import Bloom, bloom_of, mix
from lumenq.util import materialize, shuffle_partitions, spread

SHINGLE = 5
WINDOW = 14
STEP = WINDOW - SHINGLE + 1  # shingles of a window
STOCK = 3  # items that share a stock shingle
SPREAD = 2  # bins per shingle of the class's upper size
REACH = 48  # words kept on either side of a shared minimum
CONTAINED = 0.4  # of a window's shingles: two altered words in the window leave so many
TAG = re.compile(r"<[^<>]*>")
WORD = re.compile(r"[^\W_]+")
HIDDEN = re.compile("[­​-‏⁠﻿]")


COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")


def words(text: str) -> list[str]:
    """Lower-case words without markup, accents and punctuation; doubly encoded text is put right."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        if "Ã" in text or "â€" in text:
            try:
                text = text.encode("cp1252").decode("utf-8")
            except UnicodeError:
                pass
        text = COMBINING.sub("", unicodedata.normalize("NFKD", HIDDEN.sub("", text).casefold()))
        return WORD.findall(text)
    return WORD.findall(text.lower())


class WordIds(dict):
    """A 64-bit hash per word, remembered; forgets when it has grown large."""

    def __missing__(self, word: str) -> int:
        b = word.encode()
        if len(self) > 500_000:
            self.clear()
        self[word] = h = zlib.crc32(b) | (zlib.adler32(b) << 32)
        return h

    def of(self, tokens: list[str]) -> np.ndarray:
        return mix(np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens)))


def word_ids(tokens: list[str]) -> np.ndarray:
    return WordIds().of(tokens)


def shingles(ids: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The hash of every run of n words."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
    return mix(h)


def size_class(n: int) -> int:
    """Documents of up to 2**size_class shingles."""
    return max(4, (max(1, n) - 1).bit_length())


def minima(h: np.ndarray, cls: int) -> np.ndarray:
    """The bins' minima of a set: bins are ranges of leading bits, so a bin's first hash in order."""
    bits = cls + SPREAD.bit_length() - 1
    u = np.sort(h)
    b = u >> np.uint64(64 - bits)
    first = np.ones(len(u), bool)
    np.not_equal(b[1:], b[:-1], out=first[1:])
    return u[first]


def align(a: np.ndarray, b: np.ndarray, miss: float = 1.5) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: score, words of a spanned, words matched. A match
    counts 1, a changed, missing or added word -miss."""
    n, m = len(a), len(b)
    at = miss * np.arange(m + 1)
    rows = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        best = np.zeros(m + 1)
        best[1:] = np.maximum(0, np.maximum(rows[i - 1, :-1] + np.where(b == a[i - 1], 1.0, -miss), rows[i - 1, 1:] - miss))
        rows[i] = np.maximum.accumulate(best + at) - at
    i, j = (int(x) for x in np.unravel_index(rows.argmax(), rows.shape))
    score, end, matched = float(rows[i, j]), i, 0
    while i > 0 and j > 0 and rows[i, j] > 1e-9:
        same = a[i - 1] == b[j - 1]
        if abs(rows[i - 1, j - 1] + (1.0 if same else -miss) - rows[i, j]) < 1e-9:
            matched += int(same)
            i, j = i - 1, j - 1
        elif abs(rows[i - 1, j] - miss - rows[i, j]) < 1e-9:
            i -= 1
        else:
            j -= 1
    return score, end - i, matched


def bit_length(x: np.ndarray) -> np.ndarray:
    """Of uint64 numbers."""
    x, out = x.copy(), np.zeros(x.shape, np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        large = x >= np.uint64(1 << s)
        out[large] += s
        x[large] >>= np.uint64(s)
    return out + (x > 0)


def window_minima(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of an item, each once, and the smallest size class in whose bins it is a minimum
    of one of the item's windows."""
    if not len(h):
        return h, np.zeros(0, np.int32)
    w = np.sort(np.lib.stride_tricks.sliding_window_view(h, min(STEP, len(h))), axis=1)
    shared = 64 - bit_length(w[:, 1:] ^ w[:, :-1])  # leading bits in common with the one below: same bin up to there
    first = np.zeros((len(w), 1), np.int64)
    least = np.concatenate([first, shared + 1], axis=1) - (SPREAD.bit_length() - 1)
    keys, at = np.unique(w.ravel(), return_inverse=True)
    cls = np.full(len(keys), 99)
    np.minimum.at(cls, at.ravel(), least.ravel())
    return keys, np.maximum(cls, 4).astype(np.int32)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, t) -> (i, w): the word hashes of texts of a window or more."""
    known = WordIds()
    for b in batches:
        got = [known.of(words(t)) for t in b.column(1).to_pylist()]
        at = [n for n, w in enumerate(got) if len(w) >= WINDOW]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([got[n].tobytes() for n in at], pa.binary())], names=["i", "w"])


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, w) -> (k, p, h): the shingles and their places."""
    for b in batches:
        for k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h = shingles(np.frombuffer(w, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h.view(np.int64))], names=["k", "p", "h"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, w, stock places) -> (k, w) without a lead-in and a closing line of stock shingles; an item
    that would keep less than a window keeps all."""
    for b in batches:
        out = []
        for w, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            w = np.frombuffer(w, np.uint64)
            held = np.zeros(len(w) - SHINGLE + 1, bool)
            held[places or []] = True
            lead = int(np.argmin(np.r_[held, False]))
            close = int(np.argmin(np.r_[held[::-1], False]))
            own = w[lead + SHINGLE - 1 if lead else 0 : len(w) - (close + SHINGLE - 1 if close else 0)]
            out.append((own if len(own) >= WINDOW else w).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["k", "w"])


def _item_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h, cls = window_minima(shingles(np.frombuffer(w, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k)), pa.array(h.view(np.int64)), pa.array(cls)], names=["k", "h", "least"])


WORDS_AT_ONCE = 500_000


def sketch_hits(sizes: np.ndarray, ids: np.ndarray, bloom: Bloom) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of the given numbers of words: the shingle at every place, its text (-1 across two
    texts), and the places whose shingle is a minimum of its text's sketch that bloom knows."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    h = shingles(ids)
    of = np.where(text[: len(h)] == text[SHINGLE - 1 :], text[: len(h)], -1) if len(h) else np.zeros(0, np.int64)
    at = np.flatnonzero(of >= 0)
    bits = np.array([size_class(n) for n in np.maximum(sizes - SHINGLE + 1, 1).tolist()], np.uint64) + np.uint64(SPREAD.bit_length() - 1)
    order = at[np.argsort(of[at].astype(np.uint64) << np.uint64(48) | h[at] >> np.uint64(16), kind="stable")]
    t, bins = of[order], h[order] >> (np.uint64(64) - bits[of[order]])
    first = np.ones(len(order), bool)
    first[1:] = (t[1:] != t[:-1]) | (bins[1:] != bins[:-1])
    low = order[first]
    return h, of, low[bloom.has(h[low])]


REGION = "rid bigint, cls int, hits array<bigint>, w binary"


def _stretches(bloom: Bloom):  # noqa: ANN202
    """mapInArrow: (document, text) -> document, and per stretch of it around minima that items may
    share: its number, the document's size class, the minima and the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, made = WordIds(), TaskContext.get().partitionId() << 40
        for b in batches:
            texts, n = b.column(1).to_pylist(), 0
            while n < len(texts):
                begin, some, total = n, [], 0
                while n < len(texts) and total < WORDS_AT_ONCE and n - begin < 60_000:
                    some.append(words(texts[n]) if texts[n] else [])
                    total += len(some[-1])
                    n += 1
                sizes = np.array([len(w) for w in some])
                ids = known.of(list(chain.from_iterable(some)))
                h, of, low = sketch_hits(sizes, ids, bloom)
                start = np.r_[0, np.cumsum(sizes)]
                doc, cls, hits, around = [], [], [], []
                for t in np.unique(of[low]).tolist():
                    lo, hi = int(start[t]), int(start[t + 1])
                    mine = np.unique(h[low[of[low] == t]])
                    own = h[lo : hi - SHINGLE + 1]
                    at = np.flatnonzero(np.isin(own, mine))
                    for run_ in np.split(at, np.flatnonzero(np.diff(at) > 2 * REACH) + 1):
                        doc.append(begin + t)
                        cls.append(size_class(hi - lo - SHINGLE + 1))
                        hits.append(np.unique(own[run_]).view(np.int64))
                        around.append(ids[max(lo, lo + int(run_[0]) - REACH) : min(hi, lo + int(run_[-1]) + SHINGLE + REACH)].tobytes())
                rid = np.arange(len(doc)) + made
                made += len(doc)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc, pa.int64())), pa.array(rid), pa.array(cls, pa.int32()), pa.array(hits, pa.list_(pa.int64())), pa.array(around, pa.binary())],
                    names=["doc", "rid", "cls", "hits", "w"],
                )

    return run


def passage(item: np.ndarray, doc: np.ndarray) -> tuple[float, int]:
    """The largest share of an item's window of shingles that doc contains, and the words of the item
    that the passage spans; 0 words where there is none of WINDOW words or more, about one in ten
    changed at most."""
    ih, dh = shingles(item), shingles(doc)
    inside = np.isin(ih, dh)
    held = np.convolve(inside, np.ones(STEP, int), "valid")
    best = float(held.max()) / STEP
    tried = np.zeros(len(held), bool)
    while best >= CONTAINED:
        s = int(np.where(tried, -1, held).argmax())
        if tried[s] or held[s] < CONTAINED * STEP:
            break
        tried[max(0, s - STEP // 2) : s + STEP // 2 + 1] = True
        mine = s + np.flatnonzero(inside[s : s + STEP])
        at = [(j - i) // WINDOW for i in mine.tolist() for j in np.flatnonzero(dh == ih[i]).tolist()]
        lo = max(0, s - 24)
        for band in sorted(set(at), key=at.count, reverse=True):
            d = band * WINDOW
            score, span, matched = align(item[lo : s + WINDOW + 24], doc[max(0, lo + d - 2 * WINDOW) : max(0, s + d + 3 * WINDOW + 24)])
            if span >= WINDOW and (matched >= 0.88 * span or score >= WINDOW):
                return best, span
    return best, 0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, k, item's words, stretch's words) -> doc, k, contained, words of the pairs with a passage."""
    for b in batches:
        got = [passage(np.frombuffer(i, np.uint64), np.frombuffer(d, np.uint64)) for i, d in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        at = pa.array([n for n, g in enumerate(got) if g[1]], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), b.column(1).take(at), pa.array([g[0] for g in got if g[1]], pa.float64()), pa.array([g[1] for g in got if g[1]], pa.int32())], names=["doc", "k", "contained", "words"]
        )


def passages(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text", item_text: str = "text") -> DataFrame:
    """doc, item, contained, words: every document that holds a passage of an item, the largest share of
    a window's shingles found in it, and the length of the passage aligned around that window.

    A passage is WINDOW successive words of the item or more, whatever the case, punctuation,
    spacing and markup, with about one word in ten changed, missing or added at most. Shingles that
    stand in three or more items of different words are stock where they open or close an item; such
    a lead-in or closing line is no part of the item, unless less than a window would be left. Items
    of the same words count as one, and each of their ids is given. Null and empty texts hold
    nothing, nor do items under WINDOW words; repeated rows give one row; texts are searched whole.

    Only candidate stretches of documents are shuffled. The items may be many: what goes to every
    task is their Bloom filter, 64 MB at most.
    """
    kind = docs.schema[doc].dataType
    out = T.StructType([T.StructField(doc, kind), T.StructField(item, items.schema[item].dataType), T.StructField("contained", T.DoubleType()), T.StructField("words", T.IntegerType())])
    wanted = items.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND length(t) > 0")
    named = materialize(wanted.mapInArrow(_item_words, T.StructType([T.StructField("i", out[item].dataType), T.StructField("w", T.BinaryType())])).distinct(), "items")
    texts = materialize(named.select("w").distinct().select(F.monotonically_increasing_id().alias("k"), "w"), "item-texts")
    every = materialize(texts.mapInArrow(_item_shingles, "k bigint, p int, h bigint"), "item-shingles")
    stock = every.groupBy("h").agg(F.count_distinct("k").alias("n")).where(F.col("n") >= STOCK).select("h")
    places = every.join(stock, "h", "left_semi").groupBy("k").agg(F.collect_list("p").alias("stock"))
    own = materialize(texts.join(places, "k", "left").select("k", "w", "stock").mapInArrow(_own, "k bigint, w binary"), "own-words")
    sketch = materialize(own.mapInArrow(_item_sketch, "k bigint, h bigint, least int"), "item-minima")
    bloom = bloom_of(sketch.select("h").distinct())
    shape = T.StructType([T.StructField("doc", kind), *T._parse_datatype_string(REGION).fields])
    found = spread(docs.select(doc, text).where(F.col(doc).isNotNull() & (F.length(text) > 0))).mapInArrow(_stretches(bloom), shape)
    found = materialize(found, "stretches")
    pairs = found.select("rid", "cls", F.explode("hits").alias("h")).join(sketch, "h").where("least <= cls").select("rid", "k").distinct()
    both = pairs.join(found.select("rid", "doc", F.col("w").alias("d")), "rid").join(own, "k").select("rid", "doc", "k", "w", "d")
    both = both.repartition(shuffle_partitions(docs.sparkSession), "rid")  # few rows, much work each: not to be coalesced
    held = both.drop("rid").mapInArrow(_verify, T.StructType([T.StructField("doc", kind), T.StructField("k", T.LongType()), *out.fields[2:]]))
    held = held.groupBy("doc", "k").agg(F.max("contained").alias("contained"), F.max("words").alias("words"))
    ids = texts.join(named, "w").select("k", F.col("i"))
    return held.join(ids, "k").select(F.col("doc").alias(doc), F.col("i").alias(item), "contained", "words")


def leaked(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text", item_text: str = "text") -> DataFrame:
    """doc, item of passages, each once."""
    return passages(docs, items, doc, item, text, item_text).select(doc, item)
