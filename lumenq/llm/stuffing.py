"""Pages of repeated keywords, tags, product lists or links instead of sentences.

The page is read as a sequence of symbols: a word is itself, a word with digits is its shape (runs of
digits and of letters as one each), and any link is one symbol, any hashtag another. The suffix
automaton of the sequence tells for every position the longest run of symbols ending there that
occurs again; maximal repeated runs of two symbols or more cover their characters, and so do single
symbols that stand three times (links and hashtags: twice).

Clause structure is read off the page itself, without word lists, so it holds for any language
written with blanks: the page is cut at line and sentence ends, and a segment is a clause when it is
long enough (CLOSED words up to a full stop, OPEN words without one), made of plain words (few with
digits, no links), and varied: within a window of WINDOW words hardly a longer word is said twice.
The score is the share of the page's characters in segments that lack clause structure and are
covered by repeats for the most part.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.util import spread

HEAD = r"(?:[hH][tT][tT][pP][sS]?://|[wW][wW][wW]\.)"
WORD = rf"#?(?!{HEAD})[^\W_]\w*(?:[-'’./]\w+)*"
STOPS = r"[.!?…](?=\s|<|$)|[。！？]"
LINK = rf"{HEAD}[^\s<>\"')\]|]+|<[aA]\b[^<>]*>[^<>]*</[aA]>|\[[^\[\]\n]*\]\([^()\s]*\)"
TOKEN = re.compile(rf"{WORD}|\n|{STOPS}|{LINK}|<[^<>]*>")
CLOSED, OPEN = 6, 12  # words of a clause with and without a full stop
WINDOW = 16
LONG = 4  # letters of a longer word
PLAIN, VARIED, COVERED = 0.8, 0.75, 0.5
LINE, STOP, LINKED, HASHED, MARK = range(5)  # symbols that are no words


class Symbols(dict):
    """Token -> symbol, with the attributes of symbols: characters, whether a plain and a longer word."""

    def __init__(self) -> None:
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.shapes: dict[str, int] = {}
        self.plain, self.longer = array("b", [0] * 5), array("b", [0] * 5)

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first == "\n":
            s = LINE
        elif first in ".!?…。！？":
            s = STOP
        elif first == "<":
            s = LINKED if token[1:3].lower() in ("a ", "a>") and token[-4:].lower() == "</a>" else MARK
        elif first == "[" or token[:4].lower() == "www." or "://" in token[:9]:
            s = LINKED
        elif first == "#":
            s = HASHED
        else:
            word = token.lower()
            digits = not word.isalpha() and any(c.isdigit() for c in word)
            shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", word)) if digits else word
            s = self.shapes.get(shape, -1)
            if s < 0:
                s = self.shapes[shape] = len(self.plain)
                self.plain.append(not digits)
                self.longer.append(not digits and len(word) >= LONG)
        if s != LINKED:  # links hardly return
            self[token] = s
        return s


def repeats(ids: list[int]) -> list[int]:
    """Per position the length of the longest run of symbols ending there that occurs at least twice,
    by the suffix automaton of the sequence.

    A state keeps its first transition in two arrays, further ones in a dictionary of its own: most
    states have one only, so long pages take about 200 bytes a symbol. A state occurs again if another state's suffix link points
    at it; otherwise its link's string is the longest that does.
    """
    sym, to, length, link = [-1], [0], [0], [-1]
    again = bytearray(1)
    more: dict[int, dict[int, int]] = {}
    ends = []
    last, n = 0, 1
    for at, c in enumerate(ids, 1):
        cur, n = n, n + 1
        sym.append(-1)
        to.append(0)
        length.append(at)
        again.append(0)
        ends.append(cur)
        sym[last], to[last] = c, cur  # the last state has no transition yet
        p, up = link[last], 0
        while p >= 0:
            if sym[p] == c:
                q = to[p]
                break
            other = more.get(p)
            if other is None:
                more[p] = {c: cur}
            else:
                q = other.get(c, -1)
                if q >= 0:
                    break
                other[c] = cur
            p = link[p]
        else:
            q = 0
        if q:
            if length[p] + 1 == length[q]:
                up = q
            else:
                up, n = n, n + 1
                sym.append(sym[q])
                to.append(to[q])
                length.append(length[p] + 1)
                link.append(-1)  # cur's
                link.append(link[q])
                again.append(1)
                if q in more:
                    more[up] = more[q].copy()
                while p >= 0:
                    if sym[p] == c:
                        if to[p] != q:
                            break
                        to[p] = up
                    elif p in more and more[p].get(c) == q:
                        more[p][c] = up
                    else:
                        break
                    p = link[p]
                link[q] = link[cur] = up
                last = cur
                continue
        link.append(up)
        again[up] = 1
        last = cur
    again[0] = 0
    return [length[v] if again[v] else length[link[v]] for v in ends]


def covered(s: np.ndarray, run: np.ndarray, page: np.ndarray) -> np.ndarray:
    """bool per position: whether it lies in a repeated run of two symbols or more of its page, or is a
    symbol that stands there three times, a link or hashtag that stands twice. s: symbols, run: repeats."""
    n = len(s)
    at = np.flatnonzero(run > 1)
    change = np.bincount(at + 1 - run[at], minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
    wide = int(s.max()) + 1 if n else 1
    _, back, times = np.unique(page * wide + s, return_inverse=True, return_counts=True)
    return (np.cumsum(change)[:n] > 0) | (times[back] >= np.where(s < MARK, 2, 3))


def page_scores_of(texts: list[str | None], symbols: Symbols | None = None) -> np.ndarray:
    """stuffed, covered and clause share of each page; 0 for pages without words."""
    known = Symbols() if symbols is None else symbols
    out = np.zeros((len(texts), 3))
    flat, wide, runs, size, first = array("i"), array("i"), array("i"), [], 0
    for n, text in enumerate(texts):
        tokens = TOKEN.findall(text) if text else []
        ids = [known[t] for t in tokens]
        flat.extend(ids)
        wide.extend(map(len, tokens))
        runs.extend(repeats([i for i in ids if i > STOP and i != MARK]))
        size.append(len(ids))
        if len(known) > 500_000 or len(flat) > 2_000_000:  # attributes go by symbol: closed before symbols are forgotten
            out[first : n + 1] = _shares(flat, wide, runs, size, known)
            flat, wide, runs, size, first = array("i"), array("i"), array("i"), [], n + 1
            if len(known) > 500_000:
                known.forget()
    out[first:] = _shares(flat, wide, runs, size, known)
    return out


def _shares(flat: array, wide: array, runs: array, size: list[int], known: Symbols) -> np.ndarray:
    n = len(size)
    out = np.zeros((n, 3))
    s, page = np.array(flat, np.int64), np.repeat(np.arange(n), size)
    if not len(runs):
        return out
    chars = np.array(wide, np.float64)
    end = s <= STOP
    seg = np.cumsum(np.r_[False, end[:-1] | (page[1:] != page[:-1])])
    segs = int(seg[-1]) + 1
    stop = np.zeros(segs, bool)
    stop[seg[s == STOP]] = True
    keep = ~end & (s != MARK)
    s, chars, page, seg = s[keep], chars[keep], page[keep], seg[keep]
    hit = covered(s, np.array(runs, np.int64), page)
    share = lambda by, what, least: np.bincount(by, weights=what, minlength=least)
    words, total = np.bincount(seg, minlength=segs), share(seg, chars, segs)
    plain, longer = np.frombuffer(known.plain, np.int8)[s], np.frombuffer(known.longer, np.int8)[s] > 0
    place = (np.arange(len(s)) - np.r_[0, np.cumsum(words)][seg]) // WINDOW
    new = seg[longer] * (int(place.max()) + 1) + place[longer]
    _, once = np.unique(new * (int(s.max()) + 1) + s[longer], return_index=True)
    distinct, said = np.bincount(seg[longer][once], minlength=segs), np.bincount(seg[longer], minlength=segs)
    clause = (words >= np.where(stop, CLOSED, OPEN)) & (share(seg, plain, segs) >= PLAIN * words) & (share(seg, chars * (s == LINKED), segs) <= (1 - PLAIN) * total)
    clause &= distinct >= VARIED * said
    stuffed = (~clause & (share(seg, chars * hit, segs) >= COVERED * total))[seg]
    whole = np.maximum(share(page, chars, n), 1e-9)
    for k, w in enumerate((stuffed, hit, clause[seg])):
        out[:, k] = share(page, chars * w, n) / whole
    return out


def page_score(text: str) -> tuple[float, float, float]:
    """stuffed share, covered share, share of characters in clauses; all 0 for a page without words."""
    return tuple(page_scores_of([text])[0].tolist())  # type: ignore[return-value]


def page_scores(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, stuffed, covered, clauses for every document with a text; null texts have no row, empty
    ones score 0; repeated rows give repeated rows. Pages are scored where they are, whole, without
    any shuffle."""
    out = T.StructType([docs.schema[doc], *[T.StructField(c, T.DoubleType()) for c in ("stuffed", "covered", "clauses")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Symbols()
        for b in batches:
            got = page_scores_of(b.column(1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(got[:, k]) for k in range(3)]], names=[doc, "stuffed", "covered", "clauses"])

    return spread(docs.select(doc, text).where(F.col(text).isNotNull())).mapInArrow(run, out)
