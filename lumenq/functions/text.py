"""Tokenizers as columns, and term ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unicode_words(text: Column) -> Column:
    """Maximal runs of letters and digits of any script, in lower case (the default tokenizer)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{IsAlphabetic}]+"), F.lit(0))


def whitespace(text: Column) -> Column:
    """Runs of anything but white space, case kept."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def char_ngrams(text: Column, n: int) -> Column:
    """All windows of n characters of the lower-cased text, blanks included; none for n = 0."""
    low = F.lower(text)
    if n <= 0:
        return F.array().cast("array<string>")
    last = F.length(low) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, n))).otherwise(F.array().cast("array<string>"))


def tokenize(text: Column, tokenizer: str = "unicode") -> Column:
    """The tokens of a text by a tokenizer's name: unicode, whitespace, or ngram:n. Null gives null."""
    head, _, n = tokenizer.partition(":")
    tokens = {"unicode": unicode_words, "whitespace": whitespace}.get(head)
    if tokens is None and head != "ngram":
        raise ValueError(f"unknown tokenizer: {tokenizer}")
    return F.when(text.isNotNull(), tokens(text) if tokens else char_ngrams(text, int(n)))


def fnv1a_32(data: bytes) -> int:
    """The 32-bit FNV-1a hash. Its offset basis and prime."""
    h = 0x811C9DC5
    for byte in data:
        h = ((h ^ byte) * 0x01000193) & 0xFFFFFFFF
    return h


def term_ids(tokens: Column) -> Column:
    """array<bigint>: the FNV-1a id of every token."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(s):  # noqa: ANN001, ANN202
        import pandas as pd

        known: dict[str, int] = {}

        def one(t: str) -> int:
            if t not in known:
                known[t] = fnv1a_32(t.encode())
            return known[t]

        return pd.Series([None if v is None else np.array([one(t) for t in v], np.int64) for v in s])

    return run(tokens)
