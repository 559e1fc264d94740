"""Similarity of intents."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def intent_similarity(a: str | None, b: str | None) -> float:
    """The larger of the Jaccard share of word tokens and the Ratcliff-Obershelp ratio, 1 for equal intents.

    An underscore is part of a word, so ``billing_inquiry`` is one token.
    """
    x, y = (a or "").strip().lower(), (b or "").strip().lower()
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    s, t = set(re.findall(r"\w+", x)), set(re.findall(r"\w+", y))
    share = len(s & t) / len(s | t) if s and t else 0.0
    return round(max(share, SequenceMatcher(None, x, y).ratio()), 4)


def similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([intent_similarity(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)
