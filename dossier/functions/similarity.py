"""The ratio of matching blocks of two strings, as difflib defines it; it depends on the order of the two."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SequenceMatcher(None, a, b).ratio(); null for nulls."""
    out = []
    matcher = SequenceMatcher(None)
    last = None
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")
