"""Rewrites that need a choice for each match, as a vectorised function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import lexicon as L
from .dialect import strip

_EDGE = " ，,、；;：:"
#: The patterns from special to general, and what goes before the kept clause.
NOT_BUT = [
    (re.compile("(?P<prefix>[^。！？!?]*?)真正重要的不是(?P<x>[^，。；！？!?]{1,24})[，,、 ]*而是(?P<y>[^。；！？!?]{1,48})"), "更要紧的是"),
    (re.compile("(?P<prefix>[^。！？!?]*?)不是关于(?P<x>[^，。；！？!?]{1,24})[，,、 ]*而是关于(?P<y>[^。；！？!?]{1,32})"), ""),
    (re.compile("(?P<prefix>[^。！？!?]*?)不是(?P<x>[^，。；！？!?]{1,24})[，,、 ]*也不是(?P<m>[^，。；！？!?]{1,32})[，,、 ]*而是(?P<y>[^。；！？!?]{1,48})"), ""),
    (re.compile("(?P<prefix>[^。！？!?]*?)不是(?P<x>[^，。；！？!?]{1,24})[，,、 ]*而是(?P<y>[^。；！？!?]{1,48})"), ""),
]
LINKED = ("的", "反而", "其实", "就是")


def attach(prefix: str, clause: str) -> str:
    """The clause after its prefix, with a copula where the prefix asks for one."""
    prefix, clause = prefix.strip(), clause.strip(_EDGE)
    if prefix.endswith(LINKED):
        clause = f"是{clause}"
    return prefix + clause


def keep_positive(text: str) -> str:
    """Keeps what "not x but y" asserts."""
    for pattern, lead in NOT_BUT:
        text = pattern.sub(lambda m: attach(m["prefix"], lead + m["y"].strip(_EDGE)), text)
    return text


@F.pandas_udf(ArrayType(StringType()))
def not_but(parts: pd.Series, gated: pd.Series) -> pd.Series:
    """The paragraphs of each document, the gated ones rewritten."""
    return pd.Series([None if p is None else [keep_positive(t) if g else t for t, g in zip(p, gates)] for p, gates in zip(parts, gated)], dtype=object)


def simple(text: Column, codes: Column) -> Column:
    """The gated replacements without a callback, then blanks collapsed and ends stripped."""
    has = lambda c: F.array_contains(codes, c)
    t = F.when(has("zh.arg.truly_important"), F.regexp_replace(text, L.IMPORTANT, "")).otherwise(text)
    t = F.when(has("zh.arg.meta_essence"), F.regexp_replace(F.regexp_replace(t, L.ESSENCE, ""), L.ROOT, L.KEY)).otherwise(t)
    return strip(F.regexp_replace(t, "[ \\t]{2,}", " "))
