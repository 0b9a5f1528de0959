"""Character spans of paragraphs; Spark's patterns give no places, so this one is a vectorised function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: From a visible character to the last one before a break or the end; blanks before a break join paragraphs.
SPAN = re.compile(r"\S(?:.*?\S)?(?=\n\s*\n|$)", re.DOTALL)


def spans(body: str) -> list[dict]:
    return [{"start": m.start(), "stop": m.end()} for m in SPAN.finditer(body)]


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])))
def paragraph_spans(body: pd.Series) -> pd.Series:
    return body.map(lambda t: spans(t or ""))
