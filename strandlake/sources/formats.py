"""Text forms of numbers and rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_text(value: Column) -> Column:
    """The shortest decimal text of a double, never with an exponent: 0, 1, 0.0001; NaN and inf by name."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(plain_number, na_action="ignore").astype(object)

    return text(value.cast("double"))


def plain_number(x: float) -> str:
    if np.isnan(x):
        return "NaN"
    if np.isinf(x):
        return "inf" if x > 0 else "-inf"
    return np.format_float_positional(x, trim="-")


def text_columns(rows: DataFrame) -> list[Column]:
    return [(number_text(F.col(f.name)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name).cast("string")).alias(f.name) for f in rows.schema.fields]


def tsv_lines(rows: DataFrame) -> DataFrame:
    """Each row as one tab-separated ``line``; nulls are empty."""
    return rows.select(*text_columns(rows)).select(F.array_join(F.array(*(F.col(c) for c in rows.columns)), "\t", "").alias("line"))
