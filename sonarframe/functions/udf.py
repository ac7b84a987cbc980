"""Callers' functions over columns and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mapped(df: DataFrame, column: str, f: Callable[[pd.Series], pd.Series], kind: str = "double") -> DataFrame:
    """df with f over a column; f gets a batch of values as a series and returns as many."""
    return df.withColumn(column, F.pandas_udf(f, kind)(F.col(column)))


def on_chunks(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that f makes of each batch of rows; a batch without rows is passed over."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield f(b)

    return df.mapInPandas(each, schema)
