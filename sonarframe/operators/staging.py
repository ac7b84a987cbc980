"""Tables between steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that are broadcast at most.
FEW = 1 << 18


def folder(spark: SparkSession) -> str:
    """The folder for tables between steps that spark.checkpoint.dir names; in local mode, where one process is all there is, a temporary one serves if none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in folder(), so that it is worked out once and a lost executor costs nothing of it."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = FEW) -> DataFrame:
    """A small or staged table to be joined with: broadcast if it has `most` rows or fewer, else met in a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def beside(rows: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with the columns of a small table, staged or cheap, that has a row for each of keys; null is a key as well."""
    right = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return rows.join(sized(right), same, how).drop(*(f"_{k}" for k in keys))
