"""What a sink does with blocks: samples again, and sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def samples(blocks: DataFrame, size: int, by: str = "stream") -> DataFrame:
    """stream, idx, v of blocks (block, block_values)."""
    return blocks.select(by, "block", F.posexplode("block_values").alias("_k", "v")).select(by, (F.col("block") * size + F.col("_k")).alias("idx"), "v")


def routed(df: DataFrame, side: str = "both", value: str = "v") -> DataFrame:
    """Adds sides, a struct of left and right: the value, or silence on the side that is not asked for."""
    if side not in ("both", "left", "right"):
        raise ValueError(f"no side is named {side}")
    at = lambda s: F.col(value) if side in ("both", s) else F.lit(0).cast(df.schema[value].dataType)
    return df.withColumn("sides", F.struct(at("left").alias("left"), at("right").alias("right")))
