"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys, of 8 bytes each, that are broadcast at most.
FEW = 1 << 18
#: Bytes of an Arrow batch.
BATCH = 8 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    In local mode, where driver and executors are one process, a temporary folder serves if none is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, and a lost executor costs nothing of it."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose rows are whole texts and go to Python next: Arrow batches, which are many times in memory there and on the way, get BATCH bytes at most, unless the session says otherwise."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name) == "67108864b":  # Spark's default
        conf.set(name, str(BATCH))
    return df


def fresh(name: str, columns: list[str]) -> str:
    """A name that no column has; names of columns do not differ by case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def sized(df: DataFrame, most: int = FEW) -> DataFrame:
    """A written table of keys, to be joined with: broadcast if it has `most` rows or fewer, else met in a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in ids, a written table, by an exact semi-join."""
    return df.join(sized(ids.select(key).distinct()), key, "left_semi")
