"""Toxicity scores: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashed import Ftrl, scored, smallest, train

#: Training rows at most; of more labelled rows, those with the smallest hashes of doc_id are taken.
TRAINING = 12_000
#: Rows that a shard of the training gets at least; fewer give its L1 term too little to weigh.
PER_SHARD = 6_000


def fit(documents: DataFrame, labels: DataFrame, most: int = TRAINING) -> np.ndarray:
    """Weights from the labelled documents.

    labels: doc_id, toxic; rows without either are left out, and of several labels of a doc_id the highest counts.
    Of several texts of a doc_id the first in order is learned.  Without any label all weights are 0.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("target"))
    n = known.count()
    sample = smallest(known, "doc_id", most, n)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # at most `most` different ids
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("target").alias("target"))
    return train(rows, Ftrl(alpha=3.0, beta=1.0, l1=6.0, l2=0.1), shards=max(1, min(n, most) // PER_SHARD))


def toxicity(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from a score of 0.5) for each row of documents."""
    return scored(documents, weights, "doc_id").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
