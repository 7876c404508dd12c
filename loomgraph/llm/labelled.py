"""A bounded sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fold, texts


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, bound: int) -> DataFrame:
    """(doc_id, text, label, place): at most ``bound`` labelled documents that are not of fold ``out``.

    The documented bound on what a classifier is fitted on: the labelled ids of smallest hash. An id
    that is labelled twice has its largest label; a null label or id doesn't count. Only ids and labels of the
    sample pass the driver and are broadcast (16 bytes each, ``bound`` rows).
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != out))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
        .select("doc_id", "label", F.xxhash64("doc_id").alias("place"))
    )
    chosen = known.orderBy("place", "doc_id").limit(bound).collect()
    few = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], known.schema)
    return texts(docs).join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"])
