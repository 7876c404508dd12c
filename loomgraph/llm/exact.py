"""Exact dedup with a heavy-hitter split: frequent digests are settled on the map side, the rest by a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh, texts
from loomgraph.session import cut_lineage


def _sha(text: Column) -> Column:
    """SHA-256 (hex) of the text after each run of white space became one space.

    The pattern leaves single spaces alone, which are most runs and stay as they are.
    """
    return F.sha2(F.regexp_replace(text, r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " "), 256)


def digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, digest): _sha() of every row's text, in bytes."""
    return texts(df, key, text).select("doc_id", F.unhex(_sha(F.col("text"))).alias("digest"))


def _trim(counts: pd.Series, counters: int) -> pd.Series:
    """Misra-Gries reduction of a summary: all counters less the (k+1)-th largest, the positive ones stay."""
    if len(counts) <= counters:
        return counts
    counts = counts.sort_values(ascending=False, kind="stable")
    left = counts.iloc[:counters] - counts.iloc[counters]
    return left[left > 0]


def frequent(table: DataFrame, counters: int = 256) -> DataFrame:
    """Every digest of more than n / (counters + 1) of the n rows, with others perhaps; ``counters`` rows at most.

    Each task keeps a Misra-Gries summary of its rows. Summaries add up by digest, and one more
    reduction by the (k+1)-th largest sum keeps the guarantee (summaries of this kind can be merged).
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pd.Series([], dtype="int64")
        for batch in batches:
            seen = batch.column(0).value_counts()
            new = pd.Series(seen.field("counts").to_numpy(), index=seen.field("values").to_pylist(), dtype="int64")
            kept = _trim(kept.add(new, fill_value=0).astype("int64"), counters)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(kept.index), pa.binary()), "weight": pa.array(kept.to_numpy(), pa.int64())})

    sums = (
        table.select("digest").mapInArrow(summary, "digest binary, weight long")
        .groupBy("digest").agg(F.sum("weight").alias("weight"))
    )
    top = sums.orderBy(F.desc("weight"), "digest").limit(counters + 1).collect()  # a top-k report of fixed size
    spare = top[-1]["weight"] if len(top) > counters else 0
    left = [(x["digest"],) for x in top if x["weight"] > spare]
    return table.sparkSession.createDataFrame(left, "digest binary")


def groups(df: DataFrame, text: str = "text", key: str = "doc_id", counters: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Rows are equal when their normalised texts are; the smallest id of a group stays. A null text
    equals the empty one. Rows that repeat an id share its fate. A null id is kept only where its
    group has no other. An empty table gives an empty result. At most ``counters`` digests are
    broadcast, whatever the input; a digest that is left to the shuffle has n / (counters + 1) rows
    at most.
    """
    table = cut_lineage(digests(df, text, key))
    candidates = frequent(table, counters)  # at most ``counters`` rows of 32 bytes
    winners = cut_lineage(
        table.join(F.broadcast(candidates), "digest")
        .groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    hot = table.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    cold = (
        table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .select("digest", "doc_id", F.min("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"))
    )
    return hot.select("digest", "doc_id", "keep_id", "group_size").unionByName(cold).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, counters: int = 256) -> DataFrame:
    """One row of ``docs`` of each group stays, with all its columns: one with the smallest id, or with a null id where
    the group has no other. Columns of ``docs`` may have any names beside doc_id and text."""
    mine = groups(docs, counters=counters)
    sha, kept = fresh(docs, "sha"), fresh(docs, "kept")
    stay = (
        mine.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"))
        .select(F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "rows").alias(kept))
    )
    named = docs.withColumn(sha, _sha(F.coalesce(F.col("text"), F.lit(""))))
    found = named.join(stay, F.col("doc_id").eqNullSafe(F.col(f"{kept}.id")) & (F.col(sha) == F.col(f"{kept}.sha")))
    # only rows that repeat id and text are dealt once more
    return found.where(f"{kept}.rows = 1").unionByName(found.where(f"{kept}.rows > 1").dropDuplicates([sha])).select(*docs.columns)


SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
WINDOW w AS (PARTITION BY h)"""
