"""Upserts with forced refresh, as a table and as a stream of versions."""

from pyspark.sql import functions as F

from loomgraph.operators import evidence as L
from loomgraph.streaming.incremental import append_versions, compact, read_newest


def test_refresh_takes_the_place_of_stored_rows(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    incoming = spark.createDataFrame([(1, "x", True), (2, "y", False), (3, "z", None), (3, "w", None), (None, "m", True)], "k long, v string, again boolean")
    got = sorted(map(tuple, L.upsert_refreshed(stored, incoming, ["k"], F.col("again")).collect()), key=str)
    assert got == sorted([(1, "x"), (2, "b"), (3, "z"), (None, "m")], key=str)
    assert L.upsert_refreshed(stored.limit(0), incoming.limit(0), ["k"], F.col("again")).count() == 0


def test_newest_version_is_read_and_kept_by_compaction(spark, tmp_path):
    store, schema = str(tmp_path / "store"), "k long, v string"
    for n, rows in enumerate(([(1, "z"), (2, "b")], [(1, "a"), (3, "c"), (3, "d")], [(2, "q")])):
        folder = str(tmp_path / f"in{n}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
        for _ in range(2):  # the second run has nothing new
            append_versions(spark.readStream.schema(schema).parquet(folder), store, ["k"], str(tmp_path / f"check{n}")).awaitTermination(60)
    kind = spark.createDataFrame([], schema).schema
    want = [(1, "a"), (2, "q"), (3, "d")]
    assert sorted(map(tuple, read_newest(spark, store, kind, ["k"]).collect())) == want
    smaller = str(tmp_path / "smaller")
    compact(spark, store, kind, ["k"], smaller)
    assert spark.read.parquet(smaller).count() == 3
    assert sorted(map(tuple, read_newest(spark, smaller, kind, ["k"]).collect())) == want
    folder = str(tmp_path / "late")
    spark.createDataFrame([(1, "0")], schema).write.parquet(folder)
    append_versions(spark.readStream.schema(schema).parquet(folder), smaller, ["k"], str(tmp_path / "late-check")).awaitTermination(60)
    assert sorted(map(tuple, read_newest(spark, smaller, kind, ["k"]).collect())) == [(1, "0"), *want[1:]]
