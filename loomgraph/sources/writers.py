"""S: sinks. Every write goes to its own new folder; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes, edges and their counts; edges are laid out by graph and relation."""
    nodes.write.parquet(f"{path}/nodes")
    edges.repartition("source_kg", "relation", F.pmod(F.xxhash64("source"), F.lit(8))).write.partitionBy("source_kg", "relation").parquet(f"{path}/edges")
    spark = nodes.sparkSession
    n = spark.read.parquet(f"{path}/nodes").groupBy("type").agg(F.count("*").alias("n")).withColumnRenamed("type", "name").withColumn("kind", F.lit("node"))
    e = spark.read.parquet(f"{path}/edges").groupBy("relation").agg(F.count("*").alias("n")).withColumnRenamed("relation", "name").withColumn("kind", F.lit("edge"))
    n.unionByName(e).write.parquet(f"{path}/stats")


def deliverable(df: DataFrame, path: str, fmt: str = "parquet", by: str = "tier") -> None:
    """Prediction rows as parquet, json or csv, one folder per tier."""
    writer = df.write.partitionBy(by)
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.option("header", True).csv(p)}[fmt](path)


def edge_list(df: DataFrame, path: str) -> None:
    """Undirected integer edges, one ``a b`` per line."""
    df.select("a", "b").write.option("sep", " ").csv(path)


def as_lines(df: DataFrame, path: str) -> None:
    df.write.text(path)


def keyed_json(df: DataFrame, key: str, value: str, path: str, parts: int = 16) -> None:
    """``{key: [values]}`` lines; a key with many values is spread over several lines."""
    values = F.array_sort(F.collect_list(F.col(value).cast("string")))
    line = F.to_json(F.map_from_arrays(F.array(F.col(key).cast("string")), F.array(F.col("vs"))))
    chunks = df.groupBy(key, F.pmod(F.xxhash64(value), F.lit(parts)).alias("chunk")).agg(values.alias("vs"))
    chunks.select(line.alias("value")).write.text(path)
