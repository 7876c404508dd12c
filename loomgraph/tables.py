"""Concept tables built from the driver tables (schemas in FIXTURES.md, mapping in the README)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage


class Tables:
    """Lazy concept tables over one folder of parquet files; nothing is read before use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._kept: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that one query reads several times, written out at its first use."""
        if name not in self._kept:
            self._kept[name] = cut_lineage(build())
        return self._kept[name]

    def contexts(self) -> DataFrame:
        nation = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        return (
            self.raw("customer")
            .join(nation, "c_nationkey", "left")
            .select(
                F.col("c_custkey").alias("context"),
                F.lower(F.concat_ws(" ", "c_mktsegment", "n_name")).alias("name"),
                F.lower("c_mktsegment").alias("category"),
                F.col("c_name").alias("title"),
                F.col("c_nationkey").alias("nation"),
                F.col("c_acctbal").alias("balance"),
            )
        )

    def categories(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("context"), F.lower("c_mktsegment").alias("category"))

    def items(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("item"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("class1"),
            F.concat_ws("/", "p_type", "p_brand").alias("class2"),
            F.col("p_brand").alias("brand"),
            F.col("p_size").alias("size"),
            F.col("p_retailprice").alias("price"),
        )

    def _order_lines(self) -> DataFrame:
        lines = self.raw("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
        return lines.join(self.raw("orders"), "o_orderkey")

    def truth(self, flag: str = "R") -> DataFrame:
        """Truth pairs, written once per run (S13): nearly every step reads them again."""
        return self.keep(
            f"truth_{flag}",
            lambda: self._order_lines()
            .where(F.col("l_returnflag") == flag)
            .select(F.col("o_custkey").alias("context"), F.col("l_partkey").alias("item"))
            .distinct(),
        )

    def item_features(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("feature")).distinct()

    def context_features(self) -> DataFrame:
        return (
            self._order_lines()
            .select(F.col("o_custkey").alias("context"), F.col("l_suppkey").alias("feature"))
            .distinct()
        )

    def feature_groups(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("feature"), F.col("s_nationkey").alias("grp"))

    def feature_net(self) -> DataFrame:
        """Each feature interacts with the next by balance in its nation and by id in its region."""
        from pyspark.sql import Window

        nation = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        s = self.raw("supplier").join(nation, "s_nationkey")
        a = s.select(
            F.col("s_suppkey").alias("a"),
            F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")).alias("b"),
        )
        b = s.select(
            F.col("s_suppkey").alias("a"),
            F.lead("s_suppkey").over(Window.partitionBy("n_regionkey").orderBy("s_suppkey")).alias("b"),
        )
        return (
            a.unionByName(b).where(F.col("b").isNotNull())
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("context"), F.col("embedding").alias("vec"), "label")

    def item_vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("item"), F.reverse("embedding").alias("vec"), "label")

    def edges(self) -> DataFrame:
        def edge(df, src, s, rel, dst, d, kg):
            return df.select(
                F.concat(F.lit(src + "::"), s).alias("source"), F.lit(rel).alias("relation"),
                F.concat(F.lit(dst + "::"), d).alias("target"), F.lit(kg).alias("source_kg"),
            )

        parts = [
            edge(self.truth(), "Item", F.col("item"), "treats", "Context", F.col("context"), "orders"),
            edge(self.item_features(), "Item", F.col("item"), "targets", "Feature", F.col("feature"), "lineitem"),
            edge(self.context_features(), "Context", F.col("context"), "associated_with", "Feature", F.col("feature"), "orders"),
            edge(self.feature_groups(), "Feature", F.col("feature"), "member_of", "Group", F.col("grp"), "supplier"),
            edge(self.feature_net(), "Feature", F.col("a"), "interacts_with", "Feature", F.col("b"), "supplier"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
