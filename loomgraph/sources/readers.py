"""S: scans with fixed schemas; blank text becomes null at the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import blank_to_null

WIDE_COLUMNS = (
    "x_id", "x_type", "x_name", "x_source", "relation", "y_id", "y_type", "y_name", "y_source", "display_relation",
)
# The sixteen columns of a gene-info file.
GENE_INFO_COLUMNS = (
    "tax_id", "GeneID", "Symbol", "LocusTag", "Synonyms", "dbXrefs", "chromosome", "map_location", "description",
    "type_of_gene", "Symbol_from_nomenclature_authority", "Full_name_from_nomenclature_authority",
    "Nomenclature_status", "Other_designations", "Modification_date", "Feature_type",
)


def _strings(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """Headerless head / relation / tail lines; lines without three fields are dropped."""
    df = spark.read.schema("head string, relation string, tail string").option("sep", "\t").option("quote", "").csv(path)
    return df.where(F.col("tail").isNotNull())


def typed_entity(c: Column) -> tuple[Column, Column]:
    """(type, rest) of ``Type::rest``; without a prefix the type is Unknown."""
    has = F.contains(c, F.lit("::"))
    return F.when(has, F.split_part(c, F.lit("::"), F.lit(1))).otherwise(F.lit("Unknown")), c


def nodes_of_triples(df: DataFrame, graph: str = "drkg") -> DataFrame:
    """C1 + C2: one node per entity of the triples."""
    ends = df.select(F.col("head").alias("entity")).unionByName(df.select(F.col("tail").alias("entity"))).distinct()
    kind, _ = typed_entity(F.col("entity"))
    return ends.select(
        F.concat(F.lit(graph + ":"), "entity").alias("id"), F.col("entity").alias("original_id"), kind.alias("type"),
        F.col("entity").alias("name"), F.lit(graph).alias("source"),
    )


PROPERTY_NODE = "identifier string, kind string, name string, data map<string,string>"
PROPERTY_EDGE = "source_id array<string>, target_id array<string>, kind string, direction string, data map<string,string>"


def property_graph(spark: SparkSession, path: str, graph: str = "hetionet", multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of property-graph documents, one JSON document per file or per line.

    Edge ends come as ``[kind, id]``; the id is the last element.
    """
    schema = f"nodes array<struct<{_struct(PROPERTY_NODE)}>>, edges array<struct<{_struct(PROPERTY_EDGE)}>>"
    doc = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    p = F.lit(graph + ":")
    nodes = doc.select(F.explode("nodes").alias("n")).select(
        F.concat(p, "n.identifier").alias("id"), F.col("n.identifier").alias("original_id"), F.col("n.kind").alias("type"),
        "n.name", F.lit(graph).alias("source"), F.col("n.data").alias("properties"),
    )
    edges = doc.select(F.explode("edges").alias("e")).select(
        F.concat(p, F.element_at("e.source_id", -1)).alias("source"), F.col("e.kind").alias("relation"),
        F.concat(p, F.element_at("e.target_id", -1)).alias("target"), F.lit(graph).alias("source_kg"), F.col("e.data").alias("properties"),
    )
    return nodes, edges


def _struct(schema: str) -> str:
    import re

    parts = re.split(r",\s+", schema)
    return ",".join(p.replace(" ", ":", 1) for p in parts)


def wide_edges(spark: SparkSession, path: str) -> DataFrame:
    """S3: rows that hold both nodes and the relation."""
    return spark.read.schema(_strings(WIDE_COLUMNS)).option("header", True).csv(path)


def nodes_of_wide(df: DataFrame, graph: str = "primekg") -> DataFrame:
    def side(s):
        return df.select(
            F.concat(F.lit(graph + ":"), f"{s}_type", F.lit(":"), f"{s}_id").alias("id"), F.col(f"{s}_id").alias("original_id"),
            F.col(f"{s}_type").alias("type"), F.col(f"{s}_name").alias("name"), F.col(f"{s}_source").alias("external_source"),
        )

    return first_node(side("x").unionByName(side("y"))).withColumn("source", F.lit(graph))


def first_node(nodes: DataFrame, key: str = "id") -> DataFrame:
    """One row per id; the lowest row wins, so the result does not depend on the input order."""
    rest = [c for c in nodes.columns if c != key]
    return nodes.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")


def indications(spark: SparkSession, path: str) -> DataFrame:
    """Indication list (CSV with a header); trimmed, rows without a drug or disease skipped."""
    df = spark.read.option("header", True).csv(path)
    for c in df.columns:
        df = df.withColumn(c, blank_to_null(F.col(c)))
    return df


def json_map(spark: SparkSession, path: str, key: str = "id", value: str = "value") -> DataFrame:
    """``{id: value}`` or ``{id: [values]}`` lines as long rows."""
    text = spark.read.text(path, wholetext=False)
    parsed = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias(key, "vs"))
    return parsed.select(key, F.explode("vs").alias(value))


def nested_json_map(spark: SparkSession, path: str) -> DataFrame:
    """``{batch: {name: id}}`` lines as (batch, name, id)."""
    text = spark.read.text(path)
    outer = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("batch", "m"))
    return outer.select("batch", F.explode("m").alias("name", "id"))


def embeddings_csv(spark: SparkSession, path: str, dims: int, prefix: str = "drkg:") -> DataFrame:
    """Entity + dim_i columns as one array column, ids prefixed."""
    cols = [f"dim_{i}" for i in range(dims)]
    df = spark.read.schema("entity string, " + ", ".join(f"{c} double" for c in cols)).option("header", True).csv(path)
    return df.select(F.concat(F.lit(prefix), "entity").alias("id"), F.array(*cols).alias("vec"))


def gene_info(spark: SparkSession, path: str) -> DataFrame:
    """Commented TSV, all text, '-' means missing."""
    df = spark.read.schema(_strings(GENE_INFO_COLUMNS)).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    return df.where(F.col("Symbol").isNotNull() & (F.col("Symbol") != "-"))


def side_effects(spark: SparkSession, names_path: str, effects_path: str) -> DataFrame:
    """(drug name, lower-case term): last column of the effect file joined to the name file by cid."""
    names = spark.read.schema("cid string, name string").option("sep", "\t").csv(names_path)
    raw = spark.read.text(effects_path).select(F.split("value", "\t").alias("f"))
    effects = raw.select(F.element_at("f", 1).alias("cid"), F.lower(F.trim(F.element_at("f", -1))).alias("term"))
    return effects.join(names, "cid").select(F.lower("name").alias("name"), "term").distinct()


def ranked_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(disease_name, drug_id, score, rank) of another model."""
    return spark.read.schema("disease_name string, drug_id string, score double, rank int").option("header", True).csv(path)


def keyed_evidence(spark: SparkSession, path: str) -> DataFrame:
    """``{"drug|disease": {...}}`` lines as (drug, disease, counts)."""
    body = "pubmed_total:int,trial_count:int,evidence_level:string,evidence_score:double"
    text = spark.read.text(path)
    rows = text.select(F.explode(F.from_json("value", f"map<string,struct<{body}>>")).alias("k", "v"))
    return rows.select(F.split_part("k", F.lit("|"), F.lit(1)).alias("drug"), F.split_part("k", F.lit("|"), F.lit(2)).alias("disease"), "v.*")
