import json
import os
import tempfile

from pyspark.sql import functions as F

from loomgraph.sources import readers, writers
from loomgraph.streaming.incremental import append_new_keys


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_triples_drop_short_lines(spark):
    path = os.path.join(folder(), "t.tsv")
    with open(path, "w") as f:
        f.write("Gene::1\trel\tGene::2\nbroken\tline\nplain\trel\tGene::3\n")
    df = readers.triples(spark, path)
    assert df.count() == 2
    assert {r.type for r in readers.nodes_of_triples(df).collect()} == {"Gene", "Unknown"}


def test_multi_line_property_graph(spark):
    path = os.path.join(folder(), "g.json")
    doc = {"nodes": [{"identifier": 7, "kind": "Gene", "name": "x", "data": {"a": "b"}}],
           "edges": [{"source_id": ["Gene", 7], "target_id": ["Disease", "D1"], "kind": "associates", "direction": "both", "data": {}}]}
    with open(path, "w") as f:
        json.dump(doc, f, indent=1)
    nodes, edges = readers.property_graph(spark, path)
    assert nodes.first().id == "hetionet:7"
    assert (edges.first().source, edges.first().target) == ("hetionet:7", "hetionet:D1")


def test_first_node_wins_by_order(spark):
    df = spark.createDataFrame([("a", "z"), ("a", "b"), ("c", "d")], "id string, name string")
    assert sorted((r.id, r.name) for r in readers.first_node(df).collect()) == [("a", "b"), ("c", "d")]


def test_keyed_json_spreads_hot_key(spark):
    path = os.path.join(folder(), "j")
    df = spark.range(200).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    writers.keyed_json(df, "k", "v", path)
    assert spark.read.text(path).count() > 1
    assert readers.json_map(spark, path).count() == 200


def test_stream_adds_only_new_keys(spark):
    src, store, chk = folder(), folder() + "/store", folder()
    schema = "k bigint, v string"

    def feed(n, data):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{src}/part{n}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        append_new_keys(stream, store, ["k"], chk).awaitTermination()

    feed(1, [(1, "a"), (2, "b"), (2, "b")])
    run()
    feed(2, [(2, "changed"), (3, "c")])
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(store).collect()) == [(1, "a"), (2, "b"), (3, "c")]
