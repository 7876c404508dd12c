"""Hand cases for redrawn negatives, several classes of an item, weighted positions, walks and the shared folder."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import learning as M
from loomgraph.operators import similar as S
from loomgraph.operators.ranking import global_position
from loomgraph.session import shared_dir
from loomgraph.streaming.incremental import append_new_keys


def test_negatives_fill_up(spark):
    truth = spark.createDataFrame([(1, i) for i in range(8)] + [(2, 0)], "context long, item long")
    pool = spark.createDataFrame([(i,) for i in range(12)], "item long")
    got = {(r[0], r[1]) for r in M.negatives(truth, pool, 3).collect()}
    assert {i for c, i in got if c == 1} == {8, 9, 10, 11}  # all there are
    assert len([1 for c, _ in got if c == 2]) == 3 and (2, 0) not in got


def test_every_triple_is_corrupted(spark):
    rows = [(f"a{i}", "r", f"b{j}") for i in range(6) for j in range(6) if (i + j) % 3]
    triples = spark.createDataFrame(rows, "source string, relation string, target string")
    ents = spark.createDataFrame([(e,) for i in range(6) for e in (f"a{i}", f"b{i}")], "entity string")
    got = [tuple(r) for r in M.corrupted_triples(triples, ents, draws=1).collect()]
    assert len(got) == len(rows) and not set(got) & set(rows)


def test_an_item_in_two_classes_is_one_row(spark):
    votes = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0)], "context long, item long, score double")
    classes = spark.createDataFrame([(10, "a"), (10, "b"), (11, "a")], "item long, cls string")
    got = sorted(map(tuple, S.dominant_class_boost(votes, classes, top=1, boost=0.5).collect()))
    assert got == [(1, 10, 1.5), (1, 11, 3.0)]


def test_fractional_weights_are_kept(spark):
    df = spark.createDataFrame([(i, 0.25) for i in range(6)], "i long, w double")
    got = [r["position"] for r in global_position(df, [F.col("i")], weight=F.col("w")).orderBy("i").collect()]
    assert got == [0.25, 0.5, 0.75, 1.0, 1.25, 1.5]


def test_walks_do_not_depend_on_stretches(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("a", "r", "d"), ("b", "r", "d")], "source string, relation string, target string")
    a, b = (sorted(map(tuple, G.random_walks(edges, 2, 7, cut_every=n).select("start", "walk", "step", "node").collect())) for n in (1, 4))
    assert a == b and len(a) == 4 * 2 * 8


def test_a_cluster_must_name_its_folder():
    values = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: values.get(k, d))))


def test_a_new_checkpoint_keeps_the_store(spark, tmp_path):
    store = str(tmp_path / "store")
    for n, rows in enumerate(([(1, "a"), (2, "b")], [(2, "x"), (3, "c")])):
        folder = str(tmp_path / f"in{n}")
        spark.createDataFrame(rows, "k long, v string").write.parquet(folder)
        append_new_keys(spark.readStream.schema("k long, v string").parquet(folder), store, ["k"], str(tmp_path / f"check{n}")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(store).select("k", "v").collect())) == [(1, "a"), (2, "b"), (3, "c")]
