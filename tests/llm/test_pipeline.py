"""The pipeline against a plain version, and the registered queries."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from loomgraph.llm import catalog, tiling, toxicity

from .helpers import FOLDER, HAVE, groups
from .test_dedup import plain_fingerprint

pytestmark = pytest.mark.skipif(not HAVE, reason="driver tables are missing")


def test_plain_version(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    toxic = toxicity.scored(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    left = {r["doc_id"] for r in toxic.where("predicted = 0").collect()}
    first = {}
    for i in sorted(left):
        first.setdefault(" ".join(("x" + docs[i] + "x").split()), i)
    left = sorted(first.values())
    fps = [(i, plain_fingerprint(docs[i])) for i in left]
    root = groups([(a, b) for a, x in fps for b, y in fps if b < a and (x ^ y).bit_count() <= 3], left)
    left = [i for i in left if root[i] == i]
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    known = [tiling.tokens(t) for t in items]

    def leaks(text):
        doc = tiling.tokens(text)
        return any(tiling.tiled(doc, k, 5)[0] >= 0.5 * len(k) for k in known)

    left = [i for i in left if not leaks(docs[i])]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert sorted(got) == left and 0 < len(left) < len(docs)
    for i in left:
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == library.encode(docs[i], add_special_tokens=False).ids


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "bpe_encoding"]
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in catalog.QUERIES}
    assert set(catalog.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{'pages' if name.startswith('op9') else 'documents'}.parquet").count()
