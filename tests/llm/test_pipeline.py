"""The pipeline against its stages by brute force."""

from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from siltstone.llm import langid, sp_codec, toxicity
from siltstone.llm.queries import MIX_WEIGHTS

from ..conftest import SF
from .test_mixing import brute as mixed
from .test_near_dedup import brute as groups


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "MinHash near-dedup", "source mixing", "SentencePiece encoding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_is_the_brute_force_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    profiles = langid.train(docs)
    rows = [r for r in rows if profiles.identify(r["text"])[0] is not None]
    labels = spark.createDataFrame(pq.read_table(f"{SF}/labels.parquet").to_pandas())
    identified = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema)
    model = toxicity.train(identified, labels)
    import pyarrow as pa

    _, toxic = model.apply(pa.array([r["text"] for r in rows]))
    rows = [r for r, t in zip(rows, toxic, strict=True) if not t]
    group = groups([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if group[r["doc_id"]] == r["doc_id"]]
    want = mixed([(r["doc_id"], r["text"], r["source"]) for r in rows], MIX_WEIGHTS)
    text = {r["doc_id"]: r["text"] for r in rows}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "ids", "bounds", "n_tokens", "decodes"]
    got = got.collect()
    assert Counter(r["doc_id"] for r in got) == Counter({k[0]: n for k, n in want.items()})
    c = sp_codec.codec()
    for r in got:
        ids, bounds = c.encode([text[r["doc_id"]]])[0]
        assert r["ids"] == ids.tolist() and r["bounds"] == bounds.tolist()


@pytest.mark.parametrize("k", range(4))
def test_columns_are_kept(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
