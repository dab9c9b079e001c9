"""From raw documents to tokens, in five stages of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and all that its predecessor kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import langid, minhash, mixing, sp_codec, toxicity
from siltstone.llm.queries import MIX_WEIGHTS
from siltstone.llm.scratch import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: null and letterless texts too. Repeated rows share their fate; no documents: no rows."""
    return langid.keep_identified(docs, langid.train(docs))


def filter_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; null and wordless texts stay. Repeated rows share their fate; no documents: no rows."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, of the least doc_id; rows without a doc_id stay, repeated rows become one."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target weights, at the number of tokens that is there; a source without tokens goes."""
    return mixing.mix(docs, MIX_WEIGHTS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and byte spans of every row; null texts have null ones."""
    return sp_codec.encode(docs)


STAGES = [
    ("language ID", identify_language),
    ("toxicity", filter_toxicity),
    ("MinHash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: The factorization machine and the piece model have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again as the next one's docs."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
