"""The corpus pipeline: documents in, sharded training mix out.

Each stage is one of the operators of ``gatewatch.llm`` over all that the
stage before has kept; its result is written as Parquet and read back as the
next one's documents.

The stages take a table with the columns of ``documents`` and return these
columns; others are left out, whatever their names. Null and empty texts have
no words: they are not toxic by their text, are copies of each other, hold no
benchmark window, weigh nothing in the mix (so it never takes them), and lie in
a shard of their hash. Null ids are allowed. Repeated rows are copies, of which
near_dedup keeps one. Ties are broken by id, then by the text's digest. An empty
table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewatch.llm import decontam, minhash, mixing, sharding, toxicity
from gatewatch.llm.common import materialize, source_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; learned from ``labels`` over ``docs``."""
    machine = toxicity.fit(docs, source_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, machine).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.keep_one(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows go."""
    return decontam.decontaminate(docs, source_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets, repeats as repeated rows."""
    return mixing.mix_documents(docs).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The toxicity stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    docs = source_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
