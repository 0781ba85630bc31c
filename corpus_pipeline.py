"""From raw documents to packed training sequences: quality, toxicity, near-duplicates, packing.

Every stage gets what its predecessor kept, as a Parquet table read again, and
works on all of it.  Classifiers are fitted on the labelled rows among a stage's
own input.

Null and empty texts have no words, so the quality rules reject them.  Texts of
any length are read whole.  Rows with a null id are judged like others and never
taken for copies.  Repeated rows count as copies: one stays.  Further columns
pass through to the last stage, whatever their names.  Empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import minhash, packing, quality_crf, toxicity
from tesserae.llm.common import materialize
from tesserae.llm.queries import table, tokenizer_file

#: No SQL twin: models and packing can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_crf.retain(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("toxicity", toxic), ("MinHash near-dedup", near_dedup), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
