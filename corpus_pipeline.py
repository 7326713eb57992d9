"""A training corpus from ``documents``: five stages, each one operator of ``floorlens.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet in
the shared folder and rereads it as the next stage's documents. All stages but the last return the
columns of ``documents``. The mix may hold a document in two rows, one per pass over its source. A
stage's table is deleted once the next one is written.

Defined results: documents with a null or empty text fail the quality rules; null doc_ids, languages
and sources are values of their own at every stage; of equal texts the row of the least doc_id stays,
null last; rows that repeat both doc_id and text stay or go together; a benchmark without texts removes
nothing; a table without rows gives none at any stage; other columns of ``documents``, whatever their
names, are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floorlens.llm import decontam, mixing, neardup, quality, tokens
from floorlens.llm.common import drop_materialised, materialise, read_table
from floorlens.llm.queries import default_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.drop_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold nothing of the benchmark."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as the mix takes them, a row per document and pass."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.read_shards(spark, tokens.write_shards(docs, default_tokenizer()))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token output", token_output),
]

#: No SQL for MCD, signatures, alignment or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_materialised(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
