"""A training-corpus pipeline: five stages, each an operator of phraseloom.llm.

Stages take (spark, docs, sf_dir); what one returns is written as Parquet and read as the next
one's docs. All but the last return the columns of documents. The tables `labels` and
`benchmark` are read from sf_dir. No stage's rows can be stated in SQL from the start on, as the
first learns from labels; so ORACLE_SQL is None, and tests compare with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phraseloom.llm import fm_index, mixture, ngram_join, secrets_crf, toxicity
from phraseloom.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores below one half."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; rows without doc_id stay. Of rows with one doc_id the first by text stays."""
    later = ngram_join.near_duplicates(docs).where("component_id < doc_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(later, "doc_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*(F.col(c) for c in ("text", *docs.columns) if c != "doc_id")))
    return known.select(*docs.columns, first.alias("_first")).where("_first = 1").select(docs.columns).union(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a benchmark window covers."""
    return fm_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced."""
    return secrets_crf.redact(docs, secrets_crf.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    return mixture.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("mixture", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
