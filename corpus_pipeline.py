"""The corpus pipeline: five stages over ``documents``, each written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph.llm import langid, line_dedup, mixing, ngram_join, templates
from ferngraph.session import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: those with no letter in them."""
    model = langid.fit(docs.where(langid.fold(F.col("doc_id")) != 1).select("text", "lang"))
    whole = docs.select("text", F.struct(*docs.columns).alias("_doc"))
    return langid.identify(whole, model, keep=["_doc"]).where("lang_pred <> 'und'").select("_doc.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines like earlier ones (Jaccard of words 0.8 or more), and documents of nothing else."""
    return line_dedup.dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by 5-word shingles at 0.8 or more."""
    return ngram_join.first_of_each(docs, k=5, num=4, den=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item, re-parameterised or not."""
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with their number of copies; those without a copy go."""
    return mixing.mix_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
]
#: Similarity joins, a fitted classifier and a random mix aren't expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
