"""The corpus pipeline: five operators over ``documents``, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir); between stages the rows are written as
Parquet and read again.  All but the last return the columns of ``documents``.

Cases, in every stage: null and blank texts stay (unless the last stage draws them
out); very long texts are worked on whole; rows that repeat an id are kept or dropped
together by near-dedup, and are no repeats of one another in substring dedup; rows
with a null id are kept, as the largest ids; ties are settled as the operators say;
an empty table stays empty; other columns than those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.decontamination import decontaminate
from umbra.llm.minhash import near_duplicates
from umbra.llm.mixing import mix_sources
from umbra.sources.scratch import written
from umbra.llm.substring_dedup import substring_dedup
from umbra.llm.toxicity import drop_toxic, fit_rows, train_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fit_rows("doc_id", 3, 1))
    return drop_toxic(docs.select(*COLUMNS), model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has leave the text; every document stays."""
    cut = substring_dedup(docs, carry=("lang", "source", "n_chars"))
    text = F.col("kept_text")
    n_chars = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage within the edit tolerance of a benchmark item go."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that matches the target weights of sources, languages and topics; a document may come several times."""
    return mix_sources(docs.select(*COLUMNS), repeats=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Toxicity and edit distance can't be said in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
