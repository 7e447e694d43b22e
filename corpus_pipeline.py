"""The corpus pipeline: five operators in a row over whole documents.

Each stage takes (spark, docs, sf_dir) and returns documents; ``run`` writes
what a stage returns to the shared folder and reads it again as the next one's
documents.  All stages but the last return the columns of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import decontaminate, jaccard_join, line_dedup, mixing
from kinlink.llm import toxicity as toxic
from kinlink.llm.common import by_place, saved, with_row


def _at(docs: DataFrame, name: str) -> str:
    """A column's name by place."""
    return f"c{docs.columns.index(name)}"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go; null texts stay."""
    names = by_place(docs).columns
    scored = toxic.predictions(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).toDF(*names, "score", "predicted")
    return scored.filter(F.col("predicted") == 0).select(*names).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; n_chars follows the text. A null text is one empty line, and becomes an empty text."""
    names = by_place(docs).columns
    out = line_dedup.dedup_lines(docs, min_docs=10).toDF(*names, "lines", "dropped")
    if "n_chars" in docs.columns:
        at, text = _at(docs, "n_chars"), _at(docs, "text")
        out = out.withColumn(at, F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by similar shingles, the one with the smallest id stays (null ids first); of its repeats, the first of the first file.

    Rows are told apart by where they stand, so rows of one id are judged each by its own text.
    """
    rows = with_row(docs)
    own = rows.select(F.struct(F.col(_at(docs, "doc_id")).alias("id"), "row").alias("doc_id"), F.col(_at(docs, "text")).alias("text"))
    found = jaccard_join.near_duplicates(own)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id.row")
    return rows.join(gone, "row", "left_anti").select(*by_place(docs).columns).toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target takes it; copy_ numbers the copies from 1."""
    return mixing.emit(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
]

#: SQL can't express the toxicity model; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
