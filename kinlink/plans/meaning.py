"""Queries of the text embedder, which SQL can't express: tests compare it with a full decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedder
from . import standins as S
from .catalogue import query


@query()
def text_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and the next one: the cosine of their vectors, by an embedder fitted on all documents; null where one has no word."""
    d = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = embedder.fit(d).embedded(d).select("doc_id", "vector")
    after = vectors.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("next_id"), F.col("vector").alias("other"))
    return vectors.join(after, "doc_id").select("doc_id", "next_id", F.round(embedder.similarity(F.col("vector"), F.col("other")), 6).alias("cosine"))
