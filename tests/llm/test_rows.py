"""Rows that repeat because of what made the frame: each keeps a place of its own."""

import corpus_pipeline
from kinlink.llm import decontaminate, mixing
from kinlink.llm.common import with_row
from pyspark.sql import functions as F


def test_with_row(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(f"{w}x{i}" for w in words) for i in range(20)]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[3])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    items = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    twice = docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
    two = spark.createDataFrame([(0,), (0,)], "z long")
    frames = {
        "scan": (docs, 20), "filtered": (docs.filter("doc_id < 10").select("doc_id", "text", "lang", "source", "n_chars"), 10), "exploded": (twice, 40), "joined": (docs.join(two, F.col("doc_id") >= F.col("z")).drop("z"), 40), "union": (docs.unionByName(docs), 40),
        "sampled": (docs.sample(True, 3.0, seed=1), None), "random": (docs.filter(F.rand() < 0.5), None), "repartitioned": (docs.repartition(3), 20),
    }
    for name, (df, n) in frames.items():
        rows = with_row(df)
        assert rows.count() == rows.select("row").distinct().count(), name
        if n is None:
            assert sorted(r.row for r in rows.collect()) == sorted(r.row for r in rows.collect())
            continue
        assert rows.count() == n, name
        assert decontaminate.contamination(df, items).count() == n, name
        assert mixing.emit(df).count() == mixing.mix(df).agg(F.sum("copies")).first()[0], name
        left = corpus_pipeline.near_duplicates(spark, df, str(tmp_path))
        assert sorted(r.doc_id for r in left.select("doc_id").collect()) == list(range(min(n, 20))), name
