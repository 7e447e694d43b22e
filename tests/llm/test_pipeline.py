"""The pipeline on a small corpus with planted cases."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_planted(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), 7))
    clean = [" ".join(word() for _ in range(80)) for _ in range(60)]
    item = " ".join(word() for _ in range(14))
    common = "a line that many documents share"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, f"{common}\n{t} tail{i}", "en", "s0", 0) for i, t in enumerate(" ".join(word() for _ in range(60)) for _ in range(12))]
    near = clean[5].split()
    near[40] = "changed"
    rows += [(200, clean[3], "en", "s1", 0), (201, " ".join(near), "en", "s1", 0), (202, f"{word()} {item} {word()}", "en", "s2", 0), (203, "some m0r0n wrote this here " + word(), "en", "s2", 0), (204, None, None, None, None)]
    toxic = [(300 + i, f"{word()} {word()} moron {word()}", "en", "s1", 0) for i in range(40)]
    rows += toxic
    d = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(60)] + [(r[0], 1) for r in toxic], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, d), name.replace(" ", "-"))
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        seen.append({r.doc_id: r.text for r in docs.collect()})
    every = {r[0] for r in rows}
    assert every - set(seen[0]) == {203, *(r[0] for r in toxic)}
    assert set(seen[1]) == set(seen[0]) and all(common not in (t or "") for t in seen[1].values()) and seen[1][0] == clean[0]
    assert set(seen[1]) - set(seen[2]) == {200, 201}
    assert set(seen[2]) - set(seen[3]) == {202}
    out = corpus_pipeline.run(spark, d)
    assert {"doc_id", "text", "copy_"} <= set(out.columns)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= set(seen[3])
    assert out.groupBy("doc_id").agg(F.max("copy_").alias("m"), F.count("*").alias("n")).filter("m > 3 OR m <> n").count() == 0


def _tables(spark, d, rows, schema, labels=(), items=()):
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    _tables(spark, str(tmp_path / "a"), [], COLUMNS)
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() == 0
    _tables(spark, str(tmp_path / "b"), [(1, "one two three", "en", "s", 13)], COLUMNS)
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "b")).select("doc_id").distinct().collect()] == [1]


def test_repeated_rows_and_null_ids(spark, tmp_path):
    """Each row is judged by its own text: of copies one row stays, and no other row of its id goes with the rest."""
    d = str(tmp_path)
    copy, item = " ".join(f"copy{i}" for i in range(30)), " ".join(f"item{i}" for i in range(12))
    rows = [(0, copy), (1, copy), (1, "a text of its own that nothing else repeats"), (1, copy), (None, copy), (None, "another text without an id, all alone"), (7, "x"), (7, "x"), (8, None), (8, None), (9, f"{item} end"), (9, "clean text with the same id")]
    _tables(spark, d, [(i, t, "en", "s", 0) for i, t in rows], COLUMNS, [(0, 0)], [(1, item)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = corpus_pipeline.near_duplicates(spark, docs, d)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted((str(i), t) for i, t in [(None, copy), *rows[2:3], rows[5], rows[6], *rows[8:]])
    clean = corpus_pipeline.decontaminated(spark, docs, d)
    assert sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == sorted((str(i), str(t)) for i, t in rows if t != f"{item} end")
    assert corpus_pipeline.run(spark, d).filter("copy_ > 3").count() == 0


def test_clashing_columns(spark, tmp_path):
    """Columns named like the operators' own stay as they are."""
    d = str(tmp_path)
    names = ["score_", "predicted_", "n_lines_", "n_dropped_", "row", "copy_", "n_", "rows_", "gone_id_", "bad_id_", "c0", "lines", "predicted", "_metadata"]
    schema = COLUMNS + ", " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, f"text {i} of many words for a line\nshared line", "en", "s", 0, *[f"{n}{i}" for n in names]) for i in range(20)]
    _tables(spark, d, rows, schema, [(0, 0), (1, 1)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, d), "stage")
        assert docs.columns == [c.split()[0].strip("`") for c in schema.split(", ")]
    assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names) and docs.count() > 0
    assert docs.filter("text LIKE '%shared line%'").count() == 0
    out = corpus_pipeline.run(spark, d)
    assert out.columns == [*docs.columns, "copy__"] and all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
