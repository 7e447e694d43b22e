"""The whole plan on golden scenarios, sheets as files, streams, and the registered queries."""

import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinlink import schemas
from kinlink.operators import blocking, report, rows
from kinlink.plans import catalogue
from kinlink.plans.resolve import resolve
from kinlink.sources import cells, workbook
from kinlink.streaming import incremental

FIELDS = [f.split()[0] for f in schemas.PROFILE.split(", ")]
LOW, HIGH = 0, (1 << 62) - 1


def profiles(spark, platform, *given):
    return spark.createDataFrame([tuple({"platform": platform, **g}.get(f) for f in FIELDS) for g in given], schemas.PROFILE)


def image(n, h):
    return (f"https://i/{n}", str(n), False, {"full": {"p": h, "d": h, "a": h}})


def test_resolve(spark):
    kick = profiles(
        spark, "kick",
        {"username": "starwraith", "category": "Elden Ring", "language": "es", "profile_image_url": "https://i/1"},
        {"username": "alex123", "category": "Fortnite", "language": "fr", "profile_image_url": "https://i/2"},
        {"username": "nikkilve", "profile_image_url": "https://i/3", "description": "https://instagram.com/nikk"},
        {"username": "the-real-abc", "profile_image_url": "https://i/5", "description": "twitch.tv/abcofficialtv"},
        {"username": "conflicted", "profile_image_url": "https://i/6", "description": "https://twitch.tv/someoneelse"},
    )
    twitch = profiles(
        spark, "twitch",
        {"username": "starwraith", "display_name": "StarWraith", "category": "Elden Ring", "language": "es", "profile_image_url": "https://i/11"},
        {"username": "alex123", "category": "Minecraft", "language": "pt", "profile_image_url": "https://i/12"},
        {"username": "nikklive_", "display_name": "NikkLive_", "profile_image_url": "https://i/13", "description": "instagram.com/nikk"},
        {"username": "abcofficialtv", "display_name": "ABCOfficialTV", "profile_image_url": "https://i/15", "description": "kick.com/the_real_abc"},
        {"username": "conflicted", "profile_image_url": "https://i/16"}, {"username": "ghostkick"},
    )
    images = spark.createDataFrame([image(1, 11), image(11, 11), image(2, LOW), image(12, HIGH), image(3, 33), image(13, 33), image(5, 55), image(15, 55), image(6, 66), image(16, 66)], schemas.IMAGE)
    sheet = spark.createDataFrame(
        [(2, "starwraith", "Spain", None, None), (3, "alex123", "France", None, None), (4, "nikkilve", "Germany", None, None), (5, "the-real-abc", "France", "None", None), (6, "unknownabc", "France", None, None),
         (7, "ghostkick", "France", None, None), (8, None, "France", None, None), (9, "starwraith", "Spain", None, "mine"), (10, "conflicted", "France", None, None)], schemas.SHEET_ROW,
    )
    searched = blocking.search_by_grams(kick.select(F.col("username").alias("source_key"), "username"), twitch)
    found = {r.original_row: r for r in resolve(sheet.repartition(3), kick, twitch, "kick", images, searched=searched).collect()}
    assert {k: (r.status, r.destination, r.remarks) for k, r in found.items()} == {
        2: ("MATCH", "StarWraith", None), 3: ("REVIEW", None, "no twitch id found"), 4: ("MATCH", "NikkLive_", None), 5: ("MATCH", "ABCOfficialTV", None), 6: ("SOURCE_NOT_FOUND", None, "no Id on both platforms"),
        7: ("MATCH", "ghostkick", "no kick channel found"), 8: ("SKIPPED_EMPTY", None, None), 9: ("MATCH", "StarWraith", None), 10: ("REVIEW", None, "no twitch id found"),
    }
    assert found[9].write_remarks is False and found[5].write_destination is True


def _book(path):
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="2"><c r="A2" t="inlineStr"><is><t>ID_Kick</t></is></c><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>id twitch</t></is></c></row>
<row r="3"><c r="A3" t="inlineStr"><is><t>abc</t></is></c><c r="B3" t="inlineStr"><is><t>Spain</t></is></c></row>
<row r="5"><c r="A5" t="inlineStr"><is><t>def</t></is></c><c r="C5"><v>12.0</v></c></row></sheetData></worksheet>"""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Country</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_workbook_round_trip(spark, tmp_path):
    path, out = str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")
    _book(path)
    workbook.register(spark)
    before = spark.read.format("workbook").load(path)
    head = cells.header(before)
    read = cells.rows(before, head, "kick").orderBy("original_row").collect()
    assert [(r.original_row, r.source_value, r.country, r.existing_destination) for r in read] == [(3, "abc", "Spain", None), (4, None, None, None), (5, "def", None, "12")]
    plan = {r.header: (r.col, r.is_new) for r in cells.planned_columns(before, head).collect()}
    assert plan == {"remarks": (4, True), "twitch_id_link": (5, True), "kick_id_link": (6, True)}
    writes = spark.createDataFrame([(3, True, "New", True, "note"), (5, False, None, False, None)], "original_row int, write_destination boolean, destination string, write_remarks boolean, remarks string")
    expected = cells.expected_cells(writes, {"destination": 3, "remarks": 4}, "One", 2)
    workbook.write_cells(path, out, expected)
    after = spark.read.format("workbook").load(out)
    sheet_rows = cells.rows(before, head, "kick")
    assert cells.verified(before, after, expected, sheet_rows, 1).first().ok
    wrong = after.withColumn("value", F.when((F.col("row") == 5) & (F.col("col") == 1), "tampered").otherwise(F.col("value")))
    bad = cells.verified(before, wrong, expected, sheet_rows, 1).first()
    assert not bad.ok and bad.n_mismatches == 2
    with pytest.raises(workbook.WorkbookError):
        list(workbook.read_cells(str(tmp_path / "x.xls")))
    with pytest.raises(Exception, match="formula"):
        cells.expected_cells(writes.withColumn("destination", F.lit("=A1")), {"destination": 3, "remarks": 4}, "One", 2).collect()
    with pytest.raises(Exception, match="duplicate write"):
        cells.expected_cells(writes.unionByName(writes), {"destination": 3, "remarks": 4}, "One", 2).collect()


def test_workbooks_written_in_tasks(spark, tmp_path):
    for name in "ab":
        _book(str(tmp_path / f"{name}.xlsx"))
    given = [(str(tmp_path / f"{n}.xlsx"), str(tmp_path / f"{n}-out.xlsx"), "One", 3, 3, f"for {n}") for n in "ab"]
    done = workbook.write_workbooks(spark.createDataFrame(given, "original string, output string, sheet string, row int, col int, value string")).collect()
    assert {(r.output, r.n_cells) for r in done} == {(g[1], 1) for g in given}
    assert [next(v for s, r, c, v in workbook.read_cells(g[1]) if (r, c) == (3, 3)) for g in given] == ["for a", "for b"]


def test_gate_and_verdicts_raise(spark):
    out = spark.createDataFrame([(1,)], "x int")
    gate = lambda ok: spark.createDataFrame([(ok, 3)], "ok boolean, n_mismatches long")
    assert report.released(out, gate(True)).count() == 1
    with pytest.raises(Exception, match="verification failed"):
        report.released(out, gate(False)).collect()
    sheet_rows = spark.createDataFrame([("s", [("a",)])], "source_key string, candidates array<struct<username:string>>")
    log = spark.createDataFrame([], schemas.VERDICT)
    given = lambda target, word: spark.createDataFrame([("s", target, word, None)], schemas.VERDICT)
    assert [r.verdict for r in report.submitted(log, given("A", "CONFIRM"), sheet_rows).collect()] == ["CONFIRMED"]
    assert report.submitted(log, given("b", "SKIP"), sheet_rows).collect() == []
    for target, word, match in (("b", "CONFIRM", "no candidate"), ("a", "MAYBE", "unknown verdict")):
        with pytest.raises(Exception, match=match):
            report.submitted(log, given(target, word), sheet_rows).collect()


def test_many_rows_few_identities(spark):
    sheet = spark.range(300).select(F.col("id").cast("int").alias("original_row"), F.concat(F.lit("u"), F.col("id") % 37).alias("source_key"), F.lit("x").alias("source_value"), F.lit("y").alias("country"))
    assert rows.groups(sheet).count() == 37
    out = rows.fanned_out(sheet, rows.groups(sheet).select("source_key", "country_key", "n_rows"))
    assert out.count() == 300 and out.filter("n_rows IS NULL").count() == 0


def test_detection_and_limits(spark):
    df = spark.createDataFrame([(True, 1.0, 0.2), (True, 0.1, 0.9), (False, 0.5, 0.5)], "k boolean, a double, b double")
    assert [r.p for r in df.select(cells.detected_platform(F.col("k"), F.col("a"), F.col("b")).alias("p")).collect()] == ["kick", None, "twitch"]
    with pytest.raises(ValueError, match="too many rows"):
        cells.checked_size(spark.range(10), 5)


def test_stream_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    schema = "k int, status string, decision string, manual_verdict string"
    for batch in (["MATCH", "API_ERROR"], ["REVIEW"]):
        spark.createDataFrame([(i, s, s, None) for i, s in enumerate(batch)], schema).coalesce(1).write.mode("append").parquet(src)
        incremental.run_available(spark.readStream.schema(schema).parquet(src), lambda b: b, out, mark).awaitTermination()
    done = spark.read.parquet(out)
    assert done.count() == 3
    assert {r.batch_id: r.processed_rows for r in incremental.progress(done).collect()} == {0: 2, 1: 1}


def test_registered(spark):
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
