"""Workbooks written and read back, also such as other programs write them."""

import glob
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from arbiterlake import cli
from arbiterlake.sources import datasets, workbook


def test_round_trip(spark, tmp_path):
    long = "long text " * 20_000
    rows = [
        (1, 1.5, True, date(2024, 2, 29), datetime(2024, 1, 2, 3, 4, 5), "<a&b> \"q\" 漢字🙂", ["x", "y"]),
        (2, None, False, None, None, "line\nbreak\ttab  \r\x07 _x0041_ " + long, None), (-3, 2e-7, None, date(1900, 3, 1), None, "", []), (None, float("nan"), None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "n int, x double, b boolean, d date, t timestamp, `text a` string, list array<string>").coalesce(1)
    many = spark.range(0, 3000, 1, 5).select("id", F.concat(F.lit("007"), F.col("id") % 7).alias("code"), (F.col("id") / 4).cast("decimal(10,2)").alias("amount"))
    path = f"file://{tmp_path}/book.xlsx"
    workbook.write_workbook({"first & <only>": df, "many": many, "none": many.limit(0)}, path)
    assert glob.glob(f"{tmp_path}/*") == [f"{tmp_path}/book.xlsx"]  # no fragments left
    got = [r.asDict() for r in workbook.read_sheet(spark, path, "first & <only>").collect()]
    assert [(r["n"], r["x"], r["b"], r["d"], r["t"]) for r in got] == [(1, "1.5", "true", "2024-02-29", "2024-01-02 03:04:05"), (2, None, "false", None, None), (-3, "2.0E-7", None, "1900-03-01", None), (None, "NaN", None, None, None)]
    assert [r["text a"] for r in got] == [r[5] for r in rows] and [r["list"] for r in got] == ['["x","y"]', None, "[]", None]
    back = workbook.read_sheet(spark, path, "many")
    assert back.dtypes == [("id", "bigint"), ("code", "string"), ("amount", "double")]
    assert [tuple(r) for r in back.collect()] == [(r.id, r.code, float(r.amount)) for r in many.collect()]  # in order
    assert workbook.sheet_names(spark, path) == ["first & <only>", "many", "none"] and workbook.read_sheet(spark, path, "none").count() == 0
    with pytest.raises(ValueError, match="no sheet"):
        workbook.read_sheet(spark, path, "other")


def test_failed_task_leaves_nothing(spark, tmp_path):
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id"))
    with pytest.raises(Exception, match="no"):
        workbook.write_workbook({"a": broken}, f"file://{tmp_path}/book.xlsx")
    assert glob.glob(f"{tmp_path}/*") == []


def test_shared_strings_dates_gaps_and_empty_parts(spark, tmp_path):
    main, rels = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets><sheet name="S" sheetId="7" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Target="/xl/worksheets/any.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="dd.mm.yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="2"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r></si><si><t>when</t></si><si><t>empty</t></si></sst>')
        z.writestr("xl/worksheets/any.xml", f"""<worksheet xmlns="{main}"><sheetData><row r="3"><c r="B3" t="s"><v>0</v></c><c r="D3" t="s"><v>2</v></c><c r="E3" t="s"><v>3</v></c><c r="AA3" t="str"><f>1</f><v>far</v></c></row>
<row r="5"/><row r="6"><c r="B6" t="s"><v>1</v></c><c r="D6" s="2"><v>45351</v></c><c r="AA6" s="3"><v>1.25</v></c></row><row r="7"><c r="D7" s="1"><v>45351.5</v></c></row></sheetData></worksheet>""")
    df = workbook.read_sheet(spark, str(tmp_path / "b.xlsx"), "S")
    assert df.columns == ["name", "when", "far"] and [tuple(r) for r in df.collect()] == [("rich text", "2024-02-29", 1.25), (None, "2024-02-29 12:00:00", None)]
    assert [(r.row, len(r.cells)) for r in workbook.read_workbooks(spark, str(tmp_path)).orderBy("row").collect()] == [(3, 27), (5, 0), (6, 27), (7, 4)]


def test_dataset_from_a_workbook_equals_that_of_a_folder(spark, tmp_path):
    sheets = {
        "Task_Set": spark.createDataFrame([("s1", " q1 ", "f", "c", "k", "e", "a", "r", "b", None)], "sample_id string, user_question string, known_facts string, legal_concepts string, key_missing_facts string, expected_clarification_questions string, expected_answer_points string, risk_points string, expected_behavior string, hollow string"),
        "Sample_Index": spark.createDataFrame([("s1", "draft", "d")], "sample_id string, task_type string, legal_domain string"),
        "Rubric_Items": spark.createDataFrame([("s1", "r1", "dim", "item", 2)], "sample_id string, rubric_id string, rubric_dimension string, atomic_rubric_item string, max_score int"),
    }
    workbook.write_workbook(sheets, f"file://{tmp_path}/book.xlsx")
    assert datasets.sheet_kind(spark, f"{tmp_path}/book.xlsx") == "old"
    made = datasets.build_dataset(spark, f"{tmp_path}/book.xlsx", "src")
    row = made["eval_input"].first()
    assert (row.sample_id, row.user_question, row.task_category) == ("s1", "q1", "document_drafting") and made["rubric_items"].first().max_score == 2
    assert cli.load(spark, f"{tmp_path}/book.xlsx#Sample_Index").columns == ["sample_id", "task_type", "legal_domain"]
