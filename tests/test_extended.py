"""Files, stores and retrievers that the tables do not hold."""

import io
import zipfile

from pyspark.sql import functions as F

from ragspark.operators import audit, expansion, rebuild, vector
from ragspark.sources import files


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


SHEET = packed({
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="Costs"/></sheets></workbook>',
    "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>item</t></is></c><c r="B1" t="inlineStr"><is><t>price</t></is></c></row>'
    '<row><c r="A2" t="inlineStr"><is><t>pen</t></is></c><c r="B2"><v>2</v></c></row><row><c r="B3"><v>4</v></c></row></sheetData></worksheet>',
})
_DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
_SHOW = f'xmlns:a="{_DRAWING}" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_RUN = "<a:p><a:r><a:t>{}</a:t></a:r></a:p>"
SLIDES = packed({
    "ppt/slides/slide1.xml": f'<p:sld {_SHOW}><p:sp>{_RUN.format("Title")}</p:sp><p:graphicFrame><a:tbl><a:tr><a:tc>{_RUN.format("x")}</a:tc><a:tc/><a:tc>{_RUN.format("y")}</a:tc></a:tr></a:tbl></p:graphicFrame></p:sld>',
    "ppt/slides/_rels/slide1.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Type="http://x/relationships/notesSlide" Target="../notesSlides/notesSlide1.xml"/></Relationships>',
    "ppt/notesSlides/notesSlide1.xml": f"<p:notes {_SHOW}><p:sp>{_RUN.format('remember')}</p:sp></p:notes>",
})


def test_rendered_files(spark, tmp_path):
    assert files.sheet_text(SHEET, "a.xlsx").split("\n") == ["Excel file: a.xlsx", "Contains structured data and information", "", "--- Sheet: Costs ---", "", "Columns: item | price", "", "Row 1: pen | 2", "", "Row 2:  | 4", "", "", "Summary for numeric columns:", "", "price: mean=3.00, min=2.00, max=4.00", ""]
    assert files.slides_text(SLIDES).split("\n") == ["", "--- Slide 1 ---", "", "Title", "x | y", "", "[Notes: remember]"]
    (tmp_path / "a.xlsx").write_bytes(SHEET)
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {r.file_name: r for r in files.summarize_folder(spark, str(tmp_path)).collect()}
    assert got["a.xlsx"].sheet_names == ["Costs"] and got["a.xlsx"].total_rows == 2 and got["a.xlsx"].total_columns == 2 and got["b.docx"].error


def test_extractors_in_turn():
    def fails(content, name=""):
        raise ValueError("no")

    assert files.first_filled(fails, lambda c, n="": " ", lambda c, n="": "text")(b"") == " text"


def test_corrupt_pages_are_read_row_by_row(spark):
    def fetch(start, size):
        if start == 4:
            raise OSError("corrupt")
        return [{"id": i, "text": f"t{i}"} for i in range(start, start + size)]

    def fetch_one(at):
        if at == 5:
            raise OSError("lost")
        return {"id": at, "text": f"t{at}"}

    got = {r.offset: (r.ok, r.row.text if r.row else None) for r in rebuild.scan_pages_of_rows(fetch, fetch_one, spark, 10, 4, "id long, text string").collect()}
    assert got == {i: (i != 5, None if i == 5 else f"t{i}") for i in range(10)}


def test_retriever_finds_its_own_texts(spark):
    store = rebuild.from_texts(spark, ["red apple pie", "green pear tart", "blue sky"], vector.embed_hashing, 64, "hashing-64").select(F.col("id").alias("vec_id"), "text", "embedding", F.lit("s").alias("source"))
    asked = spark.createDataFrame([(7, "a green pear"), (8, "the sky")], "qid long, question string")
    best = {r.qid: r.text for r in expansion.Retriever(store, vector.embed_hashing, 64, 2).invoke(asked).filter("rank = 1").collect()}
    assert best == {7: "green pear tart", 8: "blue sky"}


def test_counters_user_maps_and_decisions(spark, tmp_path):
    rows, seen = audit.observed(spark.range(10), "run", even=F.col("id") % 2 == 0)
    rows.count()
    assert seen.get == {"even": 5}
    items = spark.createDataFrame([("u", 1, "b"), ("u", 0, "a"), ("v", 0, "c")], "user_id string, pos int, item string")
    rebuild.write_user_map(items, f"file://{tmp_path}/m")
    assert {r.value for r in spark.read.text(f"file://{tmp_path}/m").collect()} == {'{"user_id":"u","items":["a","b"]}', '{"user_id":"v","items":["c"]}'}
    (tmp_path / "map.json").write_text('{"u": ["a",\n {"q": 1}]}')
    assert [(r.user_id, r.pos) for r in rebuild.scan_user_map(spark, f"file://{tmp_path}/map.json").collect()] == [("u", 0), ("u", 1)]
    assert [rebuild.lifecycle(False, 0), rebuild.lifecycle(False, 0, enabled=False), rebuild.lifecycle(True, 2), rebuild.lifecycle(True, 0), rebuild.lifecycle(True, 0, force=True)] == ["rebuild", "none", "incremental", "load", "rebuild"]
