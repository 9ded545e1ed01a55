"""Snapshot folders, chunks and extraction on small fixtures."""

import io
import zipfile

from ragspark.operators import text
from ragspark.operators.store import SnapshotStore
from ragspark.sources import files


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, source string, text string")
    assert store.append(rows) == 1
    assert store.replace(rows.filter("id = 1").selectExpr("id", "source", "'new' as text"), ["source"]) == 2
    assert {(r.id, r.text) for r in store.read().collect()} == {(1, "new"), (2, "y")}
    assert {(r.id, r.text) for r in store.read(1).collect()} == {(1, "x"), (2, "y")}


def test_chunks_cover_the_text():
    words = " ".join(f"word{i}" for i in range(500))
    chunks = text.split_text(words, 200, 40, ["\n\n", "\n", " ", ""])
    assert all(len(c) <= 200 for c in chunks) and {w for c in chunks for w in c.split()} == set(words.split())


def test_html():
    page = "<html><style>x</style><nav>menu</nav><p>a &amp; b<table><tr><th>Feature<th>Yes</tr><tr><td>f</td></tr></table>"
    assert text.html_text(page, " ", text.CHROME) == "a & b Feature Yes f"
    assert text.html_tables("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table>") == [{"headers": ["A", "B"], "rows": [["1", ""]]}]
    assert text.list_faqs("<ul><li>How does one begin with this engine? By reading the tables first of all.</li></ul>")[0]["question"].endswith("engine?")


def test_scan_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("h\xe9".encode("latin-1"))
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Title</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(body.getvalue())
    (tmp_path / "c.docx").write_bytes(b"broken")
    got = {r.file_name: r for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "hé" and got["b.docx"].text == "Word document: b.docx\nContains structured text and formatting information\nTitle" and got["c.docx"].text == "" and got["c.docx"].error
