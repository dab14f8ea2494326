import io
import tarfile
import zipfile

import pytest

from shelfmark.sources import parsers
from shelfmark.sources.scan import TooManyFiles, entries, parsed, scan
from shelfmark.streaming import additive


def zipped(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in files.items():
            z.writestr(n.replace("__", "/"), t)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
DOCX = zipped(**{"word__document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>첫 문단</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
PPTX = zipped(**{"ppt__slides__slide1.xml": f"<p {A}><a:t>Title</a:t></p>", "ppt__slides__slide2.xml": "<broken"})
XLSX = zipped(
    **{
        "xl__workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>',
        "xl___rels__workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl__sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
        "xl__worksheets__sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>42</v></c></row></sheetData></worksheet>',
    }
)


def tarred():
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as t:
        t.addfile(tarfile.TarInfo("in/readme.md"))
    return b.getvalue()


@pytest.mark.parametrize(
    "name, data, want",
    [
        ("a.txt", "안녕".encode("cp949"), "안녕"),
        ("a.html", b"<b>x &amp; y</b><script>no</script><p>z</p>", "x & y\nz"),
        ("a.rtf", rb"{\rtf1\ansi Hello \b world}", "Hello world"),
        ("a.docx", DOCX, "첫 문단\nx | y"),
        ("a.pptx", PPTX, "Title"),
        ("a.xlsx", XLSX, "# Sheet: S1\nname | 42"),
        ("a.odt", zipped(**{"content.xml": "<d><p>one</p><p>two</p></d>"}), "one\ntwo"),
        ("a.hwpx", zipped(**{"Contents__section0.xml": "<s><t>본문</t></s>"}), "본문"),
        ("a.zip", zipped(**{"x__y.txt": "1"}), "[archive: a.zip — 1개 파일]\nx/y.txt"),
        ("a.tar.gz", tarred(), "[archive: a.tar.gz — 1개 파일]\nin/readme.md"),
        ("a.png", b"..", ""),
        ("a.docx", b"garbage", ""),
        ("a.hwp", b"garbage", ""),
        ("a.pdf", b"garbage", ""),
        ("a.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", ""),
        ("a.txt", None, ""),
        (None, b"x", ""),
    ],
)
def test_parsers(name, data, want):
    assert parsers.excerpt(data, name) == want


def test_late_and_long():
    assert len(parsers.excerpt(b"x" * 1_000_000, "a.txt")) == 1_800
    assert parsers.listing("big.zip", [f"file{i:04}.txt" for i in range(500)], 300).endswith("…")

    def slow(data, name, most):
        while True:
            yield ""

    parsers.PARSERS["slow"] = slow
    try:
        assert parsers.excerpt(b"x", "a.slow", seconds=0.2) == ""
    finally:
        del parsers.PARSERS["slow"]


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    for n, t in (("a.txt", "hello"), ("sub/b.html", "<p>hi</p>"), (".hidden/c.txt", "no"), ("Thumbs.db", "no")):
        (tmp_path / n).write_text(t)
    got = {r["name"]: (r["ext"], r["mime"], r["size"]) for r in scan(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (".txt", "text/plain", 5), "b.html": (".html", "text/html", 9)}
    assert {r["excerpt"] for r in parsed(spark, str(tmp_path)).collect()} >= {"hello", "hi"}
    with pytest.raises(TooManyFiles):
        scan(spark, str(tmp_path), max_files=1)
    rows = {r["name"]: r["excerpt"] for r in entries(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": "hello", "b.html": "hi"}
    old = spark.createDataFrame([(1, str(tmp_path / "a.txt"), (tmp_path / "a.txt").stat().st_mtime, 5, "kept", None)], "cache_id long, path string, mtime double, size long, excerpt string, updated_at timestamp")
    rows = {r["name"]: r["excerpt"] for r in entries(spark, str(tmp_path), old).collect()}
    assert rows["b.html"] == "hi" and rows["a.txt"] in ("kept", "hello")


def test_stream(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1, 10)
    rows = [("/r", "/r/new.pdf", "new.pdf", ".pdf", "", t), ("/r", "/r/1. x [FA·ab12cd]/old.pdf", "old.pdf", ".pdf", "", t), ("/r", "/r/new.pdf", "new.pdf", ".pdf", "", t)]
    df = spark.createDataFrame(rows, "root string, path string, name string, ext string, excerpt string, modified timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = additive.file_stream(spark, str(tmp_path / "in"), df.schema)
    additive.run_to_table(additive.classified(additive.first_seen(stream, ["path"])), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = [(r["path"], r["category_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("/r/new.pdf", "documents")]
    counts = additive.windowed_counts(additive.file_stream(spark, str(tmp_path / "in"), df.schema), "ext", late="1 hour")
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["n"] for r in spark.table("w").collect()] == [3]


def test_links_are_not_followed(spark, tmp_path):
    from shelfmark.sources.scan import scan

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    for p in ("in/a.txt", "in/sub/b.txt", "out/c.txt"):
        (tmp_path / p).write_text("x")
    (tmp_path / "in/link.txt").symlink_to(tmp_path / "out/c.txt")
    (tmp_path / "in/dir").symlink_to(tmp_path / "out")
    rows = scan(spark, str(tmp_path / "in")).collect()
    assert {r["name"] for r in rows} == {"a.txt", "b.txt"} and all(r["created"] and r["accessed"] for r in rows)
    (tmp_path / "again").symlink_to(tmp_path / "in")
    assert {r["name"] for r in scan(spark, str(tmp_path / "again")).collect()} == {"a.txt", "b.txt"}


def test_listings_fit(spark):
    from shelfmark.sources.parsers import listing

    names = [f"file{i}.txt" for i in range(100)]
    assert listing("a.zip", names[:2], 500).endswith("]\nfile0.txt, file1.txt") and listing("a.zip", names, 120).endswith("…") and len(listing("a.zip", names, 120)) <= 121
    assert "비어" in listing("a.zip", [], 500) and "디렉토리만 1개" in listing("a.zip", ["d/"], 500) and listing("a.zip", ["x" * 900], 100).endswith("]\n…")
