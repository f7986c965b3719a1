"""Readers on files made here."""

import io
import json
import zipfile
import zlib

import pytest

from proofline.sources import readers as R
from proofline.sources import tables as S


def packed(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return b.getvalue()


XLSX = packed({
    "xl/workbook.xml": '<workbook xmlns="u"><sheets><sheet name="Plan"/></sheets></workbook>',
    "xl/sharedStrings.xml": '<sst xmlns="u"><si><t>Tag</t></si><si><t>Value</t></si><si><t>V-1</t></si><si><t>Only a note</t></si></sst>',
    "xl/worksheets/sheet1.xml": '<worksheet xmlns="u"><sheetData><row r="1"><c r="A1" t="s"><v>3</v></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c></row>'
    '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>1.0</v></c></row><row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4"><f>1+1</f></c></row></sheetData></worksheet>',
})
DOCX = packed({
    "word/document.xml": '<w:document xmlns:w="u"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t><w:t>prose.</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>key</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>val</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    "<w:tbl><w:tr><w:tc><w:t>A</w:t></w:tc><w:tc><w:t>B</w:t></w:tc><w:tc><w:t>C</w:t></w:tc></w:tr><w:tr><w:tc><w:t>1</w:t></w:tc><w:tc><w:t></w:t></w:tc><w:tc><w:t>3</w:t></w:tc></w:tr></w:tbl></w:body></w:document>",
})
PDF = b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(b"BT (Title line) Tj T* [(sec) -2 (ond \\(x\\))] TJ ET") + b"\nendstream\n2 0 obj\n<< /Length 9 >>\nstream\nBT (Page two) Tj ET\nendstream"
EML = b"From: a@x\nTo: b@x\nSubject: Levels\nDate: Mon, 02 Mar 2026 10:00:00 +0000\n\nNewest words.\n\n-----Original Message-----\nFrom: b@x\nSent: Sunday, March 1, 2026 09:00\n\nOlder words.\n> On Sat, Jan 3, 2026, c wrote:\n> oldest\n"


def test_readers():
    read = {p: R.read_one(p, d) for p, d in {"a.xlsx": XLSX, "a.docx": DOCX, "noext": PDF, "m.eml": EML, "x.png": b"\x89PNG", "bad.json": b"{", "bad.xlsx": b"PK\3\4x", "e.csv": b"\n", "z": b"\0\1"}.items()}
    assert [c[1] for c in read["a.xlsx"][4]] == ["Only a note", "Tag: V-1 | Value: 1", "formula without a stored value", "Tag: V-1"] and read["a.xlsx"][1] == "partial"
    assert [c[1] for c in read["a.docx"][4]] == ["Scope", "Some prose.", "key: val", "A: 1 | C: 3"] and read["a.docx"][3] == "Scope"
    assert [c[:2] for c in read["noext"][4]] == [("page 1, lines 1-2", "Title line\nsecond (x)"), ("page 2, line 1", "Page two")]
    assert [c[1] for c in read["m.eml"][4]] == ["Newest words.", "Older words.", "oldest"] and ("Sent", "Sunday, March 1, 2026 09:00") in read["m.eml"][4][1][3]
    for p in ("x.png", "bad.json", "bad.xlsx", "e.csv", "z"):
        assert read[p][1] == "unread" and read[p][2]


def pdf_of(*objects):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects) + b"trailer << /Root 1 0 R /Info 20 0 R >>\n"


def stream(data, head=b"", squeeze=True):
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), head, b"/Filter /FlateDecode" if squeeze else b"", zlib.compress(data) if squeeze else data)


def test_pdf():
    """Pages in the order of the tree, fonts with maps of their own, objects in streams, a damaged page, one without text."""
    cmap = b"2 beginbfchar <0001> <0048> <0002> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfrange <0020> <0021> [<0066> <00660069>] endbfrange"
    inner = [(10, b"<< /Type /Page /Contents [11 0 R 12 0 R] /Resources << /Font << /F1 13 0 R >> >> >>"), (13, b"<< /Subtype /Type0 /ToUnicode 14 0 R >>")]
    at, starts = 0, []
    for _, o in inner:
        starts.append(at)
        at += len(o) + 1
    header = b" ".join(b"%d %d" % (n, a) for (n, _), a in zip(inner, starts, strict=True)) + b" "
    data = pdf_of(
        (1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [10 0 R 3 0 R 4 0 R 5 0 R 2 0 R] /Resources << /Font << /F2 15 0 R >> >> >>"), (3, b"<< /Type /Page /Contents 16 0 R >>"),
        (4, b"<< /Type /Page /Contents 17 0 R >>"), (5, b"<< /Type /Page /Contents 18 0 R >>"),
        (9, stream(header + b" ".join(o for _, o in inner), b"/Type /ObjStm /N 2 /First %d" % len(header))),
        (11, stream(b"BT /F1 12 Tf 1 0 0 1 50 700 Tm <00010002> Tj 1 0 0 1 90 700 Tm [<0010> -20 <0011> -400 <0020 0021>] TJ")), (12, stream(b"0 -14 Td <0012> Tj ET", squeeze=False)), (14, stream(cmap)), (15, b"<< /Subtype /Type1 >>"),
        (16, stream(b"BT /F2 9 Tf (1. Scope \\(a\\051) Tj T* (more) Tj T* (AC-01 - an item) Tj 30 0 Td (cell) ' ET")), (17, b"<< /Filter /FlateDecode >>\nstream\nnot deflate\nendstream"), (18, stream(b"0 0 m 9 9 l S")),
        (20, b"<< /Title <FEFF0041002000E9> >>"),
    )
    fmt, status, reason, title, chunks = R.read_one("a.pdf", data)
    assert (fmt, status, reason, title) == ("pdf", "partial", "2 pages without text", "A é")
    assert [c[:2] for c in chunks[:3]] == [("page 1, lines 1-2", "Hé ab ffi\nc"), ("page 2, lines 1-2", "1. Scope (a)\nmore"), ("page 2, lines 3-4", "AC-01 - an item\ncell")]
    assert [(c[0], c[2]) for c in chunks[3:]] == [("page 3", "problem"), ("page 4", "problem")] and chunks[4][1] == "no text"
    assert R.read_one("a.pdf", data.replace(b"trailer <<", b"trailer << /Encrypt 30 0 R"))[1:3] == ("unread", "encrypted")
    assert R.read_one("a.pdf", b"%PDF-1.4\n")[1:3] == ("unread", "no text layer")


def test_csv_profile():
    fmt, status, _, _, chunks = R.read_one("d.csv", "﻿time_s,level,state\n0,1.5,on\n10,2,off\n\n20,,on,x\n".encode())
    said = [c[1] for c in chunks]
    assert (fmt, status) == ("csv", "read") and said[0].split("\n")[2:] == ["rows: 3", "time span: time_s from 0 to 20", "rows with another number of cells than the header: 1"]
    assert said[2] == "column level: numeric, min 1.5, max 2, first 1.5, last 2" and said[3] == "column state: text, 2 distinct: on, off; first on, last on"


def test_json_and_markdown():
    big = {"a": {"x": 1.0, "y": None, "z": "t"}, "b": ["w" * 500, "v" * 500]}
    chunks = R.read_one("j.json", json.dumps(big).encode())[4]
    assert [c[0] for c in chunks] == ["$.a", "$.b[0]", "$.b[1]"] and chunks[0][3] == [("x", "1"), ("z", "t")]
    md = b"# Title\n\npara one\nmore\n\n- item\n\n| A | B |\n|---|---|\n| 1 | 2 |\n"
    assert [(c[0], c[1], c[2]) for c in R.read_one("m.md", md)[4]] == [("line 1", "# Title", "heading"), ("lines 3-4", "para one\nmore", "paragraph"), ("line 6", "- item", "list_item"), ("line 10", "A: 1 | B: 2", "table_row")]
    assert [c[0] for c in R.read_one("c.mo", b"model X\nend X;\n\nmodel Y\n")[4]] == ["lines 1-2", "line 4"]
    long = "\n".join("w" * 100 for _ in range(20)).encode()
    assert all(len(c[1]) <= 900 for c in R.read_one("l.txt", long)[4])


def test_scan(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for n, d in {"a b.txt": b"one\n\ntwo", "a-b.txt": b"x", "sub/p.pdf": PDF, "u.bin": b"\0\0"}.items():
        (tmp_path / "in" / n).write_bytes(d)
    rows = R.scan(spark, str(tmp_path / "in")).collect()
    ids = {r.path: r.source_id for r in rows}
    assert ids == {"a b.txt": "a_b_txt", "a-b.txt": "a_b_txt_2", "sub/p.pdf": "sub_p_pdf", "u.bin": "u_bin"}
    assert {(r.source_id, r.status) for r in rows if r.text is None} == {("u_bin", "unread")}
    assert R.sources(R.scan(spark, str(tmp_path / "in"))).where("status = 'read'").count() == 3
    assert [r.text for r in R.text_source(spark, "a\n\nb").orderBy("pos").collect()] == ["a", "b"]


def test_tables(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("time_s,level,state\n0,1,on\n5,2,off\n5,3\n")
    long = {(r.column, r.t, r.cell) for r in S.unpivoted(spark, str(p)).collect()}
    assert ("state", 5.0, "") in long and len(long) == 6
    with pytest.raises(Exception, match="not a number"):
        S.trace(spark, str(p)).collect()
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "k1.json").write_text(json.dumps({"model": "m", "schema": "s", "response": "x"}))
    (tmp_path / "r" / "k2.json").write_text("{")
    got = S.replies(spark, str(tmp_path / "r"))
    assert [r.key for r in got.collect()] == ["k1"]
    assert [r.key for r in S.misses(spark.createDataFrame([("k1",), ("k2",)], "key string"), got).collect()] == ["k2"]
    y = tmp_path / "c.yaml"
    y.write_text("kinds:\n  tank:\n    parameters: [area, height]\n    defaults: {area: 2}\n    ports: [{role: inlet, direction: in, domain: fluid}]\n")
    dims = S.catalogue(spark, str(y))
    assert {(r.name, r.default) for r in dims["kind_params"].collect()} == {("area", 2.0), ("height", None)} and dims["kind_ports"].count() == 1
    assert S.settings({"limit": 2.0, "on": False}, {"PROOFLINE_LIMIT": "3"}) == {"limit": 3.0, "on": False}
    with pytest.raises(ValueError, match="PROOFLINE_ON"):
        S.settings({"on": False}, {"PROOFLINE_ON": "maybe"})
    assert S.artefacts([("ir", "loaded", None)], ["ir", "plots"], spark).where("state = 'missing'").count() == 1
    ref = spark.createDataFrame([("csv", "reference_data", "a"), ("csv", "register", "b")], "format string, role string, path string")
    assert S.find_reference(ref).first().path == "a" and S.find_reference(ref.union(ref)).first().reason
    S.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "n int, line string"), str(tmp_path / "out"), ["n"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b"]


@pytest.mark.parametrize("name", ["read_markdown_files", "read_mail_files", "text_fixes"])
def test_a_small_file_of_many_rows_is_dealt(spark, sf, name):
    from pyspark.sql import functions as F

    from proofline.plans import QUERIES

    tasks = QUERIES[name](spark, sf).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_batches_of_chunks(spark, monkeypatch):
    """Chunks of several files share a batch, and a batch may end within the files."""
    from proofline.sources import readers

    files = [(f"in/{i}.md", bytearray(f"# T{i}\n\n- a\n\nb {i}\n".encode() if i % 3 else b""), str(i)) for i in range(40)]
    df = spark.createDataFrame(files, "path string, content binary, source_id string").coalesce(1)
    want = sorted((str(i), k, x) for i in range(40) for k, x in ([("heading", f"# T{i}"), ("list_item", "- a"), ("paragraph", f"b {i}")] if i % 3 else [(None, None)]))
    for most in (5000, 7):
        monkeypatch.setattr(readers, "MAX_ROWS", most)
        assert sorted(((r.source_id, r.kind, r.text) for r in readers.chunk_rows(df).collect()), key=repr) == sorted(want, key=repr)


def test_replies_are_written_by_several_tasks(spark, sf, tmp_path, monkeypatch):
    from proofline.plans import QUERIES, further_queries

    monkeypatch.setattr(further_queries, "new_path", lambda spark, what: f"file://{tmp_path}/{what}")
    assert QUERIES["replies_read"](spark, sf).count() == spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert len({p.name.split("-")[1] for p in (tmp_path / "replies").glob("part-*.json")}) > 1
