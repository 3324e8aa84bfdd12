"""Office sources, store, event streams."""

import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.sources import office, store, uploads
from quillstone.streaming import events as S

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _p(text, style=None):
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{s}<w:r><w:t>{text}</w:t></w:r></w:p>"


def _c(text, span=1, merge=None):
    pr = (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + ({"start": '<w:vMerge w:val="restart"/>', "go": "<w:vMerge/>"}.get(merge, ""))
    return f"<w:tc><w:tcPr>{pr}</w:tcPr>{_p(text)}</w:tc>"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("office")
    table = f"<w:tbl><w:tr>{_c('Title', 2)}{_c('N')}</w:tr><w:tr>{_c('a', merge='start')}{_c('1')}{_c('2')}</w:tr><w:tr>{_c('', merge='go')}{_c('3')}{_c('4')}</w:tr></w:tbl>"
    with zipfile.ZipFile(d / "one.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{_p('Part', 'Heading1')}{_p('text')}{table}{_p('end')}</w:body></w:document>")
    cell = lambda ref, v, t="n", s=0, f="": f'<c r="{ref}" t="{t}" s="{s}">{f}' + (f"<is><t>{v}</t></is>" if t == "inlineStr" else f"<v>{v}</v>" if v is not None else "") + "</c>"
    rows = [cell("B2", "Report", "inlineStr"), cell("B3", "x", "inlineStr") + cell("C3", "2020", "inlineStr") + cell("D3", "2021", "inlineStr"), cell("B4", "zero", "inlineStr") + cell("C4", 0, s=1) + cell("D4", "-", "inlineStr"), cell("B5", "sum", "inlineStr") + cell("C5", None, f="<f>SUM(C4:C4)</f>")]
    body = "".join(f'<row r="{i}">{r}</row>' for i, r in enumerate(rows, 2))
    for name in ("two.xlsx", "copy.xlsx"):
        with zipfile.ZipFile(d / name, "w") as z:
            z.writestr(zipfile.ZipInfo("xl/workbook.xml"), f'<workbook {M}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr(zipfile.ZipInfo("xl/_rels/workbook.xml.rels"), '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr(zipfile.ZipInfo("xl/styles.xml"), f'<styleSheet {M}><numFmts><numFmt numFmtId="164" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
            z.writestr(zipfile.ZipInfo("xl/worksheets/sheet1.xml"), f'<worksheet {M}><sheetData>{body}</sheetData><mergeCells><mergeCell ref="B2:D2"/></mergeCells></worksheet>')
    (d / "note.txt").write_text("not read")
    return office.read_files(spark, str(d))


def test_docx(files):
    f = files.where("fmt = 'docx'")
    e = office.elements(f).orderBy("ordinal").collect()
    assert [r.kind for r in e] == ["heading", "paragraph", "table", "paragraph"] and e[1].heading_path == ["Part"] and e[3].paragraph == 3
    c = {(r.row_no, r.col_no): r for r in office.cells(f).collect()}
    assert len(c) == 7 and c[1, 1].col_span == 2 and c[2, 1].row_span == 2 and c[1, 1].header and not c[2, 1].header


def test_xlsx(files):
    f = files.where("fmt = 'xlsx'")
    assert f.count() == 2
    e = office.elements(f).collect()
    assert len(e) == 1 and e[0].cell_range == "B2:D5" and e[0].sheet == "S"
    c = {(r.row_no, r.col_no): r for r in office.cells(f).collect()}
    assert c[1, 1].col_span == 3 and c[1, 1].header and c[2, 2].header and not c[3, 1].header
    assert c[3, 2].value_double == 0 and c[3, 2].number_format == "0.0%" and c[4, 2].cache_status == "missing" and c[4, 2].formula == "=SUM(C4:C4)"


@pytest.mark.parametrize("fmt,want", [("General", False), ("0.00", False), ("m/d/yyyy", True), ('0 "days"', False), ("[Red]0", False), ("[h]:mm", True), ("#,##0_);(#,##0)", False), ("yyyy\\-mm", True), ("0\\d", False)])
def test_date_formats(fmt, want):
    assert office.is_date_format(fmt) == want


def test_dates_and_booleans(tmp_path):
    body = '<row r="1"><c r="A1" s="1"><v>44197</v></c><c r="B1" s="1"><v>0.25</v></c><c r="C1" t="b"><v>1</v></c><c r="D1"><v>7</v></c></row><row r="2"><c r="A2"><v>1</v></c></row>'
    for name, attr in (("a", ""), ("b", ' date1904="1"')):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {M}><workbookPr{attr}/><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/styles.xml", f'<styleSheet {M}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {M}><sheetData>{body}</sheetData></worksheet>")
    texts = lambda n: [r[6] for r in office.parse_xlsx((tmp_path / n).read_bytes(), "x" * 64)[1]]
    assert texts("a") == ["2021-01-01T00:00:00", "06:00:00", "True", "7", "1"] and texts("b")[0] == "2025-01-02T00:00:00"


def test_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from quillstone import session

    conf = SimpleNamespace(get=lambda k, d=None: d)
    ask = lambda master: session.shared_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    assert ask("local[4]").startswith("file://")
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            ask(master)


def test_zip_guard(monkeypatch, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("a", "x" * 100)
    monkeypatch.setattr(office, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        office.guarded((tmp_path / "a.docx").read_bytes())


def test_store(spark, tmp_path):
    good = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "chunk_id string, embedding array<float>")
    bad = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [3.0, 4.0]), ("c", None), ("d", [1.0])], "chunk_id string, embedding array<float>")
    assert {(r.chunk_id, r.rule) for r in store.index_violations(bad, 2).collect()} == {("a", "not of unit length"), ("a", "id used twice"), ("c", "no vector"), ("d", "other dimension")}
    s = store.Store(spark, str(tmp_path))
    assert s.current() is None
    for _ in range(3):
        s.publish(good, "m", 2)
    assert s.load("m").count() == 2 and len(list((tmp_path / "versions").iterdir())) == 2
    with pytest.raises(ValueError):
        s.publish(bad, "m", 2)
    with pytest.raises(ValueError):
        s.load("other")
    s.clear()
    assert s.current() is None


def test_bundle(spark, tmp_path):
    a = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y")], "query_id string, rank int, chunk_id string")
    got = store.export_bundle(spark, str(tmp_path / "run"), {"dense": a, "bm25": a.limit(0)})
    assert got.count() >= 1 and all(len(r.sha256) == 64 for r in got.collect()) and store.changed_files(spark, str(tmp_path / "run")).count() == 0
    one = next((tmp_path / "run/data/dense").glob("part-*.csv"))
    one.with_name(f".{one.name}.crc").unlink(missing_ok=True)
    one.write_text(one.read_text() + "more")
    (tmp_path / "run/data/extra.csv").write_text("1")
    assert {r.what for r in store.changed_files(spark, str(tmp_path / "run")).collect()} == {"altered", "new"}
    store.write_csv(a, str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith("\ufeffquery_id,rank".encode())
    (tmp_path / "a.json").write_text(json.dumps([{"i": 1}, {"i": 2}], indent=1))
    assert [r.i for r in store.read_array(spark, str(tmp_path / "a.json"), "i int").collect()] == [1, 2]


def test_dump_and_ocr(spark, tmp_path):
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("e", 1, None)], "document_id string, page int, text string")
    store.dump_pages(pages, str(tmp_path / "dump"))
    got = json.loads(next((tmp_path / "dump/document_id=d").glob("part-*")).read_text())
    assert got == [{"page": 1, "text": "a"}, {"page": 2, "text": "b"}]
    requests = spark.createDataFrame([("d", 1, bytearray(b"one two")), ("d", 2, None), ("d", 3, bytearray(b""))], "document_id string, page int, image binary")
    read = lambda image, request: [(w, [0, n, 9, n + 1], 0.5) for n, w in enumerate(image.decode().split())]
    assert [(r.page, r.ordinal, r.text, r.bbox[1]) for r in office.recognised(requests, read).orderBy("ordinal").collect()] == [(1, 0, "one", 0.0), (1, 1, "two", 1.0)]


EVENTS = [("r", 1, "progress", None), ("r", 2, "answer_delta", "wrong"), ("r", 3, "answer_reset", None), ("r", 5, "answer_delta", "lo"), ("r", 4, "answer_delta", "hel"), ("r", 4, "answer_delta", "hel"), ("r", 6, "done", None), ("s", 1, "answer_delta", "x")]


def test_fold(spark):
    df = spark.createDataFrame([(a, b, None, c, None, None, d) for a, b, c, d in EVENTS], S.SCHEMA)
    assert {r.request_id: (r.answer, r.done) for r in S.fold_answers(df).collect()} == {"r": ("hello", 1), "s": ("x", 0)}


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for n, part in enumerate((EVENTS[:4], EVENTS[4:])):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"request_id": a, "seq": b, "ts": "2024-01-01T00:00:00", "type": c, "text": d}) for a, b, c, d in part))
    ev = S.distinct_events(S.read_events(spark, str(src), 1))
    q = S.stream_answers(ev).writeStream.outputMode("update").foreachBatch(S.append_once(str(out))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.request_id, r.answer) for r in spark.read.json(str(out)).collect()] == [("r", "hello")]


def test_tool_arguments(spark):
    df = spark.createDataFrame([("r", 0, 2, '"revenue"}', False), ("r", 0, 1, '{"query":', False), ("r", 0, 3, None, True), ("r", 1, 4, "{", False)], "request_id string, call_index int, seq int, part string, finished boolean")
    got = {r.call_index: (r.arguments, r.complete) for r in S.tool_arguments(df).collect()}
    assert got == {0: ('{"query":"revenue"}', True), 1: ("{", False)}


def test_uploads(spark):
    ddl = "name string, fmt string, size bigint, document_id string"
    library = spark.createDataFrame([(f"L{i}",) for i in range(9)], "document_id string")
    ok = spark.createDataFrame([("b.pdf", "pdf", 5, "n1"), ("a.pdf", "pdf", 5, "n1"), ("c.docx", "docx", 7, "L3")], ddl)
    assert [(r.document_id, r.name) for r in uploads.accepted(ok, library).collect()] == [("n1", "a.pdf")]
    bad = spark.createDataFrame([("x.txt", "txt", 5, "1"), ("e.pdf", "pdf", 0, "2"), *((f"{i}.pdf", "pdf", 21 * 1024**2, f"3{i}") for i in range(9))], ddl)
    got = {(r.name, r.rule) for r in uploads.violations(bad, library).collect()}
    assert {("x.txt", "unknown format"), ("e.pdf", "empty"), ("0.pdf", "too large"), (None, "too many files"), (None, "too much in total"), (None, "library too large")} <= got
    assert {r.rule for r in uploads.violations(bad.limit(0), library).collect()} == {"no file"}
    with pytest.raises(ValueError, match="unknown format"):
        uploads.accepted(bad, library)
    f = spark.createDataFrame([("/in/My Report.PDF", bytearray(b"abc"))], "path string, content binary")
    r = uploads.described(f).first()
    assert (r.name, r.fmt, r.size, len(r.document_id)) == ("My Report.PDF", "pdf", 3, 64)


def test_idle_gaps(spark):
    df = spark.createDataFrame([("r", f"2024-01-01 00:00:{s}") for s in ("00", "01", "04.5", "05")] + [("s", "2024-01-01 00:00:00")], "request_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.request_id, r.heartbeats) for r in S.idle_gaps(df).collect()] == [("r", 3)]


def test_heartbeats(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    put = lambda n, *rows: (src / f"{n}.json").write_text("\n".join(json.dumps({"request_id": a, "seq": b, "ts": "2024-01-01T00:00:00", "type": c}) for a, b, c in rows))
    put(0, ("open", 1, "progress"), ("shut", 1, "progress"), ("shut", 2, "done"))
    q = S.with_heartbeats(S.read_events(spark, str(src)), 200).writeStream.outputMode("append").format("json").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start(str(out))
    try:
        got = set()
        for _ in range(90):
            time.sleep(1)
            got = {(r.request_id, r.type) for r in spark.read.schema("request_id string, type string").json(str(out)).collect()} if any(out.glob("*.json")) else set()
            if ("open", "heartbeat") in got:
                break
    finally:
        q.stop()
    assert got == {("open", "progress"), ("shut", "progress"), ("shut", "done"), ("open", "heartbeat")}
