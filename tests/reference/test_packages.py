"""Packages made, read, damaged and streamed."""

import io
import zipfile

import pytest

from pyspark.sql import functions as F

from cellarium.operators import grid, package_edits, style_edits
from cellarium.plans import workbook
from cellarium.sources import packages, sheets, writer, xml_events
from cellarium.streaming.ingest import ingest_entries

SML = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def part_of(spark, body):
    return spark.createDataFrame([("p", "/s", body)], "path string, part string, bytes binary")


def cells_of(spark, body, strings=("первая",)):
    raw = sheets.sheet_cells(part_of(spark, f'<worksheet xmlns="{SML}"><sheetData>{body}</sheetData></worksheet>'.encode()))
    sst = spark.createDataFrame([("p", i, s) for i, s in enumerate(strings)], "path string, idx long, text string")
    return {(r.row, r.col): r for r in workbook.typed_cells(raw, sst).collect()}


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<row><c><v>8</v></c><c/></row><row/><row><c><v>9</v></c></row>", {(0, 0), (0, 1), (2, 0)}),
        ('<row r="4"><c/><c r="F4"/><c/></row>', {(3, 0), (3, 5), (3, 6)}),
        ('<row r="20"><c r="D20"/></row><row r="7"><c r="B7"/></row><row><c/></row>', {(19, 3), (6, 1), (7, 0)}),
        ('<row r="5"/><row><c/></row>', {(5, 0)}),
        ('<row><c r="C9"/><c/></row><row><c/></row>', {(8, 2), (0, 3), (1, 0)}),
    ],
)
def test_implicit_positions(spark, body, want):
    assert set(cells_of(spark, body)) == want


def test_types_and_faults(spark):
    body = '<row><c><v>2.5</v></c><c t="s"><v>0</v></c><c t="str"><v>r_x0041_</v></c><c t="b"><v> 1 </v></c><c t="e"><v>#NUM!</v></c><c t="inlineStr"><is><r><t>in</t></r><r><t>to</t></r><rPh><t>no</t></rPh></is></c><c t="d"><v>2021-03-04</v></c><c s="3"/><c t="wat"/><c t="s"><v>7</v></c><c><v>x</v></c><c r="XFE1"/><c t="b"><v>7</v></c><c t="e"><v>#WHAT</v></c><c s="x"/><c t="inlineStr"><v>plain</v></c><c t="inlineStr"><is><t>a_x0009_b</t></is></c></row><row r="0"><c><v>1</v></c></row><row r="x"/>'
    got = cells_of(spark, body)
    assert [got[0, i].value_kind for i in range(8)] == ["number", "text", "text", "bool", "error", "text", "text", "empty"]
    assert (got[0, 0].num, got[0, 1].text, got[0, 2].text, got[0, 3].bool, got[0, 4].err, got[0, 5].text, got[0, 6].text, got[0, 7].style) == (2.5, "первая", "r_x0041_", True, "#NUM!", "into", "2021-03-04", 3)
    assert [got[0, i]._error for i in (8, 9, 10)] == ["UnknownCellType", "SharedStringOutOfRange", "BadNumber"]
    assert [got[0, i]._error for i in (12, 13, 14)] == ["BadBool", "UnknownError", "BadStyle"] and got[0, 15].text == "plain"
    raw = sheets.sheet_cells(part_of(spark, f"<worksheet><sheetData>{body}</sheetData></worksheet>".encode()))
    assert sorted(r._error for r in raw.collect() if r._error) == ["BadCellRef", "BadRowNumber", "BadRowNumber"]


def test_formulas_of_groups(spark):
    body = '<row r="1"><c><f t="shared" si="0" ref="A1:A3">B1*$C$1</f><v>1</v></c><c><f t="array">SUM(A1:A2)</f></c><c><f>A1</f></c></row><row r="3"><c><f t="shared" si="0"/></c><c><f t="shared">A2</f></c><c><f ref="Q">A1</f></c></row>'
    raw = sheets.sheet_cells(part_of(spark, f"<worksheet><sheetData>{body}</sheetData></worksheet>".encode()))
    cells = workbook.typed_cells(raw, spark.createDataFrame([], "path string, idx long, text string"))
    got = {(r.row, r.col): r for r in workbook.expand_shared(cells.withColumn("follows", workbook.is_shared_follower(cells))).collect()}
    assert [got[x].f_kind for x in ((0, 0), (0, 1), (0, 2), (2, 0), (2, 1))] == ["shared", "array", "normal", "shared", "normal"]
    assert got[2, 0].f_text == "B3*$C$1" and got[2, 0].follows and not got[0, 0].follows and got[2, 2]._error == "BadFormula"
    assert tuple(got[0, 1].f_range) == (0, 1, 0, 1) and tuple(got[0, 0].f_range) == (0, 0, 2, 0)
    stats = workbook.sheet_stats(raw, ["path"]).collect()[0]
    assert (stats.rows, stats.rows_without_r, stats.cells, stats.cells_without_r, stats.formulas, stats.max_row, stats.max_col) == (2, 0, 6, 6, 6, 2, 2)


def test_long_sheets_come_in_batches(spark):
    body = "".join(f"<row><c><v>{i}</v></c></row>" for i in range(50_000))
    got = sheets.sheet_cells(part_of(spark, f"<worksheet><sheetData>{body}</sheetData></worksheet>".encode()))
    assert got.filter("row = cast(v as int) AND col = 0").count() == 50_000


def test_shared_strings(spark):
    xml = f'<sst xmlns="{SML}"><si><t xml:space="preserve"> one</t></si><si><r><t>де</t></r><r><t>ло</t></r></si><si><t>北京</t><rPh sb="0" eb="1"><t>x</t></rPh></si><si/></sst>'.encode()
    items = workbook.shared_strings(sheets.string_items(part_of(spark, xml)))
    assert [(r.idx, r.text, r.runs, r.preserved, r.simple) for r in items.orderBy("idx").collect()] == [(0, " one", 1, 1, True), (1, "дело", 2, 0, False), (2, "北京", 1, 0, True), (3, "", 0, 0, False)]


def test_books_of_any_part_names(spark):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = lambda *r: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{rel}/{t}" Target="{x}"/>' for i, t, x in r) + "</Relationships>"
    members = {
        "_rels/.rels": rels(("a", "officeDocument", "main/Book.xml")),
        "main/Book.xml": f'<!-- c --><workbook xmlns="{SML}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="s"/></sheets></workbook>',
        "main/_rels/Book.xml.rels": rels(("s", "worksheet", "one.xml"), ("t", "sharedStrings", "texts.xml")),
        "main/one.xml": f'<x:worksheet xmlns:x="{SML}"><x:sheetData><x:row><x:c t="s"><x:v>0</x:v></x:c></x:row></x:sheetData></x:worksheet>',
        "main/texts.xml": f'<sst xmlns="{SML}"><si><t>hello</t></si></sst>',
        "main/unlisted.xml": f'<worksheet xmlns="{SML}"><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>',
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    df = spark.createDataFrame([("good", bytearray(buffer.getvalue())), ("bad", bytearray(b"no"))], "path string, content binary")
    got = workbook.read_cells(df).collect()
    assert [(r.path, r.text, r.sheet_name, r.sheet) for r in got if r._error is None] == [("good", "hello", "S", 0)]
    assert [(r.path, r._error) for r in got if r._error] == [("bad", "BadZipFile")]


def book_cells(spark):
    rows = [("p", 0, 0, 0, "s", "text", None, "a & b\x01_x0041_", None), ("p", 0, 0, 2, "n", "number", -0.25, None, None), ("p", 0, 3, 1, "b", "bool", None, None, True), ("p", 1, 5, 0, "n", "empty", None, None, None), ("q", 0, 1, 1, "s", "text", None, "é", None)]
    return spark.createDataFrame(rows, "path string, sheet int, row int, col int, ty string, value_kind string, num double, text string, bool boolean")


def test_package_round_trip(spark):
    cells = book_cells(spark)
    back = workbook.read_cells(writer.build_packages(cells))
    key = lambda r: (r.path, r.row, r.col, r.value_kind, r.num, r.text, r.bool)
    assert sorted(map(str, map(key, back.collect()))) == sorted(map(str, map(key, cells.collect())))


def test_damaged_archives_are_rows_with_errors(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/", "")
        z.writestr("xl/a.xml", "<a/>")
        z.writestr("bomb.xml", "x" * 1_000_000)
    good = buffer.getvalue()
    df = spark.createDataFrame([("good", bytearray(good)), ("cut", bytearray(good[:-30])), ("none", None), ("text", bytearray(b"no archive"))], "path string, content binary")
    got = packages.entries(df).collect()
    assert [(r.name, r.is_dir) for r in got if r.path == "good"] == [("xl/", True), ("xl/a.xml", False), ("bomb.xml", False)]
    assert {r.path: r._error for r in got if r._error} == {"cut": "BadZipFile", "none": "BadZipFile", "text": "BadZipFile"}
    parts = {(r.path, r.part): r for r in packages.parts(df, ".*xml").collect()}
    assert bytes(parts["good", "/xl/a.xml"].bytes) == b"<a/>" and parts["good", "/bomb.xml"]._error == "LimitRatio"


def test_xml_faults(spark):
    cases = {"ok": b"<a><b x='1'/>t</a>", "doctype": b"<!DOCTYPE a><a/>", "bad": b"<a><b></a>", "deep": b"<a>" * 300 + b"</a>" * 300, "empty": b""}
    df = spark.createDataFrame([("p", k, bytearray(v)) for k, v in cases.items()], "path string, part string, bytes binary")
    got = packages.xml_nodes(df).collect()
    assert {r.part: r._error for r in got if r._error} == {"doctype": "Doctype", "bad": "Malformed", "deep": "LimitDepth", "empty": "Malformed"}
    assert [(r.local, r.depth, r.text, r.attrs) for r in got if r.part == "ok"] == [("a", 0, "t", {}), ("b", 1, "", {"x": "1"})]


def archive(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name.replace("_", "/"), body)
        z.comment = b"note"
    return b"front" + buffer.getvalue()


def test_saving_keeps_all_else(spark):
    content = archive(a_x="one" * 50, b="two", c="three")
    found = spark.createDataFrame([("p", bytearray(content)), ("same", bytearray(content)), ("bad", bytearray(b"x"))], "path string, content binary")
    edits = spark.createDataFrame([("p", "/B", bytearray(b"new")), ("p", "/c", None), ("p", "/d.xml", bytearray(b"fresh")), ("bad", "/d", bytearray(b"q"))], "path string, part string, bytes binary")
    got = {r.path: r for r in writer.save_packages(found, edits).collect()}
    assert bytes(got["same"].content) == content and got["bad"]._error and bytes(got["bad"].content) == b"x"
    made = zipfile.ZipFile(io.BytesIO(bytes(got["p"].content)))
    assert made.testzip() is None and made.comment == b"note" and {n: made.read(n) for n in made.namelist()} == {"a/x": b"one" * 50, "b": b"new", "d.xml": b"fresh"}
    old = zipfile.ZipFile(io.BytesIO(content)).infolist()[0]
    at = packages.extent(content, old)
    assert content[old.header_offset : at[2]] in bytes(got["p"].content)
    assert writer.rewritten(content, {}) == content


def test_archive_gaps(spark):
    whole = archive(a="1", b="2")
    df = spark.createDataFrame([("p", bytearray(whole + b"tail"))], "path string, content binary")
    got = [(r.kind, r.end - r.start) for r in packages.archive_gaps(packages.entries(df)).collect()]
    assert sorted(got) == [("prefix", 5), ("trailing", 4)] and packages.entries(df).first().prefix == 5


def test_xml_events_and_edits(spark):
    source = """<?xml version="1.0"?>\n<!--c--><a x = '1' y="&lt;&#65;"><b/>t&amp;<![CDATA[<]]><d k="v"><e>1</e></d></a>\n"""
    events = xml_events.xml_events(part_of(spark, source.encode()))
    rows = events.orderBy("seq").collect()
    assert [r.kind for r in rows] == ["Decl", "Text", "Comment", "Start", "Start", "Text", "CData", "Start", "Start", "Text", "End", "End", "End", "Text"]
    assert "".join(r.raw for r in rows) == source and xml_events.tiling(events).first().tiled
    assert [r.level for r in xml_events.depths(events).orderBy("seq").collect()] == [r.depth if r.kind != "Text" or r.parent_id is not None else 0 for r in rows]
    assert [(r.qname, r.value, r.quote) for r in xml_events.attributes(events).orderBy("node_id", "ord").collect()] == [("x", "1", "'"), ("y", "<A", '"'), ("k", "v", '"')]
    text = lambda e: bytes(xml_events.serialize(e).first().bytes).decode()
    assert text(events) == source
    edits = spark.createDataFrame([("p", "/s", 0, "x", 'a"$1\'b'), ("p", "/s", 0, "z", "9"), ("p", "/s", 1, "n", "&"), ("p", "/s", 2, "k", None)], "path string, part string, node_id long, qname string, value string")
    assert text(xml_events.set_attributes(events, edits)) == source.replace("'1'", "'a\"$1&apos;b'").replace('&#65;"', '&#65;" z="9"').replace("<b/>", '<b n="&amp;"/>').replace('<d k="v">', "<d>")
    one = lambda node, **more: spark.createDataFrame([("p", "/s", node, *more.values())], "path string, part string, node_id long" + "".join(f", {k} string" for k in more))
    assert text(xml_events.set_texts(events, one(1, value="<n>"))) == source.replace("<b/>", "<b>&lt;n&gt;</b>")
    assert text(xml_events.set_texts(events, one(2, value="n"))) == source.replace("<e>1</e>", "n")
    assert text(xml_events.remove_nodes(events, one(2))) == source.replace('<d k="v"><e>1</e></d>', "")
    assert xml_events.subtrees(events, one(2)).first().xml == '<d k="v"><e>1</e></d>'
    assert text(xml_events.append_children(events, one(1, xml="<q/>"))) == source.replace("<b/>", "<b><q/></b>")
    assert text(xml_events.insert_before(events, one(2, xml="<q/>"))) == source.replace("<d k", "<q/><d k")


@pytest.mark.parametrize(("source", "fault"), [(b"<a><b></a>", "Malformed"), (b"<a x='1' x='2'/>", "DuplicateAttribute"), (b"<!DOCTYPE a><a/>", "Doctype"), (b"<a/><b/>", "Malformed"), (b"", "Malformed"), (b"<a>\xff</a>", "NotUtf8"), (b"<a" * 300, "Malformed"), (b"<a>" * 300, "LimitDepth")])
def test_xml_event_faults(spark, source, fault):
    assert [r._error for r in xml_events.xml_events(part_of(spark, source)).collect()] == [fault]


def test_font_edits(spark):
    cells = spark.createDataFrame([("p", 0, 0, 0, "n", "number", 1.0, 1), ("p", 0, 0, 1, "n", "empty", None, None)], "path string, sheet int, row int, col int, ty string, value_kind string, num double, style long")
    xfs = spark.createDataFrame([("p", 0, 0, 0, 0, 0, True, True, True), ("p", 1, 14, 1, 0, 0, True, True, True)], "path string, style long, num_fmt_id long, font_id long, fill_id long, border_id long, apply_font boolean, apply_fill boolean, apply_border boolean")
    fonts = spark.createDataFrame([("p", 0, "Sans", 11.0, False, False, False, False, None), ("p", 1, "Serif", 9.0, True, False, False, False, "#ff0000")], "path string, font_id int, name string, size double, bold boolean, italic boolean, underline boolean, strike boolean, color string")
    edits = spark.createDataFrame([("p", 0, 0, 0, None, 12.0, None, True, None), ("p", 0, 0, 1, None, None, True, None, None), ("p", 0, 5, 5, None, None, True, None, None), ("p", 0, 6, 6, " ", None, None, None, None), ("p", 0, 7, 7, None, 500.0, None, None, None), ("p", 0, 8, 8, None, 11.0, False, None, None)], "path string, sheet int, row int, col int, name string, size double, bold boolean, italic boolean, underline boolean")
    out, formats, all_fonts, refused = style_edits.edit_fonts(cells, xfs, fonts, edits)
    made = {r.font_id: (r.name, r.size, r.bold, r.italic) for r in all_fonts.collect()}
    known = {r.style: r for r in formats.collect()}
    got = {(r.row, r.col): r for r in out.collect()}
    shown = lambda at: made[known[got[at].style].font_id]
    assert shown((0, 0)) == ("Serif", 12.0, True, True) and known[got[0, 0].style].num_fmt_id == 14 and got[0, 0].num == 1.0
    assert shown((0, 1)) == shown((5, 5)) == ("Sans", 11.0, True, False) and got[0, 1].style == got[5, 5].style and got[5, 5].value_kind == "empty"
    assert got[8, 8].style == 0 and len(made) == 4 and len(known) == 4 and (6, 6) not in got
    assert sorted(r._error for r in refused.collect()) == ["BadFontName", "BadFontSize"]


def test_marks_of_recalculation(spark):
    cases = {
        f'<workbook xmlns="{SML}"><calcPr calcId="7" calcMode="manual"/></workbook>': f'<workbook xmlns="{SML}"><calcPr calcMode="manual" calcId="0" fullCalcOnLoad="1"/></workbook>',
        "<x:workbook xmlns:x='u'><x:sheets/><x:extLst>q</x:extLst></x:workbook>": "<x:workbook xmlns:x='u'><x:sheets/><x:calcPr calcId=\"0\" fullCalcOnLoad=\"1\"/><x:extLst>q</x:extLst></x:workbook>",
        "<workbook><sheets/></workbook>\n": '<workbook><sheets/><calcPr calcId="0" fullCalcOnLoad="1"/></workbook>\n',
    }
    df = spark.createDataFrame([(a,) for a in cases], "t string")
    assert [r.m for r in df.select(package_edits.mark_full_recalc(F.col("t")).alias("m")).collect()] == list(cases.values())


def test_edits(spark):
    cells = book_cells(spark).filter("path = 'p'")
    edits = spark.createDataFrame([("p", 0, 0, 0, 1, "number", 5.0, None, None), ("p", 0, 0, 0, 2, "text", None, "new", None), ("p", 0, 9, 9, 1, "clear", None, None, None), ("p", 0, 3, 1, 1, "clear", None, None, None), ("p", 0, 7, 7, 1, "bool", None, None, False)], "path string, sheet int, row int, col int, ord int, value_kind string, num double, text string, bool boolean")
    got = {(r.sheet, r.row, r.col): (r.value_kind, r.text, r.bool) for r in grid.merge_edits(cells, edits).collect()}
    assert got[0, 0, 0] == ("text", "new", None) and got[0, 3, 1] == ("empty", None, None) and got[0, 7, 7] == ("bool", None, False) and (0, 9, 9) not in got and len(got) == 5


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, r in [(r.path, bytes(r.content)) for r in writer.build_packages(book_cells(spark)).collect()]:
        (tmp_path / "in" / f"{name}.xlsx").write_bytes(r)
    for _ in range(2):  # the second run finds nothing new
        ingest_entries(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 13
