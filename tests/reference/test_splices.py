"""Edits spliced into the bytes of sheets in one pass: the same as through tables of events."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from cellarium.plans import saving
from cellarium.sources import books, splices, xml_events
from cellarium.sources.packages import LIMITS, named_parts
from cellarium.sources.tables import stored
from tests.reference.test_saving import REL, SML, book, sheet, zipped

EDIT = "path string, part string, row long, col long, value_kind string, num double, text string, bool boolean, err string, idx long, s string"
ADDRESSES = ["A1", "b2", "C3", "AA1", "A0", "XFE1", "A9999999", "&#66;2", "&x;1", " A1", "D2 ", "", "$A1"]


def _cell(draw, q):
    attributes = draw.sample([f' r="{draw.choice(ADDRESSES)}"', " t='s'", ' s = "3"', ' x:t="b"', " y='t=\"q\" r=\"A1\"'"], draw.randrange(4))
    inside = draw.sample([f"<{q}v>1</{q}v>", f"<{q}f>A1 &lt; 2</{q}f>", "<v>x</v>", f"<{q}is><{q}t>é</{q}t></{q}is>", "text", "<!-- c -->", f"<{q}extLst><{q}v/></{q}extLst>", "<![CDATA[<c/>]]>"], draw.randrange(4))
    end = draw.choice(["", " ", "\n"])
    return f"<{q}c{''.join(attributes)}{end}/>" if not inside else f"<{q}c{''.join(attributes)}{end}>{''.join(inside)}</{q}c>"


def _sheet(draw):
    q = draw.choice(["", "", "q:"])
    row = lambda: f"<{q}row" + draw.choice(["", f' r="{draw.choice([1, 2, 3, 5, 8, 0, 1048577, "x", "&#50;"])}"', " r='4'"]) + draw.choice(["/>", " />", ">" + "".join(_cell(draw, draw.choice([q, q, q, "z:"])) for _ in range(draw.randrange(5))) + f"</{q}row>"])
    data = draw.choice(["", f"<{q}sheetData/>", *[f"<{q}sheetData>" + draw.choice(["", "\n"]).join(row() for _ in range(draw.randrange(6))) + f"</{q}sheetData>"] * 6])
    dimension = draw.choice(["", "", *[f'<{q}dimension ref{eq}"{ref}"/>' for eq, ref in (("=", "B2:C3"), (" = ", "D4"), ("=", "A1:B2:C3"), ("=", "bad"), ("=", "C3:A1"))], f"<{q}dimension/>"])
    after = "".join(draw.sample([f"<{q}pageMargins/>", "<other/>", f"<{q}row><{q}c/></{q}row>", f"<{q}sheetData><{q}row/></{q}sheetData>"], draw.randrange(3)))
    inside = dimension + draw.choice(["", "<?p q?>"]) + data + after
    return draw.choice(["", "﻿", '<?xml version="1.0"?>\n']) + (f'<{q}worksheet xmlns:q="u">{inside}</{q}worksheet>' if inside else f"<{q}worksheet />")


def _edits(draw, path):
    places = {(draw.randrange(7), draw.randrange(5)) for _ in range(draw.randrange(1, 9))}
    for row, col in sorted(places):
        kind = draw.choice(["number", "text", "text", "bool", "error", "clear", "style"])
        yield path, "/s.xml", row, col, kind, draw.choice([1.5, 1e300, -0.0, 7.0]), draw.choice(["a", " b<&> ", "\x01_x0041_", "", "é "]), True, "#REF!", draw.choice([None, 3]), draw.choice([None, None, "7", "a\"'&\\$1"])


def _zipped(body):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("s.xml", body)
    return bytearray(buffer.getvalue())


def test_random_sheets_are_spliced_as_events_are(spark):
    draw = random.Random(5)
    sources = {f"p{i}": _sheet(draw) for i in range(1500)}
    found = stored(spark.createDataFrame([(p, _zipped(s)) for p, s in sources.items()], "path string, content binary").repartition(8))
    edits = stored(spark.createDataFrame([e for p in sources for e in _edits(draw, p)], EDIT))
    events = stored(xml_events.xml_events(named_parts(found, edits.select("path", "part").distinct())))
    wanted = {r.path: bytes(r.bytes) for r in xml_events.serialize(saving.splice_cells(events.filter("_error IS NULL"), edits)).collect()}
    got = {r.path: bytes(r.bytes) for r in splices.splice_parts(found, saving.cell_pieces(edits)).collect()}
    assert len(wanted) > 1200 and wanted.keys() == got.keys()  # the others are no XML
    assert not [(sources[p], wanted[p], got[p]) for p in wanted if wanted[p] != got[p]][:3]
    assert sum(wanted[p] != sources[p].encode() for p in wanted) > 1000


def _tags_of(found):
    for name, _, at, end, empty, close, stop, depth, node, parent in found:
        if name is None:
            yield "End", close, stop, depth, node
        else:
            yield "Start", at, end, name.decode(), empty, depth, node, parent
            if close >= 0 and not empty:
                yield "End", close, stop, depth, node


@pytest.mark.parametrize("limits", [{}, {"depth": 3}, {"nodes": 6}, {"attrs": 1}])
def test_tags_are_those_of_events(limits):
    """Over random texts, mostly faulty: the same tags, or the same fault."""
    draw, limits = random.Random(3), LIMITS | limits
    pieces = [b"<a>", b"<a>", b"</a>", b"</a>", b"<a/>", b"<b x='1' y = \"<\">", b"<b x='1'\n y='=2'/>", b'<b x="1" x="2">', b"</b >", b"<b>t</b>", b"<c><a/></c>", b"t", b" ", b"\xc3\xa9", b"\xff", b"<!-- <a> -->", b"<![CDATA[<a>]]>", b"<?p <a>?>", b"<!DOCTYPE a>", b"<", b"&amp;", b"</bb>"]
    good = 0
    for _ in range(20_000):
        inside = b"".join(draw.choices(pieces, [3, 3, 3, 3, 3, 0.2, 1, 0.2, 1, 3, 2, 3, 2, 1, 0.1, 1, 0.5, 1, 0.1, 0.1, 1, 0.1], k=draw.randrange(9)))
        content = draw.choice([b"", b"\xef\xbb\xbf", b"<?xml version='1.0'?>", b"x"]) + draw.choice([b"<a>%s</a>", b"%s"]) % inside + draw.choice([b"", b"\n", b"x"])
        both = []
        for read in (lambda: [("Start", e[2], e[3], e[4], e[5], e[6], e[7], e[8]) if e[1] == "Start" else ("End", e[2], e[3], e[6], e[7]) for e in xml_events._events(content, limits) if e[1] in ("Start", "End")], lambda: list(_tags_of(splices._tags(content, limits)))):
            try:
                both.append(read())
            except ValueError as e:
                both.append("NotUtf8" if isinstance(e, UnicodeDecodeError) else str(e))
        assert both[0] == both[1], content
        good += isinstance(both[0], list)
    assert good > 1000


def test_parts_with_faults(spark):
    bodies = {"good": "<a/>", "cut": "<a>", "type": "<!DOCTYPE a><a/>", "twice": '<a b="1" b="2"/>', "latin": b"<a>\xe9</a>"}
    found = spark.createDataFrame([(p, _zipped(b)) for p, b in bodies.items()], "path string, content binary")
    asked = found.select("path", F.lit("/s.xml").alias("part"))
    faults = {r.path: r._fault for r in splices.part_faults(found, asked).collect()}
    assert faults == {r.path: r._error for r in xml_events.xml_events(named_parts(found, asked)).filter("_error IS NOT NULL").collect()}
    assert faults == {"cut": "Malformed", "type": "Doctype", "twice": "DuplicateAttribute", "latin": "NotUtf8"}


def test_sheets_are_named_without_their_cells(spark):
    found = spark.createDataFrame([("p", _zipped("<worksheet><sheetData>" + "<row><c/></row>" * 9 + "</sheetData></worksheet>"))], "path string, content binary")
    assert [(r.part, r.kind) for r in books.book_rows(found, kinds={"sheet", "node", "item"}).collect()] == [("/s.xml", "sheet")]
    assert books.book_rows(found).filter("kind = 'cell'").count() == 9


def test_fonts_of_a_sheet_that_ends_too_soon(spark):
    """Refused with what is wrong with the part, and the package stays as it was; the other one is changed."""
    styles = f'<styleSheet xmlns="{SML}"><fonts count="1"><font><sz val="11"/></font></fonts><cellXfs count="1"><xf fontId="0"/></cellXfs></styleSheet>'
    made = {}
    whole = sheet('<row r="1"><c r="A1"/></row>')
    for name, body in (("good", whole), ("cut", whole.replace("</sheetData></worksheet>", ""))):
        base = zipfile.ZipFile(io.BytesIO(bytes(book([body]))))
        members = {n: base.read(n).decode() for n in base.namelist()} | {"xl/styles.xml": styles}
        members["xl/_rels/book.xml.rels"] = members["xl/_rels/book.xml.rels"].replace("</Relationships>", f'<Relationship Id="y" Type="{REL}/styles" Target="styles.xml"/></Relationships>')
        made[name] = bytes(zipped(**members))
    found = spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "path string, content binary")
    edits = spark.createDataFrame([(k, 0, 0, 0, None, 9.0, None, None, None) for k in made], "path string, sheet int, row int, col int, name string, size double, bold boolean, italic boolean, underline boolean")
    saved, refused = saving.save_fonts(found, edits)
    assert [(r.path, r._error) for r in refused.collect()] == [("cut", "Malformed")]
    after = {r.path: bytes(r.content) for r in saved.collect()}
    assert after["cut"] == made["cut"] and b'<c r="A1" s="1"/>' in zipfile.ZipFile(io.BytesIO(after["good"])).read("xl/sheets/sheet1.xml")
