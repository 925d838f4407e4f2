"""Edits of cells that reach the bytes of packages."""

import io
import re
import zipfile

import pytest

from cellarium.plans import workbook
from cellarium.plans.saving import save_cells, save_fonts
from cellarium.sources.tables import stored

SML = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006"
EDIT = "path string, sheet int, row long, col long, ord int, value_kind string, num double, text string, bool boolean, err string"


def zipped(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return bytearray(buffer.getvalue())


def book(sheets, strings=None, extra="", chain=False, names=("sheet1", "sheet2")):
    """A package of whole sheet parts; strings: the inside of its table."""
    rels = [(f"s{i}", "worksheet", f"sheets/{names[i]}.xml") for i in range(len(sheets))] + ([("t", "sharedStrings", "sharedStrings.xml")] if strings is not None else []) + ([("c", "calcChain", "calcChain.xml")] if chain else [])
    members = {
        "[Content_Types].xml": f'<Types xmlns="{PKG}/content-types"><Default Extension="xml" ContentType="application/xml"/>' + ('<Override PartName="/xl/calcChain.xml" ContentType="x/calcChain"/>' if chain else "") + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{PKG}/relationships"><Relationship Id="r" Type="{REL}/officeDocument" Target="xl/book.xml"/></Relationships>',
        "xl/book.xml": f'<workbook xmlns="{SML}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="S{i}" sheetId="{i + 1}" r:id="s{i}"/>' for i in range(len(sheets))) + f"</sheets>{extra}</workbook>",
        "xl/_rels/book.xml.rels": f'<Relationships xmlns="{PKG}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{REL}/{t}" Target="{x}"/>' for i, t, x in rels) + "</Relationships>",
    }
    members |= {f"xl/sheets/{names[i]}.xml": s for i, s in enumerate(sheets)}
    if strings is not None:
        members["xl/sharedStrings.xml"] = f'<sst xmlns="{SML}" count="9" uniqueCount="9">{strings}</sst>'
    if chain:
        members["xl/calcChain.xml"] = "<calcChain/>"
    return zipped(**members)


def sheet(body, before="", after=""):
    return f'<?xml version="1.0"?>\n<!-- kept --><worksheet xmlns="{SML}">{before}<sheetData>{body}</sheetData>{after}</worksheet>'


PLACES = '<row r="3" ht="20">\n <c r="B3" s="4"><f>A1</f><v>1</v><extLst/></c>  <c r="D3"/><!-- d --></row><row r="9"/>'
TABLE = "<si><t>first</t></si><si><r><t>rich</t></r></si><si><t>second</t></si>"
TEXTS = ["second", "new", "new", "rich", " a<b>&\x01_x0041_", ""]
REFUSED = [(1048576, 0, "number", 1.0, "BadCellRef"), (0, 16384, "number", 1.0, "BadCellRef"), (-1, 0, "number", 1.0, "BadCellRef"), (1, 0, "number", float("nan"), "BadNumber"), (2, 0, "number", float("inf"), "BadNumber"), (3, 0, "error", "#NO", "UnknownError"), (4, 0, "text", None, "BadText"), (5, 0, "what", None, "UnknownCellType")]
# Sheets before and after edits (row, col, kind, value).
SHEETS = {
    "none": (f'<worksheet xmlns="{SML}"/>', [(6, 2, "number", 42.0)], f'<worksheet xmlns="{SML}"><sheetData><row r="7"><c r="C7"><v>42</v></c></row></sheetData></worksheet>'),
    "empty": (f'<worksheet xmlns="{SML}"><sheetData/><x/></worksheet>', [(0, 0, "bool", False)], f'<worksheet xmlns="{SML}"><sheetData><row r="1"><c r="A1" t="b"><v>0</v></c></row></sheetData><x/></worksheet>'),
    "schema": (f'<worksheet xmlns="{SML}"><cols/><pageMargins/><drawing/></worksheet>', [(0, 0, "number", 1.0)], f'<worksheet xmlns="{SML}"><cols/><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData><pageMargins/><drawing/></worksheet>'),
    "prefix": (f'<q:worksheet xmlns:q="{SML}"><q:sheetData><q:row r="1"><q:c r="A1"/></q:row></q:sheetData></q:worksheet>', [(0, 0, "number", 5.0), (0, 2, "number", 6.0)], f'<q:worksheet xmlns:q="{SML}"><q:sheetData><q:row r="1"><q:c r="A1"><q:v>5</q:v></q:c><q:c r="C1"><q:v>6</q:v></q:c></q:row></q:sheetData></q:worksheet>'),
    "implicit": (sheet("<row><c><v>1</v></c><c><v>2</v></c></row><row><c/></row>"), [(0, 1, "number", 7.0), (1, 0, "number", 8.0)], sheet("<row><c><v>1</v></c><c><v>7</v></c></row><row><c><v>8</v></c></row>")),
    "clear": (sheet('<row r="1"><c r="A1" t="s" s="3"><f>B1</f><v>0</v></c><c r="B1" t="b"><v>1</v></c></row>'), [(0, 0, "clear", None), (5, 5, "clear", None)], sheet('<row r="1"><c r="A1" s="3"></c><c r="B1" t="b"><v>1</v></c></row>')),
    "unordered": (sheet('<row r="5"/><row r="2"/><row r="7"/>'), [(2, 0, "number", 1.0)], sheet('<row r="3"><c r="A3"><v>1</v></c></row><row r="5"/><row r="2"/><row r="7"/>')),
    "last": (sheet('<row r="1"><c r="A1"/></row>'), [(0, 0, "number", 1.0), (0, 0, "number", 2.0), (0, 0, "number", -0.5)], sheet('<row r="1"><c r="A1"><v>-0.5</v></c></row>')),
    "places": (
        sheet(PLACES, before='<dimension ref="B3:D9"/>', after="<pageMargins/>"),
        [(2, 0, "number", 1.5), (2, 2, "number", 2.0), (2, 9, "number", 3.0), (2, 1, "number", 42.0), (0, 5, "bool", True), (0, 1, "number", 7.0), (5, 0, "error", "#REF!"), (8, 8, "number", 9.0), (20, 0, "number", 1e300), (30, 0, "clear", None)],
        sheet(
            '<row r="1"><c r="B1"><v>7</v></c><c r="F1" t="b"><v>1</v></c></row>'
            '<row r="3" ht="20">\n <c r="A3"><v>1.5</v></c><c r="B3" s="4"><extLst/><v>42</v></c>  <c r="C3"><v>2</v></c><c r="D3"/><!-- d --><c r="J3"><v>3</v></c></row>'
            '<row r="6"><c r="A6" t="e"><v>#REF!</v></c></row><row r="9"><c r="I9"><v>9</v></c></row><row r="21"><c r="A21"><v>1E+300</v></c></row>',
            before='<dimension ref="A1:J21"/>',
            after="<pageMargins/>",
        ),
    ),
}
BOOKS = {k: (book([source], strings="<si><t>x</t></si>"), [(0, *e) for e in edits]) for k, (source, edits, _) in SHEETS.items()} | {
    "texts": (book([sheet('<row r="1"><c r="A1" t="b"><v>1</v></c></row>')], strings=TABLE), [(0, i, 0, "text", t) for i, t in enumerate(TEXTS)]),
    "no table": (book([sheet(""), sheet("")]), [(0, 0, 0, "text", "één"), (1, 0, 0, "text", "één")]),
    "chain": (book([sheet("")], extra='<calcPr calcId="7" calcMode="manual"/><extLst/>', chain=True), [(0, 0, 0, "number", 1.0)]),
    "refused": (book([sheet("")]), [*[(0, *e[:4]) for e in REFUSED], (7, 6, 0, "number", 1.0)]),
    "untouched": (book([sheet("")]), []),
    "bad": (bytearray(b"no archive"), [(0, 0, 0, "number", 1.0)]),
}


def save(spark, books, inline=False):
    """By package: its members, cells, refused edits and bytes."""
    rows = [(p, at, row, col, n, kind, *[value if kind == k else None for k in ("number", "text", "bool", "error")]) for p, (_, edits) in books.items() for n, (at, row, col, kind, value) in enumerate(edits)]
    found = spark.createDataFrame([(p, content) for p, (content, _) in books.items()], "path string, content binary")
    out, refused = save_cells(found, spark.createDataFrame(rows, EDIT), inline)
    out = stored(out)
    back, gone = workbook.read_cells(out).collect(), refused.collect()
    result = {}
    for r in out.collect():
        content = bytes(r.content)
        archive = zipfile.ZipFile(io.BytesIO(content)) if r.path != "bad" else None
        assert archive is None or archive.testzip() is None and r._error is None
        cells = {(x.sheet, x.row, x.col): x for x in back if x.path == r.path}
        assert archive is None or not [x for x in cells.values() if x._error]
        result[r.path] = {n: archive.read(n).decode() for n in archive.namelist()} if archive else {}, cells, sorted((x.row, x.col, x._error) for x in gone if x.path == r.path), content
    return result


@pytest.fixture(scope="module")
def saved(spark):
    return save(spark, BOOKS)


@pytest.mark.parametrize("name", SHEETS)
def test_sheets_after_edits(saved, name):
    """New cells among, before and after others, new rows likewise, and sheets without data; all else byte for byte."""
    parts, _, refused, _ = saved[name]
    assert parts["xl/sheets/sheet1.xml"] == SHEETS[name][2] and not refused
    assert '<calcPr calcId="0" fullCalcOnLoad="1"/>' in parts["xl/book.xml"]


def test_values_are_read_back(saved):
    back = saved["places"][1]
    assert (back[0, 2, 1].num, back[0, 2, 1].style, back[0, 2, 1].f_text, back[0, 5, 0].err, back[0, 20, 0].num) == (42.0, 4, None, "#REF!", 1e300)


def test_texts_are_shared(saved):
    """A text is appended once, a plain one that is there is used again, a rich one is not."""
    parts, back, refused, _ = saved["texts"]
    sst = parts["xl/sharedStrings.xml"]
    assert sst.startswith(f'<sst xmlns="{SML}">{TABLE}<si>') and sst.count("<si>") == 7 and sst.count(">new<") == 1 and 'xml:space="preserve"> a&lt;b' in sst and "count" not in sst
    assert [back[0, i, 0].text for i in range(6)] == TEXTS and not refused
    assert '<c r="A1" t="s"><v>2</v></c>' in parts["xl/sheets/sheet1.xml"]


def test_a_table_of_strings_is_made(saved):
    parts, back, _, _ = saved["no table"]
    assert back[0, 0, 0].text == back[1, 0, 0].text == "één" and parts["xl/sharedStrings.xml"].count("<si>") == 1
    assert 'PartName="/xl/sharedStrings.xml"' in parts["[Content_Types].xml"] and re.search(r'Id="rId\d+"[^>]*sharedStrings"', parts["xl/_rels/book.xml.rels"])


def test_inline_texts_leave_the_table_alone(spark):
    content = book([sheet("")], strings="<si><t>x</t></si>")
    parts, back, _, _ = save(spark, {"p": (content, [(0, 0, 0, "text", " x ")])}, inline=True)["p"]
    assert '<c r="A1" t="inlineStr"><is><t xml:space="preserve"> x </t></is></c>' in parts["xl/sheets/sheet1.xml"] and back[0, 0, 0].text == " x "
    assert parts["xl/sharedStrings.xml"] == zipfile.ZipFile(io.BytesIO(bytes(content))).read("xl/sharedStrings.xml").decode()


def test_the_chain_of_calculation_goes(saved):
    parts = saved["chain"][0]
    assert "xl/calcChain.xml" not in parts and "calcChain" not in parts["[Content_Types].xml"] + parts["xl/_rels/book.xml.rels"]
    assert 'calcMode="manual" calcId="0" fullCalcOnLoad="1"/><extLst/>' in parts["xl/book.xml"]


def test_refused_edits_change_nothing(saved):
    _, back, refused, out = saved["refused"]
    assert out == bytes(BOOKS["refused"][0]) and not back
    assert refused == sorted([(e[0], e[1], e[4]) for e in REFUSED] + [(6, 0, "SheetNotFound")])


def test_packages_without_edits_come_back(saved):
    assert saved["untouched"][3] == bytes(BOOKS["untouched"][0]) and saved["bad"][3] == b"no archive" and saved["bad"][2] == [(0, 0, "SheetNotFound")]


# ---- books that are hard to read


ONE = "<row><c><v>1</v></c></row>"


def test_books_that_are_hard_to_read(spark):
    """Books are read whatever their shape, and what is lost is said."""
    plain = sheet(ONE)
    whole = zipfile.ZipFile(io.BytesIO(bytes(book([plain, plain]))))
    members = {n: whole.read(n).decode() for n in whole.namelist()}
    cases = {
        "comment": (book([plain.replace("<!-- kept -->", "<!-- " + "<worksheet> " * 2000 + "-->")]), [(None, 1.0, "S0")]),
        "instruction": (book([plain.replace("<!-- kept -->", "<?p <sst> ?>")]), [(None, 1.0, "S0")]),
        "utf16": (book([plain.replace('<?xml version="1.0"?>', '<?xml version="1.0" encoding="UTF-16"?>').encode("utf-16")]), [(None, 1.0, "S0")]),
        "case": (zipped(**{n.replace("sheets/", "SHEETS/"): t for n, t in members.items()}), [(None, 1.0, "S0"), (None, 1.0, "S1")]),
        "relation": (zipped(**members | {"xl/_rels/book.xml.rels": members["xl/_rels/book.xml.rels"].replace('Id="s1"', 'Id="z"')}), [("SheetNotFound", None, "S1"), (None, 1.0, "S0")]),
        "part": (zipped(**{n: t for n, t in members.items() if "sheet2" not in n}), [("SheetNotFound", None, "S1"), (None, 1.0, "S0")]),
        "chart": (zipped(**members | {"xl/sheets/sheet2.xml": "<chartsheet/>"}), [("SheetNotFound", None, "S1"), (None, 1.0, "S0")]),
        "broken": (zipped(**members | {"xl/sheets/sheet2.xml": members["xl/sheets/sheet2.xml"][:-30], "picture.png": "\x89PNG"}), [("Malformed", None, None), (None, 1.0, "S0"), (None, 1.0, "S1")]),
        "no book": (zipped(**{n: t for n, t in members.items() if "book.xml" not in n}), [("WorkbookNotFound", None, None)]),
        "bad book": (zipped(**members | {"xl/book.xml": "<workbook><sheets>"}), [("Malformed", None, None), ("WorkbookNotFound", None, None)]),
        "no sheets": (book([]), []),
        "no archive": (bytearray(b"no"), [("BadZipFile", None, None)]),
        "null": (None, [("BadZipFile", None, None)]),
    }
    got = workbook.read_cells(spark.createDataFrame([(k, c) for k, (c, _) in cases.items()], "path string, content binary")).collect()
    for name, (_, want) in cases.items():
        assert (name, sorted(((r._error, r.num, r.sheet_name) for r in got if r.path == name), key=str)) == (name, want)


def test_fonts_reach_the_styles(spark):
    """Fonts with elements of any kind, equal ones used again however they are spelled, counts, cells that are made."""
    fonts = '<font><sz val="11"/><color theme="1"/><name val="Sans"/><family val="2"/><scheme val="minor"/></font><font><b/><name val=\'Sans\'/><family val="2"/><color  theme="1" /><scheme val="minor"/><sz val="11"/></font>'
    styles = f'<styleSheet xmlns="{SML}"><fonts count="2">{fonts}</fonts><cellXfs count="2"><xf numFmtId="0" fontId="0"/><xf numFmtId="14" fontId="0" applyNumberFormat="1"><alignment wrapText="1"/></xf></cellXfs></styleSheet>'
    base = zipfile.ZipFile(io.BytesIO(bytes(book([sheet('<row r="1"><c r="A1" s="1"><v>5</v></c><c r="B1" t="b"><v>1</v></c></row>')]))))
    members = {n: base.read(n).decode() for n in base.namelist()} | {"xl/styles.xml": styles}
    members["xl/_rels/book.xml.rels"] = members["xl/_rels/book.xml.rels"].replace("</Relationships>", f'<Relationship Id="y" Type="{REL}/styles" Target="styles.xml"/></Relationships>')
    found = spark.createDataFrame([("p", zipped(**members)), ("plain", book([sheet("")]))], "path string, content binary")
    edits = [("p", 0, 0, 0, None, None, True, None, None), ("p", 0, 0, 1, None, None, True, None, None), ("p", 0, 4, 4, "Mono", 9.5, None, True, None), ("p", 0, 5, 4, "Mono", 9.5, None, True, None), ("p", 0, 6, 0, None, 1000.0, None, None, None), ("plain", 0, 0, 0, None, 9.0, None, None, None)]
    out, refused = save_fonts(found, spark.createDataFrame(edits, "path string, sheet int, row int, col int, name string, size double, bold boolean, italic boolean, underline boolean"))
    archive = {r.path: zipfile.ZipFile(io.BytesIO(bytes(r.content))) for r in out.collect()}
    made = archive["p"].read("xl/styles.xml").decode()
    mono = '<font><i/><sz val="9.5"/><color theme="1"/><name val="Mono"/><family val="2"/></font>'
    assert made.startswith(f'<styleSheet xmlns="{SML}"><fonts count="3">{fonts}{mono}</fonts><cellXfs count="5"><xf numFmtId="0" fontId="0"/>')
    assert made.count("<xf ") == 5 and made.count("<alignment") == 2 and made.count('fontId="1"') == 2 and made.count('fontId="2"') == 1
    data = archive["p"].read("xl/sheets/sheet1.xml").decode()
    number = {a: int(n) for a, n in re.findall(r'<c r="([A-Z]+[0-9]+)" s="([0-9]+)"', data)} | {"B1": int(re.search(r'<c r="B1" t="b" s="([0-9]+)"', data)[1])}
    xfs = re.findall(r"<xf [^>]*>", made)
    assert 'numFmtId="14"' in xfs[number["A1"]] and 'fontId="1"' in xfs[number["A1"]] and 'fontId="1"' in xfs[number["B1"]] and number["E5"] == number["E6"] and "<v>5</v>" in data and "<v>1</v>" in data
    assert sorted((r.path, r._error) for r in refused.collect()) == [("p", "BadFontSize"), ("plain", "StylesNotFound")]
