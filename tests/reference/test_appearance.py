import io
import zipfile

from pyspark.sql import functions as F

from cellarium.functions import styles
from cellarium.operators import appearance
from cellarium.plans import workbook
from cellarium.plans.pages import book_pages
from cellarium.sources import packages
from tests.reference.test_saving import REL, SML, book, sheet, zipped

STYLES = b"""<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<numFmts><numFmt numFmtId="171" formatCode="yyyy/mm/dd hh:mm"/></numFmts>
<fonts><font><sz val="11"/><name val="Sans"/></font><font><b/><i val="0"/><u/><sz val="10.5"/><color rgb="FFFF0000"/></font></fonts>
<fills><fill><patternFill patternType="none"><fgColor rgb="FF00FF00"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor theme="1" tint="0.5"/></patternFill></fill></fills>
<borders><border/><border><left style="thin"><color indexed="10"/></left><top style="double"/></border></borders>
<cellStyleXfs><xf fontId="1"/></cellStyleXfs>
<cellXfs><xf numFmtId="0" fontId="0"/><xf numFmtId="171" fontId="1" fillId="1" borderId="1"/><xf fontId="1" applyFont="0"/></cellXfs></styleSheet>"""


def test_styles_part(spark):
    nodes = packages.xml_nodes(spark.createDataFrame([("p", "/xl/styles.xml", bytearray(STYLES))], "path string, part string, bytes binary"))
    fonts, fills, borders, xfs = appearance.fonts(nodes), appearance.fills(nodes), appearance.borders(nodes), workbook.cell_formats(nodes)
    assert [(r.font_id, r.name, r.size, r.bold, r.italic, r.underline, r.color) for r in fonts.orderBy("font_id").collect()] == [(0, "Sans", 11.0, False, False, False, None), (1, None, 10.5, True, False, True, "#ff0000")]
    assert [r.solid for r in fills.orderBy("fill_id").collect()] == [None, "#7f7f7f"]
    assert [(r.left, r.top, r.right) for r in borders.orderBy("border_id").collect()] == [(None, None, None), ("1px solid #ff0000", "3px double currentColor", None)]
    assert [(r.style, r.num_fmt_id, r.font_id, r.apply_font) for r in xfs.orderBy("style").collect()] == [(0, 0, 0, True), (1, 171, 1, True), (2, 0, 1, False)]
    assert [(r.num_fmt_id, r.is_date) for r in workbook.number_formats(nodes).collect()] == [(171, True)]
    css = {r.style: r.css for r in appearance.style_classes(xfs, fonts, fills, borders).collect()}
    assert css == {0: "font-size:15px;font-family:'Sans',sans-serif;", 1: "font-weight:700;text-decoration:underline;font-size:14px;color:#ff0000;background:#7f7f7f;border-left:1px solid #ff0000;border-top:3px double currentColor;"}


def test_colours(spark):
    cases = [(("FF112233", None, None, None), "#112233"), ((None, "0", None, None), "#000000"), ((None, "55", None, None), "#969696"), ((None, "64", None, None), None), ((None, None, "4", "-0.5"), "#223962"), ((None, None, "12", None), None), ((None, None, None, None), None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c struct<rgb:string,indexed:string,theme:string,tint:string>")
    assert [r.x for r in df.select("i", styles.color_css(F.col("c")).alias("x")).orderBy("i").collect()] == [w for _, w in cases]


def test_page(spark):
    cells = spark.createDataFrame([("p", 0, 0, 0, "text", None, "a<b", None), ("p", 0, 1, 0, "number", 2.0, None, None), ("p", 1, 0, 0, "text", None, "hidden", None)], "path string, sheet int, row int, col int, value_kind string, num double, text string, bool boolean")
    sheets = spark.createDataFrame([("p", 0, "S&T", "visible"), ("p", 1, "H", "hidden")], "path string, sheet int, name string, state string")
    page = appearance.workbook_html(cells, sheets).collect()[0].html
    assert "<h2>S&amp;T</h2><table><tr><td>a&lt;b</td></tr>\n<tr><td>2</td></tr></table>" in page and "hidden" not in page


def test_small_tables(spark):
    """Alignment, default fonts, borders without lines."""
    xml = b'<styleSheet><cellXfs><xf/><xf><alignment horizontal="centerContinuous" vertical="top" wrapText="1"/></xf><xf><alignment horizontal="distributed" vertical="justify"/></xf><xf><alignment horizontal="fill" vertical="what" wrapText="x"/></xf></cellXfs></styleSheet>'
    nodes = packages.xml_nodes(spark.createDataFrame([("p", "/s", bytearray(xml))], "path string, part string, bytes binary"))
    got = appearance.alignments(nodes).orderBy("style").collect()
    assert [(r.horizontal, r.vertical, r.wrap) for r in got] == [("general", "bottom", False), ("center", "top", True), ("justify", "center", False), ("general", "bottom", False)]
    fonts = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("q", 0, "c")], "path string, font_id int, name string")
    assert sorted(r.name for r in appearance.default_fonts(fonts).collect()) == ["a", "c"]
    borders = spark.createDataFrame([("p", 0, None, None, None, None), ("p", 1, None, "x", None, None)], "path string, border_id int, left string, right string, top string, bottom string")
    assert [r.is_empty for r in appearance.has_no_lines(borders).orderBy("border_id").collect()] == [True, False]


def test_pages_of_packages(spark):
    """Styles, dates, merges, widths, heights and hidden sheets of a package, in one call."""
    sheet_xml = sheet('<row r="1" ht="30"><c r="A1" s="1"><v>2</v></c><c r="B1"><v>1</v></c></row><row r="2"><c r="A2" t="str"><v>a&lt;b</v></c></row>', before='<cols><col min="2" max="2" width="20"/></cols>', after='<mergeCells><mergeCell ref="A2:B2"/></mergeCells>')
    base = zipfile.ZipFile(io.BytesIO(bytes(book([sheet_xml, sheet("<row><c><v>9</v></c></row>")]))))
    members = {n: base.read(n).decode() for n in base.namelist()} | {"xl/styles.xml": f'<styleSheet xmlns="{SML}"><fonts><font/><font><b/></font></fonts><cellXfs><xf fontId="0"/><xf numFmtId="14" fontId="1"/></cellXfs></styleSheet>'}
    members["xl/_rels/book.xml.rels"] = members["xl/_rels/book.xml.rels"].replace("</Relationships>", f'<Relationship Id="y" Type="{REL}/styles" Target="styles.xml"/></Relationships>')
    members["xl/book.xml"] = members["xl/book.xml"].replace('name="S1"', 'name="S1" state="hidden"')
    found = spark.createDataFrame([("p", zipped(**members)), ("bad", bytearray(b"x"))], "path string, content binary")
    got = {r.path: r.html for r in book_pages(found, title="T").collect()}
    assert got.keys() == {"p"} and "<title>T</title><style>.x1{font-weight:700;" in got["p"]
    assert '<section><h2>S0</h2><table><colgroup><col style="width:64px"><col style="width:145px"></colgroup><tr style="height:40px"><td class="x1">1900-01-01</td><td>1</td></tr>\n<tr><td colspan="2">a&lt;b</td></tr></table></section>' in got["p"] and "S1" not in got["p"]
