"""Known results of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from cellarium.functions import formula_trees, addresses, formulas, markup, styles, values


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0]


def test_addresses(spark):
    cases = {"A1": (0, 0), "Z1": (0, 25), "AA1": (0, 26), "AZ1": (0, 51), "BA1": (0, 52), "ZZ1": (0, 701), "AAA1": (0, 702), "XFD1048576": (1048575, 16383), "xfd1": (0, 16383)}
    bad = ["XFE1", "A1048577", "ZZZ1", "AAAA1", "A0", "A99999999", "", "1A", "A", "1", "$A$1", "A1:B2", "A 1", "A1 ", " A1", "A1x"]
    df = spark.createDataFrame([(a,) for a in [*cases, *bad, None]], "a string")
    got = {r.a: r.x and (r.x.row, r.x.col) for r in df.select("a", addresses.parse_a1("a").alias("x")).collect()}
    assert got == cases | dict.fromkeys([*bad, None])
    back = spark.createDataFrame([(r, c) for r, c in cases.values()], "r int, c int").select(addresses.a1("r", "c").alias("a")).collect()
    assert [r.a for r in back] == [a.upper() for a in cases]
    ranges = {"B2:A1": (0, 0, 1, 1), "C3": (2, 2, 2, 2), "A1:B2:C3": None, "A1:": None}
    df = spark.createDataFrame([(a,) for a in ranges], "a string")
    assert {r.a: r.x and tuple(r.x) for r in df.select("a", addresses.parse_range("a").alias("x")).collect()} == ranges


@pytest.mark.parametrize(("text", "value"), [("1.5", 1.5), ("1E+3", 1000.0), ("-0", 0.0), (" 7 ", 7.0), ("inf", None), ("NaN", None), ("", None), ("1,5", None), ("abc", None), ("1e999", None), ("1d", None), ("0x1p3", None)])
def test_numbers(spark, text, value):
    assert one(spark, values.parse_number(F.lit(text))).c0 == value


@pytest.mark.parametrize(
    ("number", "stored", "general"),
    [(424242.5, "424242.5", "424242.5"), (1.0, "1", "1"), (0.0, "0", "0"), (-0.1, "-0.1", "-0.1"), (1e-7, "0.0000001", "0.0000001"), (1e300, "1E+300", None), (5e-324, "5E-324", None), (0.1 + 0.2, "0.30000000000000004", "0.3"), (1e20, "100000000000000000000", "100000000000000000000"), (-12345.678, "-12345.678", "-12345.678"), (100.0, "100", "100")],
)
def test_printing(spark, number, stored, general):
    if number == 5e-324:  # older Java prints one digit more
        assert one(spark, values.stored_number(F.lit(number))).c0 in ("5E-324", "4.9E-324")
    else:
        assert one(spark, values.stored_number(F.lit(number))).c0 == stored
    if general:
        assert one(spark, values.general_number(F.lit(number))).c0 == general


def test_escapes(spark):
    samples = {"a_x0000_b": "a\x00b", "line_x000D_more": "line\rmore", "_x0041_": "_x0041_", "_x005F_x0041_": "_x0041_", "_xZZZZ_": "_xZZZZ_", "_x00": "_x00"}
    for raw, text in samples.items():
        assert one(spark, markup.decode_x_escapes(F.lit(raw))).c0 == text
    for text in ["plain", "_x0041_", "\x01_\x1f", "_x005F_", "a\rb", "_x005F_x0041_"]:
        assert one(spark, markup.decode_x_escapes(markup.encode_x_escapes(F.lit(text)))).c0 == text
    got = one(spark, markup.escape_text(F.lit("a&b<c>\r")), markup.escape_attr(F.lit('"\n\t')), markup.escape_text(F.lit("\x01")), markup.unescape(F.lit("&amp;lt;")))
    assert tuple(got) == ("a&amp;b&lt;c&gt;&#xD;", "&quot;&#xA;&#x9;", None, "&lt;")


def test_part_names(spark):
    owner = F.lit("/xl/worksheets/sheet1.xml")
    targets = {"../sharedStrings.xml": "/xl/sharedStrings.xml", "/a/./b": "/a/b", "c%20d.xml#f?g": "/xl/worksheets/c d.xml", "../../../x": None, "a+b%zz": "/xl/worksheets/a+b%zz"}
    for target, want in targets.items():
        assert one(spark, markup.resolve_target(owner, F.lit(target))).c0 == want
    got = one(spark, markup.rels_part(owner), markup.rels_owner(F.lit("/xl/_rels/workbook.xml.rels")), markup.rels_owner(F.lit("/_rels/.rels")), markup.part_extension(F.lit("/a.b/c")), markup.part_key(F.lit("/XL/É")))
    assert tuple(got) == ("/xl/worksheets/_rels/sheet1.xml.rels", "/xl/workbook.xml", "/", None, "/xl/É")
    for name, ok in {"/a/b.xml": True, "a": False, "/a//b": False, "/a/../b": False, "/a./b": False, "/": False, "/a\\b": False}.items():
        assert one(spark, markup.is_part_name(F.lit(name))).c0 is ok
    for ct, ok in {"application/xml": True, "TEXT/XML; x": True, "a/b+xml": True, "a/b+XML": False, "image/png": False}.items():
        assert one(spark, markup.is_xml_content_type(F.lit(ct))).c0 is ok


def test_styles(spark):
    got = one(spark, styles.col_width_px(F.lit(8.43), F.lit(7.0)), styles.col_width_px(F.lit(1.33203125), F.lit(7.0)), styles.col_width_px(F.lit(1.33203125), F.lit(6.0)), styles.css_color(styles.apply_tint(F.lit(0), F.lit(0.5))), styles.font_size_text(F.lit(10.50)), styles.border_class(F.lit("slantDashDot")), styles.max_digit_width(F.lit(11.0)))
    assert tuple(got) == (64.0, 14.0, 13.0, "#7f7f7f", "10.5", "dashed", 7.0)


def shifted(spark, text, *args, **more):
    return tuple(one(spark, formulas.shift_formula(F.lit(text), *args, **more)).c0)


def translated(spark, text, d_row, d_col):
    return one(spark, formulas.translate_formula(F.lit(text), F.lit(d_row), F.lit(d_col))).c0


@pytest.mark.parametrize(
    ("text", "args", "want"),
    [
        ("SUM(A5:A9)*$B$2", (0, 1, True), "SUM(A6:A10)*$B$3"),
        ("SUM(A2:A6)", (1, 1, True), "SUM(A3:A7)"),
        ("SUM(A2:A6)", (3, 1, True), "SUM(A2:A7)"),
        ("SUM(A2:A6)", (6, 1, True), "SUM(A2:A6)"),
        ("A5+B1", (4, 1, False), "#REF!+B1"),
        ("A9", (4, 1, False), "A8"),
        ("SUM(A2:A6)", (2, 2, False), "SUM(A2:A4)"),
        ("SUM(A2:A6)", (0, 2, False), "SUM(A1:A4)"),
        ("SUM(A2:A6)", (1, 5, False), "SUM(#REF!)"),
        ("A1048576", (0, 1, True), "#REF!"),
        ("B:D+1:1", (5, 1, True), "B:D+1:1"),
        ('LOG10(A1)&"A1"&A1B&\'My Sheet\'!A1', (0, 1, True), 'LOG10(A2)&"A1"&A1B&\'My Sheet\'!A1'),
        ("A6:A2", (0, 1, True), "A7:A3"),
    ],
)
def test_formula_rows(spark, text, args, want):
    assert shifted(spark, text, "row", *args, sheet="Sheet1")[0] == want


def test_formula_columns_sheets_and_copies(spark):
    assert shifted(spark, "B5+B:D", "col", 0, 1, True)[0] == "C5+C:E"
    assert shifted(spark, "XFD1", "col", 0, 1, True)[0] == "#REF!"
    assert shifted(spark, "A5+S1!A5+'S 2'!A5+[1]S1!A5+S0:S1!A5", "row", 0, 1, True, "S1", local=False) == ("A5+S1!A6+'S 2'!A5+[1]S1!A6+S0:S1!A6", 3)
    assert translated(spark, "A5+$A$5+A$5+$A5", 1, 0) == "A6+$A$5+A$5+$A6"
    assert translated(spark, "A1", -1, 0) == "#REF!"
    f = "SUM(A1:B2)*LOG10(C3)+\"D4\"+name+1.5E3"
    got = one(spark, formulas.references(F.lit(f)), formulas.function_names(F.lit(f)), F.array_join(formulas.tokens(F.lit(f)), ""))
    assert tuple(got) == (["A1:B2", "C3"], ["SUM", "LOG10"], f)


def test_input_coercion_and_plurals(spark):
    df = spark.createDataFrame([("",), ("  ",), (None,), (" 1.5 ",), ("TRUE",), ("false",), ("NaN",), ("x",)], "t string")
    got = [tuple(r.x) for r in df.select(values.coerce_input(F.col("t")).alias("x")).collect()]
    assert got == [("empty", None, None, None)] * 3 + [("number", 1.5, None, None), ("bool", None, None, True), ("bool", None, None, False), ("text", None, "NaN", None), ("text", None, "x", None)]
    assert [one(spark, values.plural(F.lit(n), "a", "b", "c")).c0 for n in (1, 2, 5, 11, 21, 112)] == ["1 a", "2 b", "5 c", "11 c", "21 a", "112 c"]


@pytest.mark.parametrize(("code", "date"), [("dd.mm.yyyy", True), ("[h]:mm:ss", True), ("General", False), ("[Red]#,##0", False), ("[$-409]#,##0", False), ('0" days"', False), ('"', False), ("[mm]", True), ("\\d0", False), ("_d0", False)])
def test_date_formats(spark, code, date):
    assert one(spark, styles.is_date_format(F.lit(code))).c0 is date


def test_reference_table(spark):
    got = one(spark, formulas.reference_table(F.lit("SUM($A$1:B2)+'S 1'!C3+#REF!+A:$C+$1:2&\"D4\""))).c0
    assert [(r.sheet, r.kind, r.c0, r.r0, r.c1, r.r1, r.c0_abs, r.r1_abs) for r in got] == [
        (None, "area", 0, 0, 1, 1, True, False), ("'S 1'", "cell", 2, 2, 2, 2, False, False), (None, "invalid", None, None, None, None, False, False), (None, "cols", 0, None, 2, None, False, False), (None, "rows", None, 0, None, 1, False, False)
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [("1-2-3", "binary binary number number number"), ("-1^2", "binary unary number number"), ("A1:B2 C3", "binary ref ref"), ("F(,G())", "call missing call"), ("(A1,B1)%", "percent union ref ref"), ("{1,\"x\";#N/A,TRUE}", "array number string row_end error bool"), (" a.b & Sheet2!C$3 ", "binary name ref")],
)
def test_trees_of_formulas(text, want):
    nodes = formula_trees.parse_text(text)
    assert " ".join(n["kind"] for n in nodes) == want and formula_trees.print_nodes(nodes) == text


@pytest.mark.parametrize(("text", "fault", "at"), [("", "UnexpectedEnd", 0), ("1+", "UnexpectedEnd", 2), ("F(1", "UnbalancedParen", 3), ("1)", "UnbalancedParen", 1), ('"a', "UnterminatedString", 0), ("T[x]", "BadReference", 1), ("1 @", "UnexpectedChar", 2), ("2*/3", "UnexpectedChar", 2), ("#WHAT!", "BadReference", 0), ("(" * 65 + "1" + ")" * 65, "LimitDepth", 64)])
def test_what_is_no_formula(spark, text, fault, at):
    row = spark.createDataFrame([(text,), (None,)], "f string").select(formula_trees.parse_formula(F.col("f")).alias("x")).select("x.*").collect()
    assert (row[0].fault, row[0].at, row[0].nodes) == (fault, at, None) and row[1].fault is None


def test_long_sums_are_printed(spark):
    """A sum of many terms is a tree as deep as it has terms."""
    text = "+".join(["A1"] * 1500) + "*(" + " & ".join(f"B{i}" for i in range(1, 1200)) + ")"
    row = spark.createDataFrame([(text,)], "f string").select(formula_trees.print_formula(formula_trees.parse_formula(F.col("f"))["nodes"]).alias("again")).first()
    assert row.again == text


def test_formulas_that_are_odd(spark):
    """Null, empty and unchanged formulas, spelling of references, sheets with quotes, references beyond the sheet."""
    assert shifted(spark, None, "row", 0, 1, True) == (None, 0) and shifted(spark, "", "row", 0, 1, True) == ("", 0) and translated(spark, "A1", None, 1) is None
    assert shifted(spark, "a1+$b$2+\"A1\"+'It''s'!C3+ZZZ9+A9999999+Sheet1!#REF!", "row", 1, 3, True, "It's") == ("A1+$B$5+\"A1\"+'It''s'!C6+ZZZ9+A9999999+Sheet1!#REF!", 3)
    assert shifted(spark, "C:A+$3:1+D4:B2", "col", 1, 1, False) == ("B:A+$3:1+C4:B2", 2)
    assert translated(spark, "$A:B+1:$2+XFD1", 1, 1) == "$A:C+2:$2+#REF!"


def test_names_of_columns_are_no_references(spark):
    assert shifted(spark, "SUM(T[Q1])+T[[#All],[B2]]+A5", "row", 0, 1, True) == ("SUM(T[Q1])+T[[#All],[B2]]+A6", 1)


@pytest.mark.parametrize(
    ("raw", "text", "attr"),
    [("a&#66;&#x43;&#10;", "aBC\n", "aBC\n"), ("x\r\ny\rz\t", "x\ny\nz\t", "x y z "), ("&amp;lt;&quot;&apos;", "&lt;\"'", "&lt;\"'"), ("&#x1F600;&#233;&#x20AC;", "😀é€", "😀é€"), ("&what;", None, None), ("&#0;", None, None), ("a & b", None, None), ("", "", "")],
)
def test_references_of_characters(spark, raw, text, attr):
    row = spark.createDataFrame([(raw,)], "s string").select(markup.unescape(F.col("s")).alias("t"), markup.unescape_attr(F.col("s")).alias("a")).first()
    assert (row.t, row.a) == (text, attr)


def test_private_characters_stay(spark):
    row = spark.createDataFrame([("\ue000_x0001__x005F_x0041_ _x0041_ __",)], "s string").select(markup.decode_x_escapes(F.col("s")).alias("t")).first()
    assert row.t == "\ue000\x01_x0041_ _x0041_ __"
