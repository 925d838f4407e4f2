from cellarium.operators import package_edits as e


def rels(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], "path string, owner string, ord int, id string, type string, target string, mode string, resolved string")


def test_relationship_ids(spark):
    found = rels(spark, [("/a", 0, "rId3", "t", "x", "Internal", "/x"), ("/a", 1, "rId1", "t", "y", "Internal", "/y"), ("/b", 0, "other", "t", "z", "External", None)])
    assert {(r.owner, r.n) for r in e.next_rel_number(found).collect()} == {("/a", 4), ("/b", 2)}
    fresh = spark.createDataFrame([("p", "/a", "t", "n1", "Internal"), ("p", "/a", "t", "n2", "Internal"), ("p", "/c", "t", "n3", "Internal")], "path string, owner string, type string, target string, mode string")
    got = {r.target: (r.id, r.ord) for r in e.add_relationships(found, fresh).collect()}
    assert got["n1"] == ("rId4", 2) and got["n2"] == ("rId5", 3) and got["n3"] == ("rId1", 0) and len(got) == 6


def test_parts(spark):
    parts = spark.createDataFrame([("p", "/A", bytearray(b"1")), ("p", "/b", bytearray(b"2")), ("p", "/c", bytearray(b"3")), ("p", "/_rels/b.rels", bytearray(b"r"))], "path string, part string, bytes binary")
    edits = spark.createDataFrame([("p", "/a", bytearray(b"1")), ("p", "/b", bytearray(b"9")), ("p", "/c", None), ("p", "/d", bytearray(b"4"))], "path string, part string, bytes binary")
    assert {(r.part, bytes(r.bytes), r.kind) for r in e.edit_parts(parts, edits).collect()} == {("/A", b"1", "verbatim"), ("/b", b"9", "replace"), ("/_rels/b.rels", b"r", "verbatim"), ("/d", b"4", "new")}
    found = rels(spark, [("/A", 0, "r1", "t", "b", "Internal", "/B"), ("/A", 1, "r2", "t", "b", "External", None), ("/b", 0, "r3", "t", "c", "Internal", "/c")])
    over = spark.createDataFrame([("p", "/B", "x"), ("p", "/c", "y")], "path string, part string, ct string")
    gone = spark.createDataFrame([("p", "/b")], "path string, part string")
    left, links, types = e.remove_parts(parts, found, over, gone)
    assert {r.part for r in left.collect()} == {"/A", "/c"} and [r.id for r in links.collect()] == ["r2"] and [r.part for r in types.collect()] == ["/c"]


def test_types_and_main_part(spark):
    defaults = spark.createDataFrame([("p", "XML", "application/xml")], "path string, ext string, ct string")
    over = spark.createDataFrame([("p", "/b.xml", "old")], "path string, part string, ct string")
    wanted = spark.createDataFrame([("p", "/a.xml", "application/xml"), ("p", "/B.xml", "new"), ("p", "/c.bin", "bin")], "path string, part string, ct string")
    assert {(r.part, r.ct) for r in e.ensure_overrides(defaults, over, wanted).collect()} == {("/B.xml", "new"), ("/c.bin", "bin")}
    parts = spark.createDataFrame([("p", "/xl/Book.xml"), ("q", "/XL/workbook.xml"), ("r", "/x")], "path string, part string")
    found = rels(spark, [("/", 1, "r1", "u/officeDocument", "xl/book.xml", "Internal", "/xl/book.xml"), ("/", 0, "r0", "u/officeDocument", "none", "Internal", "/none")])
    assert {(r.path, r.part) for r in e.main_parts(parts, found, parts, "/officeDocument", "/", "/xl/workbook.xml").collect()} == {("p", "/xl/Book.xml"), ("q", "/XL/workbook.xml"), ("r", None)}


def test_relationships_that_go(spark):
    found = rels(spark, [("/a", 0, "r1", "t", "x", "Internal", "/x"), ("/a", 1, "r1", "t", "y", "Internal", "/y"), ("/b", 0, "r1", "t", "z", "External", None)])
    gone = spark.createDataFrame([("p", "/a", "r1"), ("p", "/a", "none")], "path string, owner string, id string")
    assert sorted(r.target for r in e.remove_relationships(found, gone).collect()) == ["y", "z"]


def test_chains_of_calculation(spark):
    paths = spark.createDataFrame([("p",), ("q",), ("r",)], "path string")
    named = rels(spark, [("/xl/workbook.xml", 0, "r1", "x/calcChain", "c.xml", "Internal", "/xl/C.xml")])
    parts = spark.createDataFrame([("p", "/xl/c.xml"), ("q", "/xl/calcchain.xml"), ("r", "/xl/other.xml")], "path string, part string")
    assert sorted((r.path, r.part) for r in e.calc_chains(paths, named, parts).collect()) == [("p", "/xl/c.xml"), ("q", "/xl/calcchain.xml")]


def test_small_functions(spark):
    from pyspark.sql import functions as F

    from cellarium.functions import formulas, styles
    from cellarium.sources import packages

    row = spark.range(1).select(
        F.array(*[styles.size_text(F.lit(n)) for n in (0, 1023, 1024, 1536, 5 << 20, 3 << 30)]).alias("sizes"),
        F.array(*[formulas.book_index(F.lit(s)) for s in ("[3]Sheet", "'[12]My sheet'", "Sheet", None)]).alias("books"),
        F.array(*[packages.is_limit(F.lit(s)) for s in ("LimitPart", "BadZipFile")]).alias("limits"),
    ).first()
    assert row.sizes == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "5.0 MiB", "3.0 GiB"] and row.books == [3, 12, None, None] and row.limits == [True, False]
    deep = spark.createDataFrame([("p", "/s", bytearray(b"<a>" * 300 + b"</a>" * 300))], "path string, part string, bytes binary")
    assert packages.xml_nodes(deep).first()["_error"] == "LimitDepth" and packages.xml_nodes(deep, packages.PERMISSIVE).count() == 300


def test_ranges(spark):
    """Ranges of all sizes, reversed ones, several for a cell; and pairs that overlap, each once."""
    import random

    from cellarium.operators import ranges

    rnd = random.Random(3)
    listed = []
    for i in range(150):
        r0, c0 = rnd.randrange(60), rnd.randrange(30)
        listed.append(("p", i % 2, i, r0, c0, r0 + rnd.choice([0, 0, 1, 7, 40, 1048515]), c0 + rnd.choice([0, 1, 5, 16350])))
    listed.append(("p", 0, 900, 5, 5, 4, 9))
    df = spark.createDataFrame(listed, "path string, sheet int, ord int, r0 long, c0 long, r1 long, c1 long")
    cells = [("p", s, r, c) for s in (0, 1, 2) for r, c in [(0, 0), (10, 10), (59, 29), (1048574, 16379), (30, 16000)]]
    points = spark.createDataFrame(cells, "path string, sheet int, row long, col long")
    holds = lambda x, s, r, c: x[1] == s and x[3] <= r <= x[5] and x[4] <= c <= x[6]
    got = {(r.sheet, r.row, r.col): r.range and r.range.ord for r in ranges.first_range(points, df).collect()}
    assert got == {(s, r, c): min((x[2] for x in listed if holds(x, s, r, c)), default=None) for _, s, r, c in cells}
    meet = lambda x, y: x[1] == y[1] and x[3] <= y[5] and y[3] <= x[5] and x[4] <= y[6] and y[4] <= x[6]
    pairs = sorted((r.a.ord, r.b.ord) for r in ranges.overlapping(df, df).collect())
    assert pairs == sorted((x[2], y[2]) for x in listed[:-1] for y in listed[:-1] if meet(x, y))

