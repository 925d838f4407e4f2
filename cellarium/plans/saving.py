"""Changed cells written back into packages: edits are placed among a sheet's rows and cells, and all other bytes stay.

Where an edit goes follows from one sorted stream of what is there and what is wanted: the element that holds the place, or else
the first one after it, before which a new element comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.functions import markup, values
from cellarium.functions.addresses import MAX_COL, MAX_ROW, a1, parse_a1, parse_range, range_a1, row_index
from cellarium.operators.grid import implicit_positions, intern_strings
from cellarium.operators.package_edits import calc_chains, mark_full_recalc, next_rel_number
from cellarium.operators.style_edits import font_fault
from cellarium.plans.workbook import relationships, shared_strings, string_parts, workbook_parts, workbook_sheets
from cellarium.sources.books import book_rows, rows_of
from cellarium.sources.packages import named_parts
from cellarium.sources.splices import AFTER_DATA, asked_formats, part_faults, splice_parts
from cellarium.sources.tables import measured_joins, stored
from cellarium.sources.writer import save_packages
from cellarium.sources.xml_events import append_children, attributes, insert_before, new_element, remove_nodes, serialize, set_attributes, subtrees, xml_events

_PART = ["path", "part"]
_AT = ["path", "part", "row", "col"]
# Names of what a table of strings needs.
_STRINGS_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"
_STRINGS_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/sharedStrings"
_TYPES = "/[Content_Types].xml"
_NO_STRINGS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"/>'
_NO_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"/>'


def _local(name: Column) -> Column:
    return F.regexp_extract(name, "[^:]*$", 0)


def _prefixed(events: DataFrame) -> DataFrame:
    """Starts of events with local, and prefix: that of their part's first element, if it is theirs too; others are left out."""
    starts = events.filter("kind = 'Start'").withColumn("prefix", F.regexp_extract("name", "^.*:", 0)).withColumn("local", _local(F.col("name")))
    own = starts.filter("depth = 0").select(*_PART, "prefix")
    return starts.join(own, [*_PART, "prefix"])


def cell_fault(edits: DataFrame) -> Column:
    """What is wrong with an edit by itself; null if nothing."""
    outside = ~F.col("row").between(0, MAX_ROW) | ~F.col("col").between(0, MAX_COL) | F.col("row").isNull() | F.col("col").isNull()
    finite = F.col("num").isNotNull() & ~F.isnan("num") & (F.abs("num") < float("inf"))
    return (
        F.when(outside, "BadCellRef")
        .when(~F.coalesce(F.col("value_kind").isin("number", "text", "bool", "error", "clear"), F.lit(False)), "UnknownCellType")
        .when((F.col("value_kind") == "number") & ~finite, "BadNumber")
        .when((F.col("value_kind") == "text") & F.col("text").isNull(), "BadText")
        .when((F.col("value_kind") == "bool") & F.col("bool").isNull(), "BadBool")
        .when((F.col("value_kind") == "error") & values.parse_error(F.col("err")).isNull(), "UnknownError")
    )


def _plain_text(qname: Column, text: Column) -> Column:
    """The element of a text: escapes for what XML can't hold, and white space at its ends kept."""
    coded = markup.encode_x_escapes(text)
    keep = F.when(coded.startswith(" ") | coded.endswith(" "), "preserve")
    return new_element(qname, [("xml:space", keep)], markup.escape_text(coded))


def _following(there: DataFrame, wanted: DataFrame, by: list[str], place: str) -> DataFrame:
    """wanted (by, place) with next: the first element in document order of those there (by, place, node_id) that stand for a later place."""
    both = wanted.select(*by, place).withColumn("_asked", F.lit(1)).unionByName(there.select(*by, place, "node_id").withColumn("_asked", F.lit(0)), allowMissingColumns=True)
    later = F.min("node_id").over(Window.partitionBy(*by).orderBy(F.col(place).desc()).rangeBetween(Window.unboundedPreceding, -1))  # grows down from the last place
    return both.withColumn("next", later).filter("_asked = 1").drop("_asked", "node_id")


def cell_pieces(edits: DataFrame) -> DataFrame:
    """edits of splice_cells() as splice_parts() takes them: all of a new value but the names of elements, which have the prefix of their part."""
    edits = edits if "s" in edits.columns else edits.withColumn("s", F.lit(None).cast("string"))
    row, col, kind, coded = F.col("row").cast("long"), F.col("col").cast("long"), F.col("value_kind"), markup.encode_x_escapes(F.col("text"))
    inline = (kind == "text") & F.col("idx").isNull()
    ty = F.when(inline, "inlineStr").when(kind == "text", "s").when(kind == "bool", "b").when(kind == "error", "e")
    shown = F.when(kind == "number", values.stored_number(F.col("num"))).when(kind == "bool", F.col("bool").cast("int").cast("string")).when(kind == "error", markup.escape_text(F.col("err"))).when(kind == "text", F.col("idx").cast("string"))
    keep = inline & (coded.startswith(" ") | coded.endswith(" "))
    return edits.select(*_PART, row.alias("row"), col.alias("col"), kind.alias("kind"), a1(row, col).alias("a1"), ty.alias("t"), markup.escape_attr(F.col("s")).alias("s"), markup.escape_attr(F.col("s"), "'").alias("s1"), F.coalesce(inline, F.lit(False)).alias("inline"), shown.alias("shown"), F.when(inline, markup.escape_text(coded)).alias("inner"), F.coalesce(keep, F.lit(False)).alias("keep"))


@measured_joins
def splice_cells(events: DataFrame, edits: DataFrame) -> DataFrame:
    """events of sheet parts after edits (path, part, row, col, value_kind, num, bool, err, text, idx, perhaps s; one for each cell).

    A text goes into the cell where idx is null, else its index in the table of shared strings. A cell that is there keeps its
    attributes but for its type, and all its elements but for value, formula and inline text. A missing cell or row comes before the
    first one in the part that has a later place, at the end without one; both get an address. `clear` makes none. A declared
    range grows. New elements have the prefix of the part's own. s is a cell's new format, and the kind `style` leaves its value alone.
    splice_parts() does the same to the bytes of packages, in a fraction of the time.
    """
    starts = stored(_prefixed(events).select(*_PART, "node_id", "parent_id", "depth", "prefix", "local"))
    own = starts.filter("depth = 0").select(*_PART, F.col("node_id").alias("root"), "prefix")
    data = starts.filter("local = 'sheetData' AND depth = 1").groupBy(*_PART).agg(F.min("node_id").alias("data"))
    said_of = stored(attributes(events).filter("qname IN ('r', 'ref')").select(*_PART, "node_id", "qname", "value"))
    given = said_of.filter("qname = 'r'").select(*_PART, "node_id", F.col("value").alias("r"))

    rows = starts.filter("local = 'row' AND depth = 2").join(data.withColumnRenamed("data", "parent_id"), [*_PART, "parent_id"]).select(*_PART, "node_id").join(given, [*_PART, "node_id"], "left")
    rows = stored(implicit_positions(rows.withColumn("_r", row_index(F.col("r")).cast("long")), _PART, "node_id", "_r", "row").select(*_PART, "node_id", "row"))
    first_rows = rows.groupBy(*_PART, "row").agg(F.min("node_id").alias("row_node"))
    cells = starts.filter("local = 'c' AND depth = 3").join(rows.withColumnRenamed("node_id", "parent_id"), [*_PART, "parent_id"]).select(*_PART, F.col("parent_id").alias("row_node"), "row", "node_id").join(given, [*_PART, "node_id"], "left")
    cells = cells.withColumn("_at", parse_a1("r")).withColumn("_c", F.col("_at.col").cast("long"))
    cells = stored(implicit_positions(cells, [*_PART, "row_node"], "node_id", "_c", "col").select(*_PART, "row_node", "node_id", F.coalesce(F.col("_at.row").cast("long"), "row").alias("row"), "col"))

    edits = edits if "s" in edits.columns else edits.withColumn("s", F.lit(None).cast("string"))
    wanted = edits.withColumn("row", F.col("row").cast("long")).withColumn("col", F.col("col").cast("long")).join(own, _PART).join(first_rows, [*_PART, "row"], "left")
    same = cells.groupBy(*_PART, "row_node", "row", "col").agg(F.min("node_id").alias("cell"))
    wanted = wanted.join(same, [*_PART, "row_node", "row", "col"], "left")

    qname = lambda name: F.concat("prefix", F.lit(name))
    kind = F.col("value_kind")
    ty = F.when(kind == "text", F.when(F.col("idx").isNull(), "inlineStr").otherwise("s")).when(kind == "bool", "b").when(kind == "error", "e")
    shown = F.when(kind == "number", values.stored_number(F.col("num"))).when(kind == "bool", F.col("bool").cast("int").cast("string")).when(kind == "error", markup.escape_text(F.col("err"))).when(kind == "text", F.col("idx").cast("string"))
    body = F.when(kind.isin("clear", "style"), None).when((kind == "text") & F.col("idx").isNull(), new_element(qname("is"), [], _plain_text(qname("t"), F.col("text")))).otherwise(new_element(qname("v"), [], shown))
    wanted = stored(wanted.select(*_AT, "row_node", "cell", "prefix", "root", "s", kind.alias("value_kind"), ty.alias("t"), body.alias("body"), new_element(qname("c"), [("r", a1("row", "col")), ("s", F.col("s")), ("t", ty)], body).alias("xml")))

    # Cells that are there: a type, and a value in place of the old one.
    old = wanted.filter("cell IS NOT NULL").withColumnRenamed("cell", "node_id")
    inner = starts.filter("local IN ('v', 'f', 'is')").withColumnsRenamed({"node_id": "_child", "parent_id": "node_id"}).join(old.filter("value_kind <> 'style'").select(*_PART, "node_id"), [*_PART, "node_id"]).select(*_PART, F.col("_child").alias("node_id"))
    declared = starts.filter("local = 'dimension' AND depth = 1").groupBy(*_PART).agg(F.min("node_id").alias("node_id"))
    said = said_of.filter("qname = 'ref'").select(*_PART, "node_id", parse_range(F.col("value")).alias("x")).join(declared, [*_PART, "node_id"]).filter("x IS NOT NULL")
    most = wanted.filter("value_kind <> 'clear'").groupBy(*_PART).agg(F.min("row").alias("a"), F.min("col").alias("b"), F.max("row").alias("c"), F.max("col").alias("d"))
    both = said.join(most, _PART).select(*_PART, "node_id", "x", F.least("x.r0", "a").alias("r0"), F.least("x.c0", "b").alias("c0"), F.greatest("x.r1", "c").alias("r1"), F.greatest("x.c1", "d").alias("c1"))
    wider = both.filter("r0 < x.r0 OR c0 < x.c0 OR r1 > x.r1 OR c1 > x.c1")
    grown = wider.select(*_PART, "node_id", F.lit("ref").alias("qname"), range_a1("r0", "c0", "r1", "c1").alias("value"))
    typed = old.filter("value_kind <> 'style'").select(*_PART, "node_id", F.lit("t").alias("qname"), F.col("t").alias("value"))
    typed = typed.unionByName(old.filter("s IS NOT NULL").select(*_PART, "node_id", F.lit("s").alias("qname"), F.col("s").alias("value")))

    # Cells and rows that are not.
    new_cells = wanted.filter("cell IS NULL AND row_node IS NOT NULL AND value_kind <> 'clear'")
    placed = stored(new_cells.join(_following(cells, new_cells, [*_PART, "row_node"], "col"), [*_PART, "row_node", "col"]))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "xml"))), lambda x: x["xml"]), "")
    new_rows = wanted.filter("row_node IS NULL AND value_kind <> 'clear'").groupBy(*_PART, "row", "prefix", "root").agg(joined.alias("cells"))
    new_rows = new_rows.select(*_PART, "row", "prefix", "root", new_element(qname("row"), [("r", (F.col("row") + 1).cast("string"))], F.col("cells")).alias("xml"))
    new_rows = stored(new_rows.join(_following(rows, new_rows, _PART, "row"), [*_PART, "row"]).join(data, _PART, "left"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "xml"))), lambda x: x["xml"]), "")
    fresh = new_rows.filter("data IS NULL").groupBy(*_PART, "prefix", "root").agg(every.alias("rows"))
    after = starts.filter(F.col("local").isin(*AFTER_DATA) & (F.col("depth") == 1)).groupBy(*_PART).agg(F.min("node_id").alias("next"))
    fresh = fresh.select(*_PART, "root", new_element(qname("sheetData"), [], F.col("rows")).alias("xml")).join(after, _PART, "left")

    piece = lambda df, node, order: df.select(*_PART, F.col(node).alias("node_id"), "xml", order.cast("long").alias("ord"))
    zero = F.lit(0)
    before = piece(placed.filter("next IS NOT NULL"), "next", F.col("col")).unionByName(piece(new_rows.filter("data IS NOT NULL AND next IS NOT NULL"), "next", F.col("row"))).unionByName(piece(fresh.filter("next IS NOT NULL"), "next", zero))
    last = piece(placed.filter("next IS NULL"), "row_node", F.col("col")).unionByName(piece(new_rows.filter("data IS NOT NULL AND next IS NULL"), "data", F.col("row"))).unionByName(piece(fresh.filter("next IS NULL"), "root", zero)).unionByName(old.filter("body IS NOT NULL").select(*_PART, "node_id", F.col("body").alias("xml"), zero.cast("long").alias("ord")))
    changed = stored(remove_nodes(set_attributes(events, typed.unionByName(grown)), inner))
    return append_children(stored(insert_before(changed, before)), stored(last))


def _small_part(found: DataFrame, wanted: DataFrame, fallback: str) -> DataFrame:
    """path, part, bytes of parts (path, part), or this text where one is not there."""
    key = markup.part_key(F.col("part"))
    there = named_parts(found, wanted).withColumn("_key", key)
    both = wanted.select("path", F.col("part").alias("_part")).withColumn("_key", markup.part_key(F.col("_part"))).join(there, ["path", "_key"], "left")
    return both.select("path", F.coalesce("part", "_part").alias("part"), F.coalesce("bytes", F.lit(fallback).cast("binary")).alias("bytes"))


def _roots(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'Start' AND depth = 0").select(*_PART, "node_id", F.regexp_extract("name", "^.*:", 0).alias("prefix"))


@measured_joins
def save_cells(found: DataFrame, edits: DataFrame, inline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Packages (path, content) after edits (path, sheet, row, col, ord, value_kind, num, text, bool, err), and the edits refused.

    The first is path, content, _error of all packages; those without an edit come back byte for byte. sheet is a sheet's number in
    its workbook. The last edit of a cell, by ord, wins. value_kind is number, text, bool, error, or clear, which empties a cell that
    is there. New texts are appended to the table of shared strings, which is made where there is none, and a text that is
    there as a plain one is used again; with inline texts go into cells. A changed workbook asks for all formulas to be worked out
    anew, and its chain of calculation goes, with its type and relationship. Refused edits, with _error, change nothing: BadCellRef,
    BadNumber, BadText, BadBool, UnknownError, UnknownCellType, SheetNotFound, or what is wrong with the sheet's part.
    """
    err = F.col("err") if "err" in edits.columns else F.lit(None).cast("string")
    columns = ["value_kind", "num", "text", "bool", "err"]
    asked = edits.select("path", F.col("sheet").cast("int").alias("sheet"), "row", "col", "ord", "value_kind", F.col("num").cast("double").alias("num"), "text", "bool", err.alias("err"))
    judged = stored(asked.withColumn("_error", cell_fault(asked)))
    some = found.join(judged.select("path").distinct(), "path", "left_semi")
    rows = stored(book_rows(some, kinds={"sheet", "node", "item"}))  # no cells, which edits meet in their parts
    nodes, items = rows_of(rows, "node"), rows_of(rows, "item")
    names = rows.filter("kind = 'sheet'").select("path", "part", markup.part_key(F.col("part")).alias("_key"))
    listed = stored(workbook_sheets(nodes).select("path", F.col("ord").alias("sheet"), markup.part_key(F.col("part")).alias("_key")).join(names, ["path", "_key"]).select("path", "sheet", "part"))
    known = judged.join(listed, ["path", "sheet"], "left").withColumn("_error", F.coalesce("_error", F.when(F.col("part").isNull(), "SheetNotFound")))
    last = known.filter("_error IS NULL").groupBy(*_AT).agg(F.max_by(F.struct(*columns), "ord").alias("e")).select(*_AT, "e.*")
    last = stored(last)
    unread = stored(part_faults(some, last))
    known = known.join(unread, _PART, "left").withColumn("_error", F.coalesce("_error", "_fault")).drop("_fault")
    good = stored(last.join(unread, _PART, "left_anti"))

    # Small tables that much follows from are written, so that each is worked out once.
    changed = stored(workbook_parts(nodes).filter("part IS NOT NULL").join(good.select("path").distinct(), "path", "left_semi"))
    rels = stored(relationships(nodes.filter("lower(part) LIKE '%.rels'")))
    tables = stored(string_parts(nodes, items))
    placed, pieces, new_tables = _interned(some, good, items, tables, changed, inline)
    sheets = stored(splice_parts(some, stored(cell_pieces(placed))))

    # The workbook, its relationships and the types of parts.
    text = F.decode("bytes", "utf-8")
    marked = named_parts(some, changed).select(*_PART, mark_full_recalc(text).cast("binary").alias("bytes"))
    chains = stored(calc_chains(changed, rels, rows.filter("part IS NOT NULL").select(*_PART).unionByName(rels.filter("resolved LIKE '%alcChain%'").select("path", F.col("resolved").alias("part"))).distinct()))
    own_rels = changed.select("path", F.col("part").alias("owner"), markup.rels_part(F.col("part")).alias("part"))
    rel_events = stored(xml_events(_small_part(some, own_rels, _NO_RELS)))
    type_events = stored(xml_events(_small_part(some, changed.select("path", F.lit(_TYPES).alias("part")), "<Types/>")))
    key = markup.part_key
    gone = chains.select("path", key(F.col("part")).alias("_key"))
    owners = own_rels.select("path", "owner")
    target = attributes(rel_events).filter("qname = 'Target'").join(owners, "path").select(*_PART, "node_id", "path", key(markup.resolve_target(F.col("owner"), F.col("value"))).alias("_key")).join(gone, ["path", "_key"]).select(rel_events["path"], "part", "node_id")
    over = attributes(type_events).filter("qname = 'PartName'").select(*_PART, "node_id", key(F.col("value")).alias("_key")).join(gone, ["path", "_key"]).select(*_PART, "node_id")
    numbers = next_rel_number(rels.join(own_rels.select("path", "owner"), ["path", "owner"], "left_semi")).select("path", "owner", "n")
    more_rels = _roots(rel_events).join(new_tables.select("path", "owner"), "path").join(numbers, ["path", "owner"], "left").select(*_PART, "node_id", new_element(F.concat("prefix", F.lit("Relationship")), [("Id", F.concat(F.lit("rId"), F.coalesce("n", F.lit(1)).cast("string"))), ("Type", F.lit(_STRINGS_REL)), ("Target", F.lit("sharedStrings.xml"))]).alias("xml"))
    more_types = _roots(type_events).join(new_tables.select("path", F.col("part").alias("table")), "path").select(*_PART, "node_id", new_element(F.concat("prefix", F.lit("Override")), [("PartName", F.col("table")), ("ContentType", F.lit(_STRINGS_TYPE))]).alias("xml"))
    new_rels = serialize(append_children(stored(remove_nodes(rel_events, target)), more_rels))
    new_types = serialize(append_children(stored(remove_nodes(type_events, over)), more_types))
    parts = sheets
    for more in (pieces, marked, new_rels, new_types, chains.select(*_PART, F.lit(None).cast("binary").alias("bytes"))):
        parts = parts.unionByName(more)
    return save_packages(found, stored(parts)), known.filter("_error IS NOT NULL").select("path", "sheet", "row", "col", "ord", *columns, "_error")


def _interned(found: DataFrame, good: DataFrame, items: DataFrame, tables: DataFrame, books: DataFrame, inline: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """good with idx of their texts, the tables of strings (path, part, bytes) that hold them, and those (path, part, owner) that are new."""
    if inline:
        none = good.sparkSession.createDataFrame([], "path string, part string, bytes binary, owner string")
        return good.withColumn("idx", F.lit(None).cast("long")), none.select(*_PART, "bytes"), none.select(*_PART, "owner")
    there = shared_strings(items.join(tables, _PART, "left_semi")).select("path", "idx", "text", "simple")
    wanted = good.filter("value_kind = 'text'").select("path", "text").distinct()
    every = stored(intern_strings(there, wanted).join(there.select("path", "idx", "simple"), ["path", "idx"], "left"))
    usable = every.filter("simple IS NULL OR simple").groupBy("path", "text").agg(F.min("idx").alias("idx"))
    placed = good.join(usable.withColumn("value_kind", F.lit("text")), ["path", "text", "value_kind"], "left")
    fresh = every.filter("simple IS NULL").select("path", "idx", "text")
    all_tables = books.select("path", F.col("part").alias("owner")).join(fresh.select("path").distinct(), "path", "left_semi").join(tables, "path", "left")
    all_tables = all_tables.select("path", "owner", F.coalesce("part", markup.resolve_target(F.col("owner"), F.lit("sharedStrings.xml"))).alias("part"), F.col("part").isNull().alias("is_new"))
    events = stored(xml_events(_small_part(found, all_tables.select(*_PART), _NO_STRINGS)))
    roots = _roots(events)
    counts = roots.select(*_PART, "node_id", F.explode(F.array(F.lit("count"), F.lit("uniqueCount"))).alias("qname"), F.lit(None).cast("string").alias("value"))  # readers count for themselves
    added = fresh.join(roots, "path").select(*_PART, "node_id", F.col("idx").alias("ord"), new_element(F.concat("prefix", F.lit("si")), [], _plain_text(F.concat("prefix", F.lit("t")), F.col("text"))).alias("xml"))
    return placed, serialize(append_children(stored(set_attributes(events, counts)), added)), all_tables.filter("is_new").select(*_PART, "owner")


# The elements of a font, in the order of the schema.
_FONT_ORDER = ("b", "i", "strike", "condense", "extend", "outline", "shadow", "u", "vertAlign", "sz", "color", "name", "family", "charset", "scheme")


def _listed(events: DataFrame, starts: DataFrame, holder: str, item: str) -> DataFrame:
    """path, part, node_id, prefix, id: the elements `item` in the list `holder`, numbered from 0."""
    lists = starts.filter((F.col("local") == holder) & (F.col("depth") == 1)).select(*_PART, F.col("node_id").alias("parent_id"))
    found = starts.filter(F.col("local") == item).join(lists, [*_PART, "parent_id"])
    return found.select(*_PART, "node_id", "prefix", (F.row_number().over(Window.partitionBy(*_PART).orderBy("node_id")) - 1).cast("long").alias("id"))  # formats of one package


def _inside(events: DataFrame, starts: DataFrame, items: DataFrame) -> DataFrame:
    """path, part, id, local, print, xml of the elements right in items: how each is spelled, and a print that spelling of attributes does not change."""
    kids = starts.select(*_PART, F.col("node_id").alias("kid"), F.col("parent_id").alias("node_id"), "local").join(items.select(*_PART, "node_id", "id"), [*_PART, "node_id"]).select(*_PART, F.col("kid").alias("node_id"), "id", "local")
    said = attributes(events).join(kids.select(*_PART, "node_id"), [*_PART, "node_id"]).groupBy(*_PART, "node_id").agg(F.array_sort(F.collect_list(F.concat("qname", F.lit("="), "value"))).alias("said"))
    whole = subtrees(events, kids)
    inner = F.regexp_replace("xml", r"^<[^>]*>", "")
    joined = kids.join(whole, [*_PART, "node_id"]).join(said, [*_PART, "node_id"], "left")
    closed = F.col("xml").endswith("/>") & (inner == "")
    plain = F.when(closed | inner.rlike(r"^</[^>]*>$"), "").otherwise(inner)
    return joined.select(*_PART, "id", "node_id", "local", F.concat_ws("\n", "local", F.concat_ws("\n", "said"), plain).alias("print"), "xml")


def _print_of(kids: DataFrame, keys: list[str]) -> DataFrame:
    """keys and print of whole elements: those of what is in them, in no order, and xml: what is in them, in the schema's."""
    place = F.coalesce(F.array_position(F.lit(list(_FONT_ORDER)), F.col("local")), F.lit(0))
    order = F.when(place == 0, 99).otherwise(place)
    return kids.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("print")), "\0").alias("print"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "xml"))), lambda x: x["xml"]), "").alias("inner"))


def _numbered(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, part, print, id, fresh of each print of wanted: the smallest id that known (path, part, print, id) has for it, or one after its last."""
    there = known.groupBy(*_PART, "print").agg(F.min("id").alias("old"))
    last = known.groupBy(*_PART).agg((F.max("id") + 1).alias("base"))
    new = wanted.select(*_PART, "print").distinct().join(there, [*_PART, "print"], "left").join(last, _PART, "left")
    at = F.sum(F.when(F.col("old").isNull(), 1).otherwise(0)).over(Window.partitionBy(*_PART).orderBy("print"))  # formats of one package
    return new.select(*_PART, "print", F.coalesce("old", F.coalesce("base", F.lit(0)) + at - 1).alias("id"), F.col("old").isNull().alias("fresh"))


@measured_joins
def save_fonts(found: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages (path, content) after edits of fonts (path, sheet, row, col, name, size, bold, italic, underline; null keeps), and the edits refused.

    A cell gets a format like its own but for the font, which is like its own but for what the edit says: elements this library
    knows nothing of stay. Fonts and formats are compared by all that is in them, however it is spelled; the first that is equal is used
    again, others are appended to the part of styles. A cell that is not there is made. One edit for each cell. Refused, with
    _error: BadFontSize, BadFontName, BadCellRef, SheetNotFound, StylesNotFound, or what is wrong with a part.
    """
    wants = ["name", "size", "bold", "italic", "underline"]
    asked = edits.select("path", F.col("sheet").cast("int").alias("sheet"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("name"), F.col("size").cast("double").alias("size"), "bold", "italic", "underline")
    outside = ~F.col("row").between(0, MAX_ROW) | ~F.col("col").between(0, MAX_COL)
    judged = stored(asked.withColumn("_error", F.when(outside, "BadCellRef").otherwise(font_fault(F.col("name"), F.col("size")))))
    some = found.join(judged.select("path").distinct(), "path", "left_semi")
    rows = stored(book_rows(some, kinds={"sheet", "node"}))
    nodes = rows_of(rows, "node")
    names = rows.filter("kind = 'sheet'").select("path", "part", markup.part_key(F.col("part")).alias("_key"))
    listed = stored(workbook_sheets(nodes).select("path", F.col("ord").alias("sheet"), markup.part_key(F.col("part")).alias("_key")).join(names, ["path", "_key"]).select("path", "sheet", "part"))
    rels = relationships(nodes.filter("lower(part) LIKE '%.rels'")).filter(F.col("type").endswith("/styles") & F.col("resolved").isNotNull())
    books = workbook_parts(nodes).filter("part IS NOT NULL").select("path", F.col("part").alias("owner"))
    style_parts = rels.join(books, ["path", "owner"], "left_semi").groupBy("path").agg(F.min_by("resolved", "ord").alias("part"))
    events = stored(xml_events(named_parts(some, style_parts)))
    styled = events.groupBy("path", F.col("part").alias("styles")).agg(F.max("_error").alias("_fault"))
    known = judged.join(listed, ["path", "sheet"], "left").join(styled, "path", "left")
    known = stored(known.withColumn("_error", F.coalesce("_error", F.when(F.col("part").isNull(), "SheetNotFound").when(F.col("styles").isNull(), "StylesNotFound"), "_fault")).drop("_fault"))
    unread = stored(part_faults(some, known.filter("_error IS NULL")))
    known = known.join(unread, _PART, "left").withColumn("_error", F.coalesce("_error", "_fault")).drop("_fault")
    good = stored(known.filter("_error IS NULL").drop("_error"))

    starts = stored(_prefixed(events.filter("_error IS NULL")).select(*_PART, "node_id", "parent_id", "depth", "prefix", "local"))
    fonts, xfs = stored(_listed(events, starts, "fonts", "font")), stored(_listed(events, starts, "cellXfs", "xf"))
    font_kids, xf_kids = stored(_inside(events, starts, fonts)), stored(_inside(events, starts, xfs))
    said = stored(attributes(events).join(xfs.select(*_PART, "node_id", "id"), [*_PART, "node_id"]).select(*_PART, "id", "qname", "value"))
    font_of = said.filter("qname = 'fontId'").select("path", F.col("id").alias("xf"), F.col("value").try_cast("long").alias("font"))
    now = stored(asked_formats(some, good))
    cells = good.join(now, ["path", "part", "row", "col"], "left").withColumn("xf", F.coalesce(values.parse_index(F.col("s")), F.lit(0))).join(font_of, ["path", "xf"], "left").withColumn("font", F.coalesce("font", F.lit(0)))
    kinds = stored(cells.select("path", "styles", "xf", "font", *wants).distinct().withColumn("kind", F.xxhash64("xf", "font", *wants)))

    # The fonts that are wanted: what is in the old one, with some elements in place of others.
    prefix = starts.filter("depth = 0").select("path", F.col("part").alias("styles"), "prefix")
    changes = {"sz": (F.col("size").isNotNull(), F.col("size").isNotNull(), values.stored_number(F.col("size"))), "name": (F.col("name").isNotNull(), F.col("name").isNotNull(), F.col("name")), "scheme": (F.col("name").isNotNull(), F.lit(False), F.lit(None).cast("string"))}
    changes |= {tag: (F.col(c).isNotNull(), F.coalesce(F.col(c), F.lit(False)), F.lit(None).cast("string")) for tag, c in (("b", "bold"), ("i", "italic"), ("u", "underline"))}
    gone = F.array_compact(F.array(*[F.when(off, F.lit(tag)) for tag, (off, _, _) in changes.items()]))
    made = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(tag).alias("local"), value.alias("val"))) for tag, (_, on, value) in changes.items()]))
    keys = ["path", "part", "kind", "xf"]
    base = kinds.withColumnRenamed("styles", "part").withColumn("gone", gone).withColumn("made", made)
    kept = base.join(font_kids.withColumnRenamed("id", "font"), ["path", "part", "font"]).filter(~F.array_contains("gone", F.col("local"))).select(*keys, "local", "print", "xml")
    fresh = base.join(prefix.withColumnRenamed("styles", "part"), ["path", "part"]).select(*keys, "prefix", F.explode("made").alias("m"))
    said_so = F.coalesce(F.concat(F.lit("val="), F.col("m.val")), F.lit(""))
    fresh = fresh.select(*keys, F.col("m.local").alias("local"), F.concat_ws("\n", "m.local", said_so, F.lit("")).alias("print"), new_element(F.concat("prefix", F.col("m.local")), [("val", F.col("m.val"))]).alias("xml"))
    wanted = base.select(*keys).join(_print_of(kept.unionByName(fresh), keys), keys, "left").na.fill("", ["print", "inner"])
    all_fonts = fonts.select(*_PART, "id").join(_print_of(font_kids, [*_PART, "id"]), [*_PART, "id"], "left").na.fill("", ["print", "inner"])
    font_ids = stored(_numbered(all_fonts, wanted))
    wanted = stored(wanted.join(font_ids, [*_PART, "print"]).select(*keys, F.col("id").alias("font"), F.col("fresh").alias("new_font"), F.col("inner").alias("font_inner")))

    # The formats: attributes and what is in the old one, with the font.
    xf_inner = _print_of(xf_kids, [*_PART, "id"]).select("path", "part", F.col("id").alias("xf"), "print", "inner")
    pairs = said.groupBy(*_PART, F.col("id").alias("xf")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qname", "value")))).alias("said"))
    with_font = F.map_concat(F.map_filter(F.coalesce("said", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("fontId", "applyFont")), F.create_map(F.lit("fontId"), F.col("font").cast("string"), F.lit("applyFont"), F.lit("1")))
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")
    formats = wanted.join(pairs, [*_PART, "xf"], "left").join(xf_inner, [*_PART, "xf"], "left").withColumn("said", with_font).withColumn("print", F.concat_ws("\n\n", shown(F.col("said")), F.coalesce("print", F.lit("")))).withColumn("inner", F.coalesce("inner", F.lit("")))
    old = pairs.join(xf_inner, [*_PART, "xf"], "left").select(*_PART, F.concat_ws("\n\n", shown(F.col("said")), F.coalesce("print", F.lit(""))).alias("print"), F.col("xf").alias("id"))
    format_ids = stored(_numbered(old, formats))
    formats = stored(formats.join(format_ids, [*_PART, "print"]))

    # What is appended to the two lists, with their counts where they say one.
    root = prefix.withColumnRenamed("styles", "part")
    new_fonts = wanted.filter("new_font").dropDuplicates([*_PART, "font"]).join(root, _PART).select(*_PART, F.lit("fonts").alias("local"), F.col("font").alias("ord"), new_element(F.concat("prefix", F.lit("font")), [], F.col("font_inner")).alias("xml"))
    text = F.array_join(F.transform(F.map_entries("said"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), markup.escape_attr(e["value"], '"'), F.lit('"'))), "")
    head = F.concat(F.lit("<"), "prefix", F.lit("xf"), text)
    new_xfs = formats.filter("fresh").dropDuplicates([*_PART, "id"]).join(root, _PART).select(*_PART, F.lit("cellXfs").alias("local"), F.col("id").alias("ord"), F.when(F.col("inner") == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), "inner", F.lit("</"), "prefix", F.lit("xf>"))).alias("xml"))
    lists = starts.filter("depth = 1 AND local IN ('fonts', 'cellXfs')").select(*_PART, "node_id", "local")
    pieces = stored(new_fonts.unionByName(new_xfs).join(lists, [*_PART, "local"]))
    added = pieces.groupBy(*_PART, "node_id").agg(F.count("*").alias("more"))
    counts = attributes(events).filter("qname = 'count'").join(added, [*_PART, "node_id"]).select(*_PART, "node_id", "qname", (F.col("value").try_cast("long") + F.col("more")).cast("string").alias("value")).filter("value IS NOT NULL")
    new_styles = serialize(append_children(stored(set_attributes(events.filter("_error IS NULL"), counts)), pieces.select(*_PART, "node_id", "xml", "ord")))

    by_cell = cells.withColumn("kind", F.xxhash64("xf", "font", *wants)).join(formats.select("path", "kind", "xf", F.col("id").alias("style")), ["path", "kind", "xf"])
    none = {"num": "double", "text": "string", "bool": "boolean", "err": "string", "idx": "long"}
    restyled = stored(by_cell.select("path", "part", "row", "col", F.lit("style").alias("value_kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.col("style").cast("string").alias("s")))
    new_sheets = splice_parts(some, cell_pieces(restyled))
    return save_packages(found, stored(new_sheets.unionByName(new_styles.join(pieces.select(*_PART).distinct(), _PART, "left_semi")))), known.filter("_error IS NOT NULL").select("path", "sheet", "row", "col", *wants, "_error")
