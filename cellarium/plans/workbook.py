"""Tables of a workbook from its packages: relationships, content types, sheets, strings, cells, styles, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.functions import markup, values
from cellarium.functions.addresses import a1, parse_range, row_index
from cellarium.functions.formulas import translate_formula
from cellarium.functions.styles import is_date_format
from cellarium.operators.package_edits import main_parts
from cellarium.sources.books import book_rows, rows_of
from cellarium.sources.packages import spreadsheet_nodes
from cellarium.sources.tables import stored

# Types of relationships.
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def attr(name: str, of: str = "attrs") -> Column:
    return F.try_element_at(F.col(of), F.lit(name))


def relationships(nodes: DataFrame) -> DataFrame:
    """path, owner, ord, id, type, target, mode, resolved from the nodes of .rels parts; external targets resolve to null."""
    rels = nodes.filter("local = 'Relationship'").select("path", markup.rels_owner(F.col("part")).alias("owner"), "ord", attr("Id").alias("id"), attr("Type").alias("type"), attr("Target").alias("target"), F.coalesce(attr("TargetMode"), F.lit("Internal")).alias("mode"))
    return rels.withColumn("resolved", F.when(F.col("mode") == "Internal", markup.resolve_target(F.col("owner"), F.col("target"))))


def content_types(part_names: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """part_names (path, part) with content_type: an override of the part, else the default of its extension, else null."""
    key, ext = markup.part_key(F.col("part")), markup.part_key(markup.part_extension(F.col("part")))
    o = overrides.groupBy("path", markup.part_key(F.col("part")).alias("_key")).agg(F.first("ct").alias("_o"))
    d = defaults.groupBy("path", markup.part_key(F.col("ext")).alias("_ext")).agg(F.first("ct").alias("_d"))
    joined = part_names.withColumn("_key", key).withColumn("_ext", ext).join(o, ["path", "_key"], "left").join(d, ["path", "_ext"], "left")
    return joined.withColumn("content_type", F.coalesce("_o", "_d")).drop("_key", "_ext", "_o", "_d")


def duplicate_parts(part_names: DataFrame) -> DataFrame:
    """path, key, n of part names that differ at most in the case of A-Z."""
    return part_names.groupBy("path", markup.part_key(F.col("part")).alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(rels: DataFrame, part_names: DataFrame) -> DataFrame:
    """Internal relationships whose target is no part."""
    targets = rels.filter("mode = 'Internal'").withColumn("_key", markup.part_key(F.col("resolved")))
    there = part_names.select("path", markup.part_key(F.col("part")).alias("_key")).distinct()
    return targets.join(there, ["path", "_key"], "left_anti").drop("_key")


def sheets(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """path, ord, name, sheet_id, rel_id, part, state of the sheets of workbook parts, in their order."""
    s = nodes.filter("local = 'sheet'").select("path", F.col("part").alias("owner"), "ord", attr("name").alias("name"), F.coalesce(values.parse_index(attr("sheetId")), F.lit(0)).alias("sheet_id"), attr(f"{_OFFICE}#id").alias("rel_id"), attr("state").alias("state"))
    first = rels.groupBy("path", "owner", F.col("id").alias("rel_id")).agg(F.min_by("resolved", "ord").alias("part"))
    known = F.when(F.col("state").isin("hidden", "veryHidden"), F.col("state")).otherwise("visible")
    return s.join(first, ["path", "owner", "rel_id"], "left").select("path", "ord", "name", "sheet_id", "rel_id", "part", known.alias("state"))


def shared_strings(items: DataFrame) -> DataFrame:
    """path, part, idx, text, runs, preserved, simple of string_items(), escapes undone; items with an error are left out."""
    return items.filter("_error IS NULL").select("path", "part", "idx", markup.decode_x_escapes(F.col("text")).alias("text"), "runs", "preserved", "simple")


def typed_cells(raw: DataFrame, strings: DataFrame) -> DataFrame:
    """Cells of sheet_cells() with their values: storage types, and the shared strings (path, idx, text) they name.

    _error names what is wrong with a cell, a row or a part. Rows without cells are left out unless something is wrong.
    """
    cells = raw.filter("cell_ord IS NOT NULL OR _error IS NOT NULL").withColumn("ty", F.when(F.col("cell_ord").isNotNull(), values.parse_type(F.col("t"))))
    cells = cells.withColumn("idx", F.when(F.col("ty") == "s", values.parse_index(F.col("v"))))
    # Cells without an index have keys of their own, which no string has, so that they do not meet in one task.
    key = F.coalesce("idx", -1 - F.pmod(F.hash("row", "col"), F.lit(4096)).cast("long"))
    cells = cells.withColumn("_idx", key).join(strings.select("path", F.col("idx").alias("_idx"), F.col("text").alias("shared")), ["path", "_idx"], "left")
    number, truth, error = values.parse_number(F.col("v")), values.parse_bool(values.trimmed(F.col("v"))), values.parse_error(values.trimmed(F.col("v")))
    inline, style, index = F.col("is_text").isNotNull(), values.parse_index(F.col("s")), values.parse_index(F.col("f_si"))
    area = parse_range(F.col("f_ref"))
    kind = (
        F.when(F.col("ty").isNull(), None)
        .when(inline, "text")
        .when(F.col("v").isNull() | (F.col("ty") == "n") & values.is_blank(F.col("v")), "empty")
        .when(F.col("ty") == "n", "number")
        .when(F.col("ty") == "b", "bool")
        .when(F.col("ty") == "e", "error")
        .otherwise("text")
    )
    text = F.when(inline, markup.decode_x_escapes(F.col("is_text"))).when(F.col("ty") == "s", F.col("shared")).otherwise(markup.decode_x_escapes(F.col("v")))
    fault = (
        F.when(F.col("_error").isNotNull(), F.col("_error"))
        .when(F.col("ty").isNull(), "UnknownCellType")
        .when(F.col("s").isNotNull() & style.isNull(), "BadStyle")
        .when(F.col("f_ref").isNotNull() & area.isNull() | F.col("f_si").isNotNull() & index.isNull(), "BadFormula")
        .when((kind == "text") & (F.col("ty") == "s") & ~inline & F.col("shared").isNull(), "SharedStringOutOfRange")
        .when((kind == "number") & number.isNull(), "BadNumber")
        .when((kind == "bool") & truth.isNull(), "BadBool")
        .when((kind == "error") & error.isNull(), "UnknownError")
    )
    f_kind = F.when(F.col("f_text").isNotNull(), F.when((F.col("f_t") == "shared") & index.isNotNull(), "shared").when(F.col("f_t") == "array", "array").when(F.col("f_t") == "dataTable", "dataTable").otherwise("normal"))
    own = F.struct(F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("row").alias("r1"), F.col("col").alias("c1"))
    return cells.select(
        "path", "part", "row", "col", a1("row", "col").alias("a1"), "ty", kind.alias("value_kind"), F.when(kind == "number", number).alias("num"), F.when(kind == "text", text).alias("text"), F.when(kind == "bool", truth).alias("bool"), F.when(kind == "error", error).alias("err"), style.alias("style"),
        "f_text", f_kind.alias("f_kind"), F.when(f_kind == "shared", index).alias("f_si"), F.when(f_kind == "array", F.coalesce(area, own)).otherwise(F.when(f_kind == "shared", area)).alias("f_range"), fault.alias("_error"),
    )


def is_shared_follower(cells: DataFrame) -> Column:
    """Whether a cell's formula is that of its group's master, moved."""
    return (cells["f_kind"] == "shared") & cells["f_range"].isNull()


def expand_shared(cells: DataFrame) -> DataFrame:
    """cells with the formula of each follower of a shared group: its master's, translated by the distance between them."""
    master = cells.filter("f_kind = 'shared' AND f_range IS NOT NULL").groupBy("path", "part", "f_si").agg(F.min_by(F.struct("f_text", "row", "col"), F.struct("row", "col")).alias("m"))
    # Cells without a group have keys of their own, which no master has.
    key = lambda: F.coalesce("f_si", -1 - F.pmod(F.hash("row", "col"), F.lit(4096)).cast("long"))
    joined = cells.withColumn("_si", key()).join(master.withColumnRenamed("f_si", "_si"), ["path", "part", "_si"], "left")
    moved = translate_formula(F.col("m.f_text"), F.col("row") - F.col("m.row"), F.col("col") - F.col("m.col"))
    follows = (F.col("f_kind") == "shared") & F.col("f_range").isNull() & F.col("m").isNotNull()
    return joined.withColumn("f_text", F.when(follows, moved).otherwise(F.col("f_text"))).select(cells.columns)


def sheet_stats(raw: DataFrame, by: list[str]) -> DataFrame:
    """Counts over sheet_cells(): rows and cells and how many have no place of their own, formulas, inline texts, extents.

    faults is how many rows, cells and parts have an _error, which is one of theirs. What has no place is in no extent; where a part
    can't be read to its end there are no counts at all, for those of its first rows would look like those of the whole.
    """
    unread = F.col("_error").isNotNull() & F.col("row_ord").isNull()
    rows = raw.groupBy(*by, "row_ord").agg(F.max(unread).alias("unread"), F.count("_error").alias("faults"), F.max("_error").alias("_error"), F.count("cell_ord").alias("cells"), F.first("row_r").isNull().cast("int").alias("bare"), F.count(F.when(F.col("cell_ord").isNotNull() & F.col("cell_r").isNull(), 1)).alias("bare_cells"), F.count("f_text").alias("formulas"), F.count("is_text").alias("inline"), F.max(F.when(F.col("cell_ord").isNotNull(), F.col("row"))).alias("max_row"), F.max("col").alias("max_col"))
    counts = {"rows": F.count("*"), "rows_without_r": F.sum("bare"), "cells": F.sum("cells"), "cells_without_r": F.sum("bare_cells"), "formulas": F.sum("formulas"), "inline_strings": F.sum("inline"), "max_row": F.max("max_row"), "max_col": F.max("max_col")}
    return rows.groupBy(*by).agg(*[F.when(~F.max("unread"), n).alias(c) for c, n in counts.items()], F.sum("faults").alias("faults"), F.coalesce(F.max(F.when(F.col("unread"), F.col("_error"))), F.max("_error")).alias("_error"))


def dimensions(nodes: DataFrame) -> DataFrame:
    """path, part, r0, c0, r1, c1 of the range that a sheet declares for itself."""
    return nodes.filter("local = 'dimension'").select("path", "part", parse_range(attr("ref")).alias("x")).filter("x IS NOT NULL").select("path", "part", "x.*")


def grid_lines(nodes: DataFrame) -> DataFrame:
    """path, part, grid_lines: shown unless the first view says otherwise."""
    views = nodes.filter("local = 'sheetView'").groupBy("path", "part").agg(F.min_by(attr("showGridLines"), "node_id").alias("shown"))
    sheets_ = nodes.filter("local = 'worksheet'").select("path", "part").distinct()
    return sheets_.join(views, ["path", "part"], "left").select("path", "part", F.coalesce(values.parse_bool(F.col("shown")), F.lit(True)).alias("grid_lines"))


def merges(nodes: DataFrame) -> DataFrame:
    """path, part, ord, r0, c0, r1, c1 of merged ranges."""
    return nodes.filter("local = 'mergeCell'").select("path", "part", "ord", parse_range(attr("ref")).alias("x")).select("path", "part", "ord", "x.*")


def layout(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Column spans (path, part, ord, c0, c1, width, hidden) and rows (path, part, row, height, hidden)."""
    on = lambda name: F.coalesce(values.parse_bool(attr(name)), F.lit(False))
    cols = nodes.filter("local = 'col'").select("path", "part", "ord", (values.parse_index(attr("min")) - 1).alias("c0"), (values.parse_index(attr("max")) - 1).alias("c1"), values.parse_number(attr("width")).alias("width"), on("hidden").alias("hidden"))
    rows = nodes.filter("local = 'row'").select("path", "part", row_index(attr("r")).alias("row"), values.parse_number(attr("ht")).alias("height"), on("hidden").alias("hidden")).filter("row IS NOT NULL")
    return cols, rows


def number_formats(nodes: DataFrame) -> DataFrame:
    """path, num_fmt_id, code, is_date of the custom formats of a styles part."""
    return nodes.filter("local = 'numFmt'").select("path", values.parse_index(attr("numFmtId")).alias("num_fmt_id"), attr("formatCode").alias("code"), is_date_format(attr("formatCode")).alias("is_date"))


def cell_formats(nodes: DataFrame) -> DataFrame:
    """path, style, num_fmt_id, font_id, fill_id, border_id and apply flags of cellXfs."""
    lists = nodes.filter("local = 'cellXfs'").select("path", "part", F.col("node_id").alias("parent_id"))
    flag = lambda name: F.coalesce(values.parse_bool(attr(name)), F.lit(True))
    xfs = nodes.filter("local = 'xf'").join(lists, ["path", "part", "parent_id"])
    ids = [F.coalesce(values.parse_index(attr(f"{n}Id")), F.lit(0)).alias(c) for n, c in (("numFmt", "num_fmt_id"), ("font", "font_id"), ("fill", "fill_id"), ("border", "border_id"))]
    return xfs.select("path", F.col("ord").cast("long").alias("style"), *ids, flag("applyFont").alias("apply_font"), flag("applyFill").alias("apply_fill"), flag("applyBorder").alias("apply_border"))


def workbook_parts(nodes: DataFrame) -> DataFrame:
    """path and part (null without one) of each package's workbook, from the nodes of its relationships and workbook parts."""
    found = spreadsheet_nodes(nodes).filter("local = 'workbook' AND depth = 0").select("path", "part")
    return main_parts(nodes, relationships(nodes.filter("lower(part) LIKE '%.rels'")), found, "/officeDocument", "/", "/xl/workbook.xml")


def workbook_sheets(nodes: DataFrame) -> DataFrame:
    """sheets() of each package's main part, from the nodes of its relationships and workbook parts; owner is the main part."""
    books = spreadsheet_nodes(nodes.filter("lower(part) NOT LIKE '%.rels'"))
    own = books.join(workbook_parts(nodes).filter("part IS NOT NULL"), ["path", "part"], "left_semi")
    return sheets(own, relationships(nodes.filter("lower(part) LIKE '%.rels'")))


def string_parts(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """path and part of the table of shared strings that each package's main part names, or of the usual one."""
    rels = relationships(nodes.filter("lower(part) LIKE '%.rels'"))
    books = nodes.filter("local = 'workbook' AND depth = 0").select("path", "part")
    owner = main_parts(nodes, rels, books, "/officeDocument", "/", "/xl/workbook.xml").select("path", F.col("part").alias("owner"))
    there = items.select("path", "part").distinct()
    return main_parts(nodes, rels.join(owner, ["path", "owner"], "left_semi"), there, "/sharedStrings", None, "/xl/sharedStrings.xml").filter("part IS NOT NULL")


def read_cells(found: DataFrame) -> DataFrame:
    """All typed cells of packages (path, content), with the name and number of their sheet.

    The sheets and the table of strings are those that relationships lead to, whatever their names, and names of parts are equal
    if they differ in the case of A-Z only. What can't be read is a row with _error: an archive (no part), a workbook that is
    not there (WorkbookNotFound), a sheet whose relationship or part is not there (SheetNotFound), a part that ends too soon or
    is no XML. Packages are read once.
    """
    return cells_of_books(stored(book_rows(found)))


def cells_of_books(rows: DataFrame) -> DataFrame:
    """read_cells() of the rows of book_rows(), which are read several times."""
    nodes, items = rows_of(rows, "node"), rows_of(rows, "item")
    listed = stored(workbook_sheets(nodes)).withColumn("_key", markup.part_key(F.col("part"))).select("path", "_key", F.col("name").alias("sheet_name"), F.col("ord").alias("sheet"))
    strings = shared_strings(items.join(string_parts(nodes, items), ["path", "part"], "left_semi"))
    cells = typed_cells(rows_of(rows, "cell"), strings).withColumn("_key", markup.part_key(F.col("part")))
    own = cells.join(listed, ["path", "_key"]).drop("_key")
    # Faults of parts that matter, archives that can't be read, and what should be there and isn't.
    faults = rows.filter("kind = 'fault'").select("path", "part", markup.part_key(F.col("part")).alias("_key"), "_error")
    led_to = relationships(nodes.filter("lower(part) LIKE '%.rels'")).filter(F.col("type").endswith("/officeDocument") | F.col("type").endswith("/sharedStrings")).select("path", markup.part_key(F.col("resolved")).alias("_key"))
    wanted = listed.select("path", "_key").unionByName(led_to).unionByName(nodes.select("path", markup.part_key(F.col("part")).alias("_key"))).unionByName(items.select("path", markup.part_key(F.col("part")).alias("_key"))).distinct()
    fixed = F.col("_key").endswith(".rels") | F.col("_key").isin("/xl/workbook.xml", "/xl/sharedstrings.xml")
    bad = faults.filter(F.col("_key").isNull() | fixed).select("path", "part", "_error").unionByName(faults.filter(~fixed).join(wanted, ["path", "_key"], "left_semi").select("path", "part", "_error"))
    there = rows.filter("part IS NOT NULL AND kind IN ('sheet', 'fault')").select("path", markup.part_key(F.col("part")).alias("_key")).distinct()
    lost = listed.join(there, ["path", "_key"], "left_anti").select("path", "sheet_name", "sheet", F.lit("SheetNotFound").alias("_error"))
    unread = faults.filter("part IS NULL").select("path")
    books = workbook_parts(nodes).filter("part IS NOT NULL").select("path")
    bookless = rows.select("path").distinct().join(unread, "path", "left_anti").join(books, "path", "left_anti").select("path", F.lit("WorkbookNotFound").alias("_error"))
    out = own
    for more in (bad, lost, bookless):
        out = out.unionByName(more, allowMissingColumns=True)
    return out
