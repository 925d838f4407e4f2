"""Packages as HTML pages in one call: sheets, styles, merges, widths and heights come together here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.functions import markup
from cellarium.functions.styles import is_date_id
from cellarium.operators import appearance, grid
from cellarium.plans.workbook import cell_formats, cells_of_books, layout, merges, number_formats, relationships, workbook_parts, workbook_sheets
from cellarium.sources.books import book_rows, rows_of
from cellarium.sources.packages import named_parts, spreadsheet_nodes, xml_nodes
from cellarium.sources.tables import stored

# Fixed value: the width of a column in characters where nothing says one.
_WIDTH = 8.43


def book_pages(found: DataFrame, title: str = "Workbook", max_rows: int = 5000, max_cols: int = 256, hidden: bool = False) -> DataFrame:
    """path, html of packages (path, content): appearance.workbook_html() with all that a page shows, from the packages alone.

    Packages are read three times: for cells, for the layout of sheets, and for styles. A package that can't be read has no page.
    """
    rows = stored(book_rows(found))
    nodes = rows_of(rows, "node")
    sheets = stored(workbook_sheets(nodes).select("path", F.col("ord").alias("sheet"), "name", "state", "part"))
    key = markup.part_key(F.col("part"))
    numbers = sheets.select("path", "sheet", key.alias("_key"))
    inner = stored(spreadsheet_nodes(xml_nodes(named_parts(found, sheets.filter("part IS NOT NULL").select("path", "part")))).withColumn("_key", key).join(numbers, ["path", "_key"]).drop("_key"))
    part_of = inner.select("path", "part", "sheet").distinct()
    columns, heights = layout(inner)
    rels = relationships(nodes.filter("lower(part) LIKE '%.rels'")).filter(F.col("type").endswith("/styles") & F.col("resolved").isNotNull())
    owners = workbook_parts(nodes).select("path", F.col("part").alias("owner"))
    styles = stored(spreadsheet_nodes(xml_nodes(named_parts(found, rels.join(owners, ["path", "owner"], "left_semi").select("path", F.col("resolved").alias("part"))))))
    formats = cell_formats(styles)
    classes = appearance.style_classes(formats, appearance.fonts(styles), appearance.fills(styles), appearance.borders(styles))

    custom = number_formats(styles).groupBy("path", "num_fmt_id").agg(F.bool_or("is_date").alias("_custom"))
    dated = formats.select("path", "style", "num_fmt_id").join(custom, ["path", "num_fmt_id"], "left").select("path", "style", F.coalesce(is_date_id(F.col("num_fmt_id")) | F.coalesce("_custom", F.lit(False)), F.lit(False)).alias("is_date"))
    cells = cells_of_books(rows).filter("_error IS NULL").withColumn("style", F.coalesce("style", F.lit(0)))
    cells = cells.join(dated, ["path", "style"], "left").withColumn("is_date", F.coalesce("is_date", F.lit(False)))
    spans = columns.join(part_of, ["path", "part"])
    asked = cells.filter(F.col("col") < max_cols).groupBy("path", "sheet").agg(F.max("col").alias("last")).withColumn("col", F.explode(F.sequence(F.lit(0), "last"))).drop("last")  # at most max_cols a sheet
    widths = grid.column_widths(asked, spans, _WIDTH)
    merged = merges(inner).join(part_of, ["path", "part"]).filter("r0 IS NOT NULL").select("path", "sheet", "ord", "r0", "c0", "r1", "c1")
    high = heights.join(part_of, ["path", "part"]).filter("height IS NOT NULL OR hidden").select("path", "sheet", "row", "height", "hidden")
    return appearance.workbook_html(cells, sheets.drop("part"), classes, title, max_rows, max_cols, merged, widths, hidden, high)
