"""Fonts, fills and borders of styles parts, CSS classes of cell formats, and workbooks as HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.functions import markup, styles, values
from cellarium.operators.grid import html_rows

KEY = ["path", "part"]


def _attr(name: str, of: str = "attrs") -> Column:
    return F.try_element_at(F.col(of), F.lit(name))


def _items(nodes: DataFrame, holder: str, item: str) -> DataFrame:
    """path, part, item_id, id of the elements `item` in the list `holder`, numbered from 0."""
    lists = nodes.filter(F.col("local") == holder).select(*KEY, F.col("node_id").alias("parent_id"))
    return nodes.filter(F.col("local") == item).join(lists, [*KEY, "parent_id"]).select(*KEY, F.col("node_id").alias("item_id"), F.col("ord").alias("id"))


def _color(attrs: str) -> Column:
    return F.struct(*[_attr(k, attrs).alias(k) for k in ("rgb", "indexed", "theme", "tint")])


def fonts(nodes: DataFrame) -> DataFrame:
    """path, font_id, name, size, bold, italic, underline, strike, color (CSS)."""
    items = _items(nodes, "fonts", "font")
    kids = nodes.select(*KEY, F.col("parent_id").alias("item_id"), "local", "attrs")
    on = lambda *names: F.max(F.when(F.col("local").isin(*names), F.coalesce(values.parse_bool(_attr("val")), F.coalesce(_attr("val"), F.lit("")) != "none")))
    value = lambda *names: F.max(F.when(F.col("local").isin(*names), _attr("val")))
    found = items.join(kids, [*KEY, "item_id"], "left").groupBy("path", F.col("id").alias("font_id")).agg(
        value("name", "rFont").alias("name"), values.parse_number(value("sz")).alias("size"), *[F.coalesce(on(tag), F.lit(False)).alias(name) for tag, name in (("b", "bold"), ("i", "italic"), ("u", "underline"), ("strike", "strike"))], F.max(F.when(F.col("local") == "color", styles.color_css(_color("attrs")))).alias("color")
    )
    return found


def fills(nodes: DataFrame) -> DataFrame:
    """path, fill_id, solid (CSS colour, null without a fill)."""
    items = _items(nodes, "fills", "fill")
    patterns = nodes.filter("local = 'patternFill'").select(*KEY, F.col("parent_id").alias("item_id"), F.col("node_id").alias("pattern_id"), _attr("patternType").alias("kind"))
    colors = nodes.filter("local = 'fgColor'").select(*KEY, F.col("parent_id").alias("pattern_id"), styles.color_css(_color("attrs")).alias("solid"))
    joined = items.join(patterns, [*KEY, "item_id"], "left").join(colors, [*KEY, "pattern_id"], "left")
    return joined.select("path", F.col("id").alias("fill_id"), F.when(F.coalesce("kind", F.lit("")) != "none", F.col("solid")).alias("solid"))


def borders(nodes: DataFrame) -> DataFrame:
    """path, border_id and CSS of left, right, top and bottom, null without a line."""
    items = _items(nodes, "borders", "border")
    edges = nodes.filter("local IN ('left', 'right', 'top', 'bottom')").select(*KEY, F.col("parent_id").alias("item_id"), F.col("node_id").alias("edge_id"), "local", _attr("style").alias("style"))
    colors = nodes.filter("local = 'color'").select(*KEY, F.col("parent_id").alias("edge_id"), styles.color_css(_color("attrs")).alias("color"))
    lines = items.join(edges, [*KEY, "item_id"], "left").join(colors, [*KEY, "edge_id"], "left").withColumn("css", F.concat_ws(" ", styles.border_css(F.col("style")), F.when(styles.border_css(F.col("style")).isNotNull(), F.coalesce("color", F.lit("currentColor")))))
    side = lambda name: F.nullif(F.max(F.when(F.col("local") == name, F.col("css"))), F.lit("")).alias(name)
    return lines.groupBy("path", F.col("id").alias("border_id")).agg(*[side(n) for n in ("left", "right", "top", "bottom")])


def style_classes(xfs: DataFrame, fonts: DataFrame, fills: DataFrame, borders: DataFrame) -> DataFrame:
    """path, style, css: the declarations of each cell format whose parts apply; formats without any are left out."""
    f = fonts.select("path", "font_id", F.col("name").alias("font"), "size", "bold", "italic", "underline", "strike", "color")
    x = xfs.withColumn("font_id", F.when(F.col("apply_font"), F.col("font_id"))).withColumn("fill_id", F.when(F.col("apply_fill"), F.col("fill_id"))).withColumn("border_id", F.when(F.col("apply_border"), F.col("border_id")))
    joined = x.join(f, ["path", "font_id"], "left").join(fills, ["path", "fill_id"], "left").join(borders, ["path", "border_id"], "left")
    when = lambda cond, *parts: F.when(cond, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    lines = F.concat_ws(" ", F.when(F.col("underline"), "underline"), F.when(F.col("strike"), "line-through"))
    css = F.concat_ws(
        "",
        when(F.col("bold"), "font-weight:700;"),
        when(F.col("italic"), "font-style:italic;"),
        when(lines != "", "text-decoration:", lines, ";"),
        when(F.col("size").isNotNull(), "font-size:", F.round(F.col("size") * 4 / 3).cast("long").cast("string"), "px;"),
        when(F.col("font").isNotNull(), "font-family:'", F.replace(F.col("font"), F.lit("'"), F.lit("")), "',sans-serif;"),
        when(F.col("color").isNotNull(), "color:", F.col("color"), ";"),
        when(F.col("solid").isNotNull(), "background:", F.col("solid"), ";"),
        *[when(F.col(n).isNotNull(), f"border-{n}:", F.col(n), ";") for n in ("left", "right", "top", "bottom")],
    )
    return joined.select("path", "style", css.alias("css")).filter("css <> ''")


def alignments(nodes: DataFrame) -> DataFrame:
    """path, style, horizontal, vertical, wrap of the cell formats; general and bottom where they say nothing."""
    lists = nodes.filter("local = 'cellXfs'").select(*KEY, F.col("node_id").alias("parent_id"))
    xfs = nodes.filter("local = 'xf'").join(lists, [*KEY, "parent_id"]).select(*KEY, F.col("node_id").alias("xf_id"), F.col("ord").cast("long").alias("style"))
    given = nodes.filter("local = 'alignment'").select(*KEY, F.col("parent_id").alias("xf_id"), _attr("horizontal").alias("h"), _attr("vertical").alias("v"), _attr("wrapText").alias("w"))
    joined = xfs.join(given, [*KEY, "xf_id"], "left")
    across = F.when(F.col("h").isin("left", "center", "right", "justify"), F.col("h")).when(F.col("h") == "centerContinuous", "center").when(F.col("h") == "distributed", "justify").otherwise("general")
    down = F.when(F.col("v") == "top", "top").when(F.col("v").isin("center", "distributed", "justify"), "center").otherwise("bottom")
    return joined.select("path", "style", across.alias("horizontal"), down.alias("vertical"), F.coalesce(values.parse_bool(F.col("w")), F.lit(False)).alias("wrap"))


def default_fonts(fonts: DataFrame) -> DataFrame:
    """The font of each package that cells without one have: number 0."""
    return fonts.filter("font_id = 0")


def has_no_lines(borders: DataFrame) -> DataFrame:
    """borders with is_empty: no line on any side."""
    return borders.withColumn("is_empty", F.coalesce("left", "right", "top", "bottom").isNull())


def workbook_html(cells: DataFrame, sheets: DataFrame, classes: DataFrame | None = None, title: str = "Workbook", max_rows: int = 5000, max_cols: int = 256, merges: DataFrame | None = None, columns: DataFrame | None = None, hidden: bool = False, heights: DataFrame | None = None) -> DataFrame:
    """path, html: a page for each workbook with a table for each visible sheet (sheets: path, sheet, name, state), or with
    hidden for each sheet.

    Tables show the rows and columns below max_rows and max_cols; more are left out, as a page is for reading. Cells show
    their style's class and dates, merged ranges span, columns (path, sheet, col, width in characters) set widths, and heights (path, sheet, row, height in
    points, hidden) those of rows.
    """
    rows = html_rows(cells, max_rows, max_cols, merges)
    if heights is not None:
        given = heights.groupBy("path", "sheet", "row").agg(F.max(F.when(F.col("hidden"), 0.0).otherwise(F.col("height"))).alias("_points"))
        pixels = styles.row_height_px(F.col("_points")).cast("long").cast("string")
        tall = F.concat(F.lit('<tr style="height:'), pixels, F.lit('px">'), F.substring("html", F.lit(5), F.length("html")))
        rows = rows.join(given, ["path", "sheet", "row"], "left").withColumn("html", F.when(F.col("_points").isNull(), F.col("html")).otherwise(tall)).drop("_points")
    table = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "html"))), lambda x: x["html"]), "\n")  # at most max_rows
    tables = rows.groupBy("path", "sheet").agg(table.alias("body"))
    shown = sheets.filter(F.lit(hidden) | (F.col("state") == "visible")).join(tables, ["path", "sheet"], "left")
    group = F.lit("")
    if columns is not None:
        pixels = styles.col_width_px(F.col("width"), F.lit(7.0)).cast("long").cast("string")
        col = F.concat(F.lit('<col style="width:'), pixels, F.lit('px">'))
        widths = columns.filter(F.col("col") < max_cols).groupBy("path", "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", col.alias("x")))), lambda x: x["x"]), "").alias("cols"))
        shown = shown.join(widths, ["path", "sheet"], "left")
        group = F.coalesce(F.concat(F.lit("<colgroup>"), F.col("cols"), F.lit("</colgroup>")), F.lit(""))
    section = F.concat(F.lit("<section><h2>"), markup.escape_html(F.col("name")), F.lit("</h2><table>"), group, F.coalesce("body", F.lit("")), F.lit("</table></section>"))
    pages = shown.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", section.alias("x")))), lambda x: x["x"]), "\n").alias("body"))
    css = F.lit("")
    if classes is not None:
        rule = F.concat(F.lit(".x"), F.col("style").cast("string"), F.lit("{"), F.col("css"), F.lit("}"))
        pages = pages.join(classes.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(rule)), "\n").alias("css")), "path", "left")
        css = F.coalesce("css", F.lit(""))
    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), markup.escape_html(F.lit(title)), F.lit("</title><style>"), css, F.lit("</style></head><body>"))
    return pages.select("path", F.concat(head, "body", F.lit("</body></html>")).alias("html"))
