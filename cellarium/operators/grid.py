"""Operators over cells in long form: path, sheet, row, col, ty, value_kind, num, text, bool, style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.functions.addresses import MAX_COL, MAX_ROW, range_a1
from cellarium.operators.ranges import first_range


def _range_of(key: Column, bounds: list) -> Column:
    """How many bounds, in order, are at most key: halves are compared, so a row meets the logarithm of their number."""
    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < bounds[middle], within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(bounds))


#: Rows of a sheet whose first strings are numbered together.
STRETCH = 10_000


def grid_of(df: DataFrame, key: str, columns: list[str], path: str = "book") -> DataFrame:
    """Any table as the cells of one sheet, a row for each row in the order of key, a unique number.

    Row numbers come from ranges of the key: a rank inside each range, and a running sum over one row for each range. The
    ranges' bounds are approximate quantiles, which only say how evenly the work is dealt.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    part = _range_of(F.col(key), sorted(set(bounds)))
    ranged = df.withColumn("_part", part)
    kind = dict(df.dtypes)
    local = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    sizes = ranged.groupBy("_part").count()
    base = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_base"))  # a row for each part
    numbered = local.join(F.broadcast(base), "_part").withColumn("row", (F.col("_base") + F.col("_at") - 1).cast("int"))
    number = lambda c: kind[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind[c].startswith("decimal")

    def cell(i: int, c: str) -> Column:
        value = F.col(c)
        ty = "n" if number(c) else "b" if kind[c] == "boolean" else "s"
        return F.struct(
            F.lit(i).alias("col"),
            F.lit(ty).alias("ty"),
            F.when(value.isNull(), "empty").otherwise({"n": "number", "b": "bool", "s": "text"}[ty]).alias("value_kind"),
            (value.cast("double") if ty == "n" else F.lit(None).cast("double")).alias("num"),
            (value.cast("string") if ty == "s" else F.lit(None).cast("string")).alias("text"),
            (value if ty == "b" else F.lit(None).cast("boolean")).alias("bool"),
        )

    cells = numbered.select("row", F.explode(F.array(*[cell(i, c) for i, c in enumerate(columns)])).alias("c"))
    return cells.select(F.lit(path).alias("path"), F.lit(0).alias("sheet"), "row", "c.*")


def implicit_positions(df: DataFrame, by: list[str], order: str, explicit: str, name: str) -> DataFrame:
    """Add the index that follows from explicit ones: each null counts on from the last explicit index before it."""
    run = Window.partitionBy(*by).orderBy(order)
    marked = df.withColumn("_anchor", F.count(explicit).over(run)).withColumn("_base", F.last(explicit, ignorenulls=True).over(run))
    since = F.row_number().over(Window.partitionBy(*by, "_anchor").orderBy(order)) - 1
    index = F.when(F.col(explicit).isNotNull(), F.col(explicit)).when(F.col("_base").isNull(), since).otherwise(F.col("_base") + since)
    return marked.withColumn(name, index).drop("_anchor", "_base")


def scan_slices(cells: DataFrame, by: list[str]) -> DataFrame:
    """Partial stats of slices: a row for each value of by and each 32,768 rows of a sheet, with the rows that occur as a bitmap.

    Slices may share rows, as slices by column do: merge_slices() counts a row once.
    """
    types = [F.count(F.when(F.col("ty") == t, 1)).alias(f"n_{t}") for t in ("n", "s", "str", "b", "e", "inlineStr", "d")]
    at = F.col("row").cast("long") + 1
    return cells.groupBy(*by, F.bitmap_bucket_number(at).alias("_stretch")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_rows"), F.count("*").alias("cells"), F.count(F.when(F.col("value_kind") != "empty", 1)).alias("non_empty"), *types, F.max("row").alias("max_row"), F.max("col").alias("max_col")
    )


def merge_slices(slices: DataFrame, by: list[str]) -> DataFrame:
    """The stats of scan_stats() from those of scan_slices(): bitmaps of rows are united, counts summed, the larger extents taken."""
    sums = [c for c in slices.columns if c not in (*by, "_rows", "_stretch", "max_row", "max_col") and dict(slices.dtypes)[c] == "bigint"]
    united = slices.groupBy(*by, "_stretch").agg(F.bitmap_or_agg("_rows").alias("_rows"), *[F.sum(c).alias(c) for c in sums], F.max("max_row").alias("max_row"), F.max("max_col").alias("max_col"))
    return united.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("_rows")), F.lit(0)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.max("max_row").alias("max_row"), F.max("max_col").alias("max_col"))


def scan_stats(cells: DataFrame, by: list[str]) -> DataFrame:
    """Counts of rows, cells, filled cells and storage types, and the last row and column; partial sums merge by themselves."""
    return merge_slices(scan_slices(cells, by), by)


def merge_stats(stats: DataFrame, by: list[str]) -> DataFrame:
    """Stats of several scans of disjoint rows as one: sums, and the larger of the extents."""
    sums = [c for c in stats.columns if c not in (*by, "max_row", "max_col") and dict(stats.dtypes)[c] == "bigint"]
    return stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], F.max("max_row").alias("max_row"), F.max("max_col").alias("max_col"))


def extent(stats: DataFrame) -> DataFrame:
    return stats.withColumn("extent", range_a1(F.lit(0), F.lit(0), "max_row", "max_col"))


def build_strings(cells: DataFrame) -> DataFrame:
    """path, idx, text: each distinct text of a package, numbered by its first cell."""
    first = cells.filter("value_kind = 'text'").groupBy("path", "text").agg(F.min(F.struct("sheet", "row", "col")).alias("at"))
    # Numbered by sheet and stretch of rows: a rank within each, after the strings of those before.
    staged = first.withColumn("_stretch", (F.col("at.row") / STRETCH).cast("long")).withColumn("_sheet", F.col("at.sheet"))
    by = ["path", "_sheet", "_stretch"]
    sizes = staged.groupBy(*by).agg(F.count("*").alias("_n"))
    base = sizes.select(*by, (F.sum("_n").over(Window.partitionBy("path").orderBy("_sheet", "_stretch")) - F.col("_n")).alias("_base"))  # a row for each stretch
    ranked = staged.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("at")) - 1)
    return ranked.join(base, by).select("path", (F.col("_base") + F.col("_at")).cast("long").alias("idx"), "text")


def decode_strings(cells: DataFrame, strings: DataFrame, index: str = "idx") -> DataFrame:
    """Cells with the text that their index names, and _error where the table has no such entry."""
    joined = cells.join(strings.select("path", F.col("idx").alias(index), F.col("text").alias("_text")), ["path", index], "left")
    missing = F.col(index).isNotNull() & F.col("_text").isNull()
    return joined.withColumn("_error", F.when(missing, "SharedStringOutOfRange")).withColumn("text", F.coalesce("_text", "text") if "text" in cells.columns else F.col("_text")).drop("_text")


def intern_strings(strings: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, idx, text after each wanted text (path, text) is there once; new ones follow in text order.

    Where strings have the column simple, only plain texts are used again: one with runs of its own keeps them.
    """
    kept = (strings.filter("simple") if "simple" in strings.columns else strings).groupBy("path", "text").agg(F.min("idx").alias("idx"))
    base = strings.groupBy("path").agg((F.max("idx") + 1).alias("base"))
    fresh = wanted.select("path", "text").filter("text IS NOT NULL").distinct().join(kept, ["path", "text"], "left_anti")
    # Numbered by the first signs of the text: a rank within each, after those before.
    staged = fresh.withColumn("_head", F.substring("text", 1, 2))
    sizes = staged.groupBy("path", "_head").agg(F.count("*").alias("_n"))
    before = sizes.select("path", "_head", (F.sum("_n").over(Window.partitionBy("path").orderBy("_head")) - F.col("_n")).alias("_before"))  # a row for each head
    at = F.row_number().over(Window.partitionBy("path", "_head").orderBy("text")) - 1
    added = staged.withColumn("_at", at).join(before, ["path", "_head"]).join(base, "path", "left").select("path", (F.coalesce("base", F.lit(0)) + F.col("_before") + F.col("_at")).alias("idx"), "text")
    return strings.select("path", "idx", "text").unionByName(added)


def resolve_styles(cells: DataFrame, xfs: DataFrame, fonts: DataFrame, fills: DataFrame, numfmts: DataFrame) -> DataFrame:
    """Cells with what their style says: num_fmt_id, is_date, font_name, bold, fill; a part counts only where applied."""
    looked = cells.join(xfs, ["path", "style"], "left")
    fonts = fonts.select("path", "font_id", F.col("name").alias("font_name"), "bold")
    fills = fills.select("path", "fill_id", F.col("solid").alias("fill"))
    custom = numfmts.select("path", "num_fmt_id", F.col("is_date").alias("custom_date"))
    looked = looked.withColumn("font_id", F.when(F.col("apply_font"), F.col("font_id"))).withColumn("fill_id", F.when(F.col("apply_fill"), F.col("fill_id")))
    for dim, on in ((fonts, "font_id"), (fills, "fill_id"), (custom, "num_fmt_id")):
        looked = looked.join(dim, ["path", on], "left")
    from cellarium.functions.styles import is_date_id

    return looked.withColumn("is_date", F.coalesce(is_date_id(F.col("num_fmt_id")) | F.coalesce("custom_date", F.lit(False)), F.lit(False))).drop("custom_date")


def column_widths(columns: DataFrame, spans: DataFrame, default: float) -> DataFrame:
    """columns (path, sheet, col) with width: the first span that holds the column, 0 if hidden, else default."""
    line = spans.select("path", "sheet", "ord", F.lit(0).alias("r0"), "c0", F.lit(0).alias("r1"), "c1", "width", "hidden")
    asked = columns.select("path", "sheet", "col").distinct().withColumn("row", F.lit(0))
    first = first_range(asked, line).select("path", "sheet", "col", "range")
    joined = columns.join(first, ["path", "sheet", "col"], "left")
    return joined.withColumn("width", F.when(F.col("range").isNull(), F.lit(default)).when(F.col("range.hidden"), 0.0).otherwise(F.coalesce("range.width", F.lit(default)))).drop("range")


def row_heights(rows: DataFrame, heights: DataFrame, default: float) -> DataFrame:
    """rows (path, sheet, row) with height: that of the last declaration (path, sheet, row, height, hidden) of the row, 0 if hidden,
    else default. Declarations without a place of their own in order count by their height."""
    order = F.col("ord") if "ord" in heights.columns else F.coalesce("height", F.lit(-1.0))
    last = heights.groupBy("path", "sheet", "row").agg(F.max_by(F.struct("height", "hidden"), order).alias("_h"))
    joined = rows.join(last, ["path", "sheet", "row"], "left")
    return joined.withColumn("height", F.when(F.col("_h.hidden"), 0.0).otherwise(F.coalesce("_h.height", F.lit(default)))).drop("_h")


def covered_cells(merges: DataFrame, max_rows: int = MAX_ROW + 1, max_cols: int = MAX_COL + 1) -> DataFrame:
    """path, sheet, ord, row, col of every cell of merged ranges up to the caps, is_top_left, and the range's width and height."""
    last = lambda end, most: F.least(F.col(end), F.lit(most - 1).cast(dict(merges.dtypes)[end]))
    inside = merges.filter((F.col("r0") < max_rows) & (F.col("c0") < max_cols))
    rows = inside.withColumn("row", F.explode(F.sequence(F.col("r0"), last("r1", max_rows)))).withColumn("col", F.explode(F.sequence(F.col("c0"), last("c1", max_cols))))
    return rows.select("path", "sheet", "ord", "row", "col", ((F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0"))).alias("is_top_left"), (F.col("c1") - F.col("c0") + 1).alias("width"), (F.col("r1") - F.col("r0") + 1).alias("height"))


def clip_flags(cells: DataFrame) -> DataFrame:
    """Cells with clipped: a text whose right neighbour is filled cannot spill."""
    following = Window.partitionBy("path", "sheet", "row").orderBy("col")
    next_col, next_kind = F.lead("col").over(following), F.lead("value_kind").over(following)
    return cells.withColumn("clipped", (F.col("value_kind") == "text") & F.coalesce((next_col == F.col("col") + 1) & (next_kind != "empty"), F.lit(False)))


def merge_edits(cells: DataFrame, edits: DataFrame, inline: bool = False) -> DataFrame:
    """Cells after edits (path, sheet, row, col, ord and a value): the last edit of a cell wins and makes missing cells.

    A value is a number, text, bool or error (err). A `clear` edit empties a cell that exists, whose style stays, and makes
    none. An edited cell loses its formula. New texts go to the shared table, or with inline into the cell.
    """
    at = ["path", "sheet", "row", "col"]
    err = F.col("err") if "err" in edits.columns else F.lit(None).cast("string").alias("err")
    last = edits.select("*", *([] if "err" in edits.columns else [err])).groupBy(*at).agg(F.max_by(F.struct("value_kind", "num", "text", "bool", "err"), "ord").alias("e"))
    both = cells.withColumn("_old", F.lit(True)).join(last, at, "full").filter("_old IS NOT NULL OR e.value_kind <> 'clear'")
    changed = F.col("e").isNotNull()
    kind = F.when(F.col("e.value_kind") == "clear", "empty").otherwise(F.col("e.value_kind"))
    ty = F.when(kind == "text", "inlineStr" if inline else "s").when(kind == "bool", "b").when(kind == "error", "e").otherwise("n")
    new = {"value_kind": kind, "ty": ty, "num": F.when(kind == "number", F.col("e.num")), "text": F.when(kind == "text", F.col("e.text")), "bool": F.when(kind == "bool", F.col("e.bool")), "err": F.when(kind == "error", F.col("e.err"))}
    new |= {c: F.lit(None) for c in ("f_text", "f_kind", "f_si", "f_range")}
    return both.select(*[F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cells.columns])


def grow_dimension(dimension: DataFrame, edits: DataFrame) -> DataFrame:
    """Declared ranges (path, sheet, r0, c0, r1, c1) widened to hold edited cells; none is made."""
    e = edits.groupBy("path", "sheet").agg(F.min("row").alias("a"), F.min("col").alias("b"), F.max("row").alias("c"), F.max("col").alias("d"))
    grown = dimension.join(e, ["path", "sheet"], "left")
    return grown.select("path", "sheet", F.least("r0", "a").alias("r0"), F.least("c0", "b").alias("c0"), F.greatest("r1", "c").alias("r1"), F.greatest("c1", "d").alias("c1"))


def html_rows(cells: DataFrame, max_rows: int = 5000, max_cols: int = 256, merges: DataFrame | None = None) -> DataFrame:
    """path, sheet, row, html: a table row of escaped cells for each row up to the caps on coordinates.

    Cells may have a style (their class) and is_date (numbers are days). With merges (path, sheet, r0, c0, r1, c1) a first cell
    spans its range and the others of it are left out.
    """
    from cellarium.functions.markup import escape_html
    from cellarium.functions.values import general_number

    number = general_number(F.col("num"))
    if "is_date" in cells.columns:
        number = F.when(F.col("is_date"), date_text(F.col("num"))).otherwise(number)
    error = escape_html(F.col("err")) if "err" in cells.columns else F.lit(None).cast("string")
    shown = F.coalesce(F.when(F.col("value_kind") == "number", number), F.when(F.col("value_kind") == "bool", F.when(F.col("bool"), "TRUE").otherwise("FALSE")), F.when(F.col("value_kind") == "error", error), escape_html(F.col("text")), F.lit(""))
    kept = cells.filter((F.col("row") < max_rows) & (F.col("col") < max_cols))
    span = F.lit("")
    if merges is not None:
        listed = merges if "ord" in merges.columns else merges.withColumn("ord", F.lit(0))
        first = (F.col("row") == F.col("range.r0")) & (F.col("col") == F.col("range.c0"))
        kept = first_range(kept, listed).withColumn("is_top_left", first).filter("is_top_left IS NULL OR is_top_left")
        kept = kept.withColumn("width", F.col("range.c1") - F.col("range.c0") + 1).withColumn("height", F.col("range.r1") - F.col("range.r0") + 1)
        attribute = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
        span = F.when(F.col("is_top_left"), F.concat(attribute("colspan", F.col("width")), attribute("rowspan", F.col("height")))).otherwise("")
    style = F.when(F.col("style") > 0, F.concat(F.lit(' class="x'), F.col("style").cast("string"), F.lit('"'))) if "style" in cells.columns else F.lit(None).cast("string")
    kept = kept.withColumn("td", F.concat(F.lit("<td"), F.coalesce(style, F.lit("")), span, F.lit(">"), shown, F.lit("</td>")))
    tds = F.transform(F.array_sort(F.collect_list(F.struct("col", "td"))), lambda x: x["td"])  # at most max_cols
    return kept.groupBy("path", "sheet", "row").agg(F.concat(F.lit("<tr>"), F.array_join(tds, ""), F.lit("</tr>")).alias("html"))


def date_text(days: Column) -> Column:
    """A number of days since the end of 1899 as a date, with the time if there is one; null before the first day."""
    whole = F.floor(days).cast("int")
    second = F.round((days - F.floor(days)) * 86400).cast("long")
    date = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), whole), "yyyy-MM-dd")
    time = F.format_string("%02d:%02d:%02d", F.expr("0L") + F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    return F.when((days >= 0) & (days < 2958466), F.when(second == 0, date).otherwise(F.concat(date, F.lit(" "), time)))
