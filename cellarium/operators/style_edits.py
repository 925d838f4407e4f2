"""Edits of fonts: cells get a format with the font they ask for, found among those there are or appended to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Sizes in points and bytes of a name that a font may have.
SIZES, NAME_BYTES = (1.0, 409.0), 31
_AT = ["path", "sheet", "row", "col"]
_FONT = ["name", "size", "bold", "italic", "underline", "strike", "color"]
_FORMAT = ["num_fmt_id", "fill_id", "border_id", "apply_fill", "apply_border"]


def font_fault(name: Column, size: Column) -> Column:
    """What is wrong with a wanted font; null if nothing."""
    return F.when((size < SIZES[0]) | (size > SIZES[1]) | F.isnan(size), "BadFontSize").when(name.isNotNull() & ((F.trim(name) == "") | (F.octet_length(name) > NAME_BYTES)), "BadFontName")


def _same(columns: list[str]) -> Column:
    """Equal for rows that are equal in these columns, nulls too."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _appended(known: DataFrame, wanted: DataFrame, columns: list[str], number: str) -> DataFrame:
    """path, number, columns of the distinct wanted rows that known has none of; numbers follow its largest."""
    there = known.select("path", _same(columns).alias("_same")).distinct()
    fresh = wanted.select("path", *columns, _same(columns).alias("_same")).dropDuplicates(["path", "_same"]).join(there, ["path", "_same"], "left_anti")
    last = known.groupBy("path").agg(F.max(number).alias("_last"))
    at = F.row_number().over(Window.partitionBy("path").orderBy("_same"))  # formats of one package, bounded by its quota
    return fresh.join(last, "path", "left").select("path", (F.coalesce("_last", F.lit(-1)) + at).cast("long").alias(number), *columns)


def edit_fonts(cells: DataFrame, xfs: DataFrame, fonts: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """cells, xfs, fonts after edits (path, sheet, row, col, name, size, bold, italic, underline; null keeps), and the edits refused.

    Each edited cell keeps all else of its format. A cell without a style has that of number 0, and one without a font the
    first font. The smallest number wins where several fonts or formats are equal. Cells that are not there are made. One
    edit for each cell; refused edits come back with _error and change nothing.
    """
    judged = edits.withColumn("_error", font_fault(F.col("name"), F.col("size").cast("double")))
    good = judged.filter("_error IS NULL").select(*_AT, *[F.col(c).alias(f"_{c}") for c in ("name", "size", "bold", "italic", "underline")])
    fonts = fonts.select("path", F.col("font_id").cast("long").alias("font_id"), *_FONT)
    formats = xfs.select("path", F.col("style").cast("long").alias("style"), F.col("font_id").cast("long").alias("font_id"), *_FORMAT, "apply_font")
    now = good.join(cells.select(*_AT, F.col("style").cast("long").alias("style")), _AT, "left").withColumn("style", F.coalesce("style", F.lit(0)))
    now = now.join(formats, ["path", "style"], "left").withColumn("font_id", F.coalesce("font_id", F.lit(0))).join(fonts, ["path", "font_id"], "left")
    kept = {"strike": F.coalesce("strike", F.lit(False)), "color": F.col("color")}
    asked = {c: F.coalesce(F.col(f"_{c}").cast(dict(fonts.dtypes)[c]), F.col(c)) for c in ("name", "size")} | {c: F.coalesce(f"_{c}", c, F.lit(False)) for c in ("bold", "italic", "underline")} | kept
    wanted = now.select(*_AT, *[F.coalesce(c, F.lit(d)).alias(c) for c, d in zip(_FORMAT, (0, 0, 0, True, True), strict=True)], *[asked[c].alias(c) for c in _FONT])
    all_fonts = fonts.unionByName(_appended(fonts, wanted, _FONT, "font_id"))
    numbered = wanted.withColumn("_same", _same(_FONT)).join(all_fonts.groupBy("path", _same(_FONT).alias("_same")).agg(F.min("font_id").alias("font_id")), ["path", "_same"]).withColumn("apply_font", F.lit(True))
    whole = ["font_id", *_FORMAT, "apply_font"]
    all_formats = formats.unionByName(_appended(formats, numbered, whole, "style").select(formats.columns))
    styled = numbered.withColumn("_whole", _same(whole)).join(all_formats.groupBy("path", _same(whole).alias("_whole")).agg(F.min("style").alias("_style")), ["path", "_whole"]).select(*_AT, "_style")
    kind = dict(cells.dtypes)
    made = {"ty": F.lit("n"), "value_kind": F.lit("empty")}
    both = cells.withColumn("_old", F.lit(True)).join(styled, _AT, "full")
    columns = [F.coalesce(F.col("_style"), F.col("style").cast("long")).cast(kind["style"]).alias("style") if c == "style" else F.when(F.col("_old").isNull(), made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in cells.columns]
    return both.select(*columns), all_formats, all_fonts, judged.filter("_error IS NOT NULL")
