"""Which ranges hold a cell: an equi-join on buckets of several sizes, so that no range is taken apart into its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHEET = ["path", "sheet"]
_AT = ["path", "sheet", "row", "col"]


def _level(extent: Column) -> Column:
    """The least k for which 2 to the k-th is at least the extent."""
    return F.when(extent <= 1, 0).otherwise(F.length(F.bin(extent.cast("long") - 1))).cast("int")


def bucketed(ranges: DataFrame) -> DataFrame:
    """ranges with _kr, _kc, _rb, _cb: the buckets that each lies in, which are at least as large as it, so there are four at most."""
    sized = ranges.withColumn("_kr", _level(F.col("r1") - F.col("r0") + 1)).withColumn("_kc", _level(F.col("c1") - F.col("c0") + 1))
    over = lambda a, b, k: F.explode(F.sequence(F.expr(f"shiftright(cast({a} as long), {k})"), F.expr(f"shiftright(cast({b} as long), {k})")))
    return sized.withColumn("_rb", over("r0", "r1", "_kr")).withColumn("_cb", over("c0", "c1", "_kc"))


def ranges_at(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """path, sheet, row, col, range (a struct of all columns of ranges): each range (path, sheet, r0, c0, r1, c1) that holds a cell of
    points. Cells count once; a range whose end lies before its beginning holds none."""
    good = ranges.filter("r0 <= r1 AND c0 <= c1")
    listed = bucketed(good.select(*_SHEET, "r0", "c0", "r1", "c1", F.struct(*ranges.columns).alias("range")))
    shapes = listed.groupBy(*_SHEET).agg(F.collect_set(F.struct("_kr", "_kc")).alias("_shapes"))  # at most one for each pair of levels
    asked = points.select(*_AT).distinct().join(shapes, _SHEET).select(*_AT, F.explode("_shapes").alias("_s")).select(*_AT, "_s.*")
    asked = asked.withColumn("_rb", F.expr("shiftright(cast(row as long), _kr)")).withColumn("_cb", F.expr("shiftright(cast(col as long), _kc)"))
    met = asked.join(listed, [*_SHEET, "_kr", "_kc", "_rb", "_cb"])
    return met.filter(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))).select(*_AT, "range")


def first_range(points: DataFrame, ranges: DataFrame, order: str = "ord") -> DataFrame:
    """points (path, sheet, row, col) with range: the first in order of the ranges that hold the cell, or null."""
    first = ranges_at(points, ranges).groupBy(*_AT).agg(F.min_by("range", F.col(f"range.{order}")).alias("range"))
    return points.join(first, _AT, "left")


def overlapping(ranges: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (a, b: structs of all columns) of ranges of one sheet that share a cell.

    The smaller of two meets the larger one's level: a range enters buckets at each level of the other table that is at least its own.
    """
    def sized(df: DataFrame, name: str) -> DataFrame:
        return df.filter("r0 <= r1 AND c0 <= c1").select(*_SHEET, F.struct(*df.columns).alias(name), _level(F.col("r1") - F.col("r0") + 1).alias(f"_kr_{name}"), _level(F.col("c1") - F.col("c0") + 1).alias(f"_kc_{name}"))

    a, b = sized(ranges, "a"), sized(others, "b")
    levels = a.groupBy(*_SHEET).agg(F.collect_set(F.struct("_kr_a", "_kc_a")).alias("_of_a")).join(b.groupBy(*_SHEET).agg(F.collect_set(F.struct("_kr_b", "_kc_b")).alias("_of_b")), _SHEET)

    def placed(df: DataFrame, name: str, other: str) -> DataFrame:
        shapes = df.join(levels.select(*_SHEET, f"_of_{other}"), _SHEET).withColumn("_s", F.explode(f"_of_{other}"))
        both = {"_kr_" + name: F.col("_kr_" + name), "_kc_" + name: F.col("_kc_" + name), "_kr_" + other: F.col(f"_s._kr_{other}"), "_kc_" + other: F.col(f"_s._kc_{other}")}
        leveled = shapes.select(*_SHEET, name, *[F.col(f"{name}.{c}").alias(f"_{c}") for c in ("r0", "c0", "r1", "c1")], *[c.alias(n) for n, c in both.items()]).withColumn("_kr", F.greatest("_kr_a", "_kr_b")).withColumn("_kc", F.greatest("_kc_a", "_kc_b"))
        over = lambda p, q, k: F.sequence(F.expr(f"shiftright(cast(_{p} as long), {k})"), F.expr(f"shiftright(cast(_{q} as long), {k})"))
        lists = leveled.withColumn("_rs", over("r0", "r1", "_kr")).withColumn("_cs", over("c0", "c1", "_kc")).drop("_r0", "_c0", "_r1", "_c1")
        return lists.withColumn("_rb", F.explode("_rs")).withColumn("_cb", F.explode("_cs")).drop("_rs", "_cs")

    key = [*_SHEET, "_kr_a", "_kc_a", "_kr_b", "_kc_b", "_kr", "_kc", "_rb", "_cb"]
    met = placed(a, "a", "b").join(placed(b, "b", "a"), key)
    share = lambda p, q: (F.col(f"a.{p}") <= F.col(f"b.{q}")) & (F.col(f"b.{p}") <= F.col(f"a.{q}"))
    first = lambda p, k: F.expr(f"shiftright(cast(greatest(a.{p}, b.{p}) as long), {k})")  # noqa: E731  two that meet in several buckets count in that where their common part begins
    return met.filter(share("r0", "r1") & share("c0", "c1") & (F.col("_rb") == first("r0", "_kr")) & (F.col("_cb") == first("c0", "_kc"))).select("a", "b")
