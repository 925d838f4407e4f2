"""Cell addresses and ranges as Column expressions. Rows and columns count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROW, MAX_COL = 1_048_575, 16_383


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _letter(n: Column) -> Column:
    return F.chr((n + 65).cast("long"))


def col_letters(col: Column | str) -> Column:
    """0 is A, 25 is Z, 26 is AA; null outside the sheet."""
    c = _col(col).cast("long")
    two, three = c - 26, c - 702
    return (
        F.when((c < 0) | (c > MAX_COL), None)
        .when(c < 26, _letter(c))
        .when(c < 702, F.concat(_letter(F.floor(two / 26)), _letter(two % 26)))
        .otherwise(F.concat(_letter(F.floor(three / 676)), _letter(F.floor(three / 26) % 26), _letter(three % 26)))
    )


def letters_index(letters: Column) -> Column:
    """The index of one to three letters of either case; -1 for none. Plain arithmetic on three digits, of which A is 1."""
    padded = F.lpad(F.upper(letters), 3, "@")  # the sign before A
    digit = lambda i: F.ascii(F.substring(padded, i, 1)) - 64
    return digit(1) * 676 + digit(2) * 26 + digit(3) - 1


def col_index(letters: Column | str) -> Column:
    """The inverse of col_letters, for either case; null for anything else and beyond the last column."""
    index = letters_index(F.regexp_extract(_col(letters), "^[A-Za-z]{1,3}$", 0))
    return F.when(index.between(0, MAX_COL), index.cast("int"))


def row_index(digits: Column | str) -> Column:
    """A row number counted from 1 to an index; null for 0, for more than seven digits and beyond the last row."""
    value = F.regexp_extract(_col(digits), "^[0-9]{1,7}$", 0).try_cast("long") - 1
    return F.when(value.between(0, MAX_ROW), value.cast("int"))


def a1(row: Column | str, col: Column | str) -> Column:
    """The address of a cell, such as B3; null outside the sheet."""
    r = _col(row).cast("long")
    return F.when(r.between(0, MAX_ROW), F.concat(col_letters(col), (r + 1).cast("string")))


def parse_a1(address: Column | str) -> Column:
    """struct<row, col> of an address without `$`; null if it is not one."""
    pattern, s = "^([A-Za-z]{1,3})([0-9]{1,7})$", _col(address)
    row = F.regexp_extract(s, pattern, 2).try_cast("long") - 1
    col = letters_index(F.regexp_extract(s, pattern, 1))
    return F.when(row.between(0, MAX_ROW) & col.between(0, MAX_COL), F.struct(row.cast("int").alias("row"), col.cast("int").alias("col")))


def parse_range(text: Column | str) -> Column:
    """struct<r0, c0, r1, c1> with ordered corners of A1:B2 or A1; null if either corner is no address."""
    def corners(ends: Column) -> Column:
        a, b = F.get(ends, F.lit(0)), F.get(ends, F.size(ends) - 1)
        box = F.struct(F.least(a["row"], b["row"]).alias("r0"), F.least(a["col"], b["col"]).alias("c0"), F.greatest(a["row"], b["row"]).alias("r1"), F.greatest(a["col"], b["col"]).alias("c1"))
        return F.when((F.size(ends) <= 2) & a.isNotNull() & b.isNotNull(), box)

    return let(F.transform(F.split(_col(text), ":"), parse_a1), corners)


def range_a1(r0: Column | str, c0: Column | str, r1: Column | str, c1: Column | str) -> Column:
    """Always both corners, also for one cell."""
    return F.concat(a1(r0, c0), F.lit(":"), a1(r1, c1))


def contains(area: Column, row: Column | str, col: Column | str) -> Column:
    """Whether a range struct holds a cell."""
    return _col(row).between(area["r0"], area["r1"]) & _col(col).between(area["c0"], area["c1"])


def overlaps(a: Column, b: Column) -> Column:
    """Whether two range structs share a cell."""
    return (a["r0"] <= b["r1"]) & (b["r0"] <= a["r1"]) & (a["c0"] <= b["c1"]) & (b["c0"] <= a["c1"])
