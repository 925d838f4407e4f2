"""Typing, reading and printing of cell values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarium.functions.addresses import let

# Storage types of cells, and error literals of cells and formulas.
CELL_TYPES = ("n", "s", "str", "b", "e", "inlineStr", "d")
CELL_ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#GETTING_DATA")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def trimmed(text: Column) -> Column:
    """text without white space of any script at its ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def is_blank(text: Column) -> Column:
    """Whether nothing is left of a text that is trimmed()."""
    return ~text.rlike(r"[^\s\p{Z}]")


def parse_number(text: Column) -> Column:
    """A finite number, or null."""
    s = trimmed(text)
    value = F.when(text.rlike(_NUMBER), text.try_cast("double")).when(s.rlike(_NUMBER), s.try_cast("double"))  # most need no trimming
    return F.when(F.abs(value) < float("inf"), value)


def parse_bool(text: Column) -> Column:
    return F.when(text.isin("1", "true", "TRUE"), True).when(text.isin("0", "false", "FALSE"), False)


def parse_index(text: Column) -> Column:
    """An unsigned 32-bit number, or null."""
    value = F.when(text.rlike(r"^\+?[0-9]{1,10}$"), text.try_cast("long"))
    return F.when(value < (1 << 32), value)


def parse_type(text: Column) -> Column:
    """The storage type; an absent one is n, an unknown one null."""
    return F.when(text.isNull(), "n").when(text.isin(*CELL_TYPES), text)


def parse_error(text: Column) -> Column:
    return F.when(text.isin(*CELL_ERRORS), text)


def _plain(digits: Column, exponent: Column) -> Column:
    """Significant digits d.ddd x 10^exponent in plain decimals, no trailing zeros."""
    d = F.rtrim(digits, F.lit("0"))
    whole = F.when(exponent >= 0, F.rpad(F.substring(d, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))).otherwise(F.lit("0"))
    rest = F.when(exponent >= 0, F.substring(d, exponent + 2, F.length(d))).otherwise(F.concat(F.repeat(F.lit("0"), -exponent - 1), d))
    return F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))


def general_number(v: Column) -> Column:
    """A number as the General format shows it: whole numbers below 10^15 in full, others with 15 significant digits."""
    parts = let(F.format_string("%.14e", F.abs(v)), lambda x: F.struct(F.concat(F.substring(x, 1, 1), F.substring(x, 3, 14)).alias("d"), F.substring(x, 18, 5).try_cast("int").alias("e")))
    sign = F.when(v < 0, "-").otherwise("")
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), F.floor(v).cast("long").cast("string")).when(v == 0, "0").otherwise(F.concat(sign, let(parts, lambda p: _plain(p["d"], p["e"]))))


def stored_number(v: Column) -> Column:
    """A number as it is written to a cell: its shortest exact decimals, with an exponent if over 24 characters; null if not finite."""
    split = let(F.split(F.abs(v).cast("string"), "E"), lambda x: F.struct(F.split(F.get(x, F.lit(0)), r"\.").alias("m"), F.coalesce(F.get(x, F.lit(1)).try_cast("int"), F.lit(0)).alias("p")))  # d.ddd or d.dddE+x
    whole = let(split, lambda x: F.struct(F.concat(F.get(x["m"], F.lit(0)), F.get(x["m"], F.lit(1))).alias("raw"), (x["p"] + F.length(F.get(x["m"], F.lit(0))) - 1).alias("e")))
    bare = let(whole, lambda x: F.struct(F.ltrim(x["raw"], F.lit("0")).alias("d"), x["e"].alias("e"), F.length(x["raw"]).alias("n")))
    parts = let(bare, lambda x: F.struct(F.rtrim(x["d"], F.lit("0")).alias("d"), (x["e"] - x["n"] + F.length(x["d"])).alias("e")))

    def shown(p: Column) -> Column:
        d, e = p["d"], p["e"]
        rest = F.when(F.length(d) > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), F.length(d)))).otherwise("")
        short = F.concat(F.substring(d, 1, 1), rest, F.when(e >= 0, "E+").otherwise("E-"), F.abs(e).cast("string"))
        sign = F.when(v < 0, "-").otherwise("")
        return let(F.concat(sign, _plain(d, e)), lambda plain: F.when(F.length(plain) <= 24, plain).otherwise(F.concat(sign, short)))

    # Most numbers are short: whole ones, and those that print without an exponent anyway.
    whole, short = (v == F.floor(v)) & (F.abs(v) < 1e15), F.abs(v).between(1e-3, 9999999.0)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).when(v == 0, "0").when(whole, v.cast("long").cast("string")).when(short, v.cast("string")).otherwise(let(parts, shown))


def plain_number(v: Column) -> Column:
    """A number in its shortest exact decimals without an exponent, as a formula spells it; null if not finite."""

    def spelled(s: Column) -> Column:
        head, e = F.substring_index(s, "E", 1), F.substring_index(s, "E", -1).try_cast("int")
        return F.when(s.contains("E"), F.concat(F.when(v < 0, "-").otherwise(""), _plain(F.translate(head, "-.", ""), e))).otherwise(s)

    return let(stored_number(v), spelled)


def coerce_input(text: Column) -> Column:
    """struct<kind, num, text, bool> of what a user typed: blank clears, a finite number, a boolean, or text."""
    s = trimmed(text)
    number = parse_number(text)
    truth = F.when(F.lower(s) == "true", True).when(F.lower(s) == "false", False)
    kind = F.when(text.isNull() | (s == ""), "empty").when(number.isNotNull(), "number").when(truth.isNotNull(), "bool").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(kind == "number", number).alias("num"), F.when(kind == "text", text).alias("text"), F.when(kind == "bool", truth).alias("bool"))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """n with the plural form of languages that have three."""
    tail, teens = n % 10, n % 100
    form = F.when((tail == 1) & (teens != 11), one).when(tail.between(2, 4) & ~teens.between(12, 14), few).otherwise(many)
    return F.concat_ws(" ", n.cast("string"), form)
