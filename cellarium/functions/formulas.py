"""Formula text: tokens, references, and their rewriting. Nothing is evaluated.

A formula is cut into tokens by one pattern and only references change, so all else keeps its spelling. Everything is a Column
expression over the tokens but for copies, which Python makes in Arrow batches. Column names in brackets, as in Sales[Q1], are no references and stay; a formula with them has no tree
(formula_trees.py says why a formula has none).
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarium.functions.addresses import MAX_COL, MAX_ROW, col_letters, let, letters_index

_SHEET = r"(?:'(?:[^']|'')+'!|(?:\[[0-9]+\])?[\p{L}_][\p{L}\p{N}_.]*(?::[\p{L}_][\p{L}\p{N}_.]*)?!)"
_CELL = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,7}"
_END = r"(?![\p{L}\p{N}_.(!])"
_BODY = rf"(?:#REF!|(?:{_CELL}:{_CELL}|{_CELL}|\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}|\$?[0-9]{{1,7}}:\$?[0-9]{{1,7}}){_END})"
_STRING = r"\"(?:[^\"]|\"\")*\""
_CALL = r"[\p{L}_][\p{L}\p{N}_.]*(?=\()"
_OTHER = r"\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]|#[A-Z/0-9_]+[!?]?|[\p{L}_\\][\p{L}\p{N}_.?\\]*|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|."
_PATTERN = rf"(?s){_STRING}|({_CALL})|({_SHEET}?{_BODY})|{_OTHER}"
_CALL_GROUP, _REF_GROUP = 1, 2


def tokens(formula: Column) -> Column:
    """All tokens in order; joined, they are the formula."""
    return F.regexp_extract_all(formula, F.lit(_PATTERN), 0)


def references(formula: Column) -> Column:
    """All references in order, repeated ones too."""
    return F.filter(F.regexp_extract_all(formula, F.lit(_PATTERN), _REF_GROUP), lambda t: t != "")


def function_names(formula: Column) -> Column:
    """All called names in order, as written."""
    return F.filter(F.regexp_extract_all(formula, F.lit(_PATTERN), _CALL_GROUP), lambda t: t != "")


_SIGNS, _DIGITS, _ALPHABET = "$", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _point(text: Column) -> Column:
    """struct<col, row, ca, ra> of one corner: null where it has no column or row, and which of them are absolute."""
    letters, digits = F.translate(text, _DIGITS + _SIGNS, ""), F.translate(text, _ALPHABET + _SIGNS, "")
    first, later = text.startswith("$"), F.substring(text, 2, 12).contains("$")
    has = letters != ""
    return F.struct(F.when(has, letters_index(letters)).alias("col"), F.when(digits != "", digits.cast("int") - 1).alias("row"), (first & has).alias("ca"), F.when(has, later).otherwise(first).alias("ra"))


def _outside(points: Column) -> Column:
    """Whether a corner lies beyond the sheet."""
    return F.exists(points, lambda p: F.coalesce(~p["col"].between(0, MAX_COL), F.lit(False)) | F.coalesce(~p["row"].between(0, MAX_ROW), F.lit(False)))


def _split(ref: Column) -> Column:
    """struct<prefix, points, valid> of a reference: its sheet with the sign after it, and its corners unless it is #REF! or beyond the sheet."""
    body = F.when(ref.endswith("#REF!"), "#REF!").otherwise(F.substring_index(ref, "!", -1))
    points = F.when(body != "#REF!", F.transform(F.split(body, ":"), _point))
    return let(F.struct(F.substring(ref, F.lit(1), F.length(ref) - F.length(body)).alias("prefix"), points.alias("points")), lambda x: F.struct(x["prefix"].alias("prefix"), x["points"].alias("points"), (x["points"].isNotNull() & ~_outside(x["points"])).alias("valid")))


def _print(points: Column) -> Column:
    """Corners as text in capitals; #REF! for null."""
    sign = lambda on: F.when(on, "$").otherwise("")
    one = lambda p: F.concat(F.when(p["col"].isNull(), "").otherwise(F.concat(sign(p["ca"]), col_letters(p["col"]))), F.when(p["row"].isNull(), "").otherwise(F.concat(sign(p["ra"]), (p["row"] + 1).cast("string"))))
    return F.coalesce(F.array_join(F.transform(points, one), ":"), F.lit("#REF!"))


def rewrite(formula: Column, change: Callable[[Column, Column], Column]) -> Column:
    """struct<text, changed>: a formula with each valid reference changed, given its sheet prefix and corners, and how many differ.

    change gives new corners, or null for what is left as #REF!. A null formula gives null and none.
    """
    cut = F.struct(F.regexp_extract_all(formula, F.lit(_PATTERN), 0).alias("all"), F.regexp_extract_all(formula, F.lit(_PATTERN), _REF_GROUP).alias("refs"))
    fresh = lambda ref: F.when(ref == "", ref).otherwise(let(_split(ref), lambda x: F.when(x["valid"], F.concat(x["prefix"], _print(change(x["prefix"], x["points"])))).otherwise(ref)))

    def joined(tokens: Column, refs: Column) -> Column:
        text = F.array_join(F.zip_with(tokens["all"], refs, lambda t, r: F.when(r == "", t).otherwise(r)), "")
        differ = F.size(F.filter(F.zip_with(tokens["refs"], refs, lambda a, b: a != b), lambda x: x))
        return F.struct(text.alias("text"), F.when(refs.isNull(), 0).otherwise(differ).alias("changed"))

    return let(cut, lambda t: let(F.transform(t["refs"], fresh), lambda r: joined(t, r)))


def _names(prefix: Column) -> Column:
    """The sheets that a prefix names: one, or the ends of a run of sheets; a number of another workbook is left out."""
    bare = F.substring(prefix, F.lit(1), F.length(prefix) - 1)
    plain = F.when(bare.startswith("'"), F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit("''"), F.lit("'"))).otherwise(bare)
    return F.split(F.regexp_replace(plain, r"^\[[0-9]+\]", ""), ":")


def shift_formula(formula: Column, axis: str, at: int, count: int, insert: bool, sheet: str | None = None, local: bool = True) -> Column:
    """struct<text, changed> of formulas after count rows or columns come in or go at `at`; `$` makes no difference.

    A reference without a sheet moves if local, another if it names the edited sheet. Reversed areas stay reversed; what leaves
    the sheet, or is left with nothing, is #REF!.
    """
    k, most = ("row", MAX_ROW) if axis == "row" else ("col", MAX_COL)

    def moved(points: Column) -> Column:
        a, b = F.get(points, F.lit(0))[k], F.element_at(points, -1)[k]
        low, high = F.least(a, b), F.greatest(a, b)
        if insert:
            further = lambda x: F.when(x >= at, x + count).otherwise(x)
            fresh, fits = (further(low), further(high)), further(high) <= most
        else:
            fresh = F.when(low < at, low).otherwise(F.greatest(F.lit(at), low - count)), F.when(high < at, high).otherwise(F.greatest(F.lit(at - 1), high - count))
            fits = fresh[0] <= fresh[1]
        new = lambda p: F.when(p[k] == low, fresh[0]).otherwise(fresh[1])
        one = lambda p: F.struct((p["col"] if k == "row" else new(p)).alias("col"), (new(p) if k == "row" else p["row"]).alias("row"), p["ca"].alias("ca"), p["ra"].alias("ra"))
        return F.when(fits, F.transform(points, one))

    def change(prefix: Column, points: Column) -> Column:
        named = F.array_contains(_names(prefix), sheet) if sheet is not None else F.lit(False)
        concerns = F.get(points, F.lit(0))[k].isNotNull() & F.when(prefix == "", F.lit(local)).otherwise(named)
        return F.when(concerns, moved(points)).otherwise(points)

    return rewrite(formula, change)


@functools.cache
def _python_tokens(ascii_only: bool) -> re.Pattern:
    """_PATTERN for Python, whose word characters are Java's letters and numbers but which has no class of letters alone; groups:
    a text or a call or signs, a reference, anything else."""
    numbers = "" if ascii_only else "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Nl", "No"))
    letter = "[A-Za-z_]" if ascii_only else rf"[^\W\d{numbers}]"
    word = "0-9A-Za-z_" if ascii_only else r"\w"

    def in_python(pattern: str) -> str:
        for java, python in ((r"\p{L}\p{N}_", word), (r"[\p{L}_\\]", rf"(?:{letter}|\\)"), (r"[\p{L}_]", letter)):
            pattern = pattern.replace(java, python)
        return pattern

    string, call, ref, other = (in_python(x) for x in (_STRING, _CALL, f"{_SHEET}?{_BODY}", _OTHER))
    return re.compile(rf"(?s)([-+*/^&=<>,;:(){{}} %]+|{string}|{call})|({ref})|({other})")


_CORNER = re.compile(r"(\$?)([A-Za-z]*)(\$?)([0-9]*)")


@functools.cache
def _column(letters: str) -> int:
    at = 0
    for c in letters.upper():
        at = at * 26 + ord(c) - 64
    return at - 1


@functools.cache
def _letters(col: int) -> str:
    return (_letters(col // 26 - 1) if col >= 26 else "") + chr(65 + col % 26)


@functools.lru_cache(1 << 16)
def _moved_reference(ref: str, d_row: int, d_col: int) -> str:
    """A reference copied by so many rows and columns; one beyond the sheet, or #REF!, stays."""
    if ref.endswith("#REF!"):
        return ref
    at = ref.rfind("!") + 1
    valid, fits, out = True, True, []
    for corner in ref[at:].split(":"):
        first, letters, later, digits = _CORNER.fullmatch(corner).groups()
        text = ""
        if letters:
            col = _column(letters)
            valid = valid and col <= MAX_COL
            col += 0 if first else d_col
            fits = fits and 0 <= col <= MAX_COL
            text = first + _letters(col) if valid and fits else ""
        if digits:
            fixed = later if letters else first
            row = int(digits) - 1
            valid = valid and 0 <= row <= MAX_ROW
            row += 0 if fixed else d_row
            fits = fits and 0 <= row <= MAX_ROW
            text += f"{fixed}{row + 1}"
        out.append(text)
    return ref if not valid else ref[:at] + (":".join(out) if fits else "#REF!")


def translated_text(formula: str, d_row: int, d_col: int) -> str:
    """A formula copied by so many rows and columns."""
    found = _python_tokens(formula.isascii()).findall(formula)
    return "".join([_moved_reference(ref, d_row, d_col) if ref else one or other for one, ref, other in found])


def translate_formula(formula: Column, d_row: Column, d_col: Column) -> Column:
    """Formulas copied by so many rows and columns: absolute parts stay, what leaves the sheet is #REF!. Null where one of the three is.

    Formulas are cut by Python in Arrow batches, which takes a fraction of the time of lambdas over all tokens; equal copies of a batch are made once.
    """

    @F.arrow_udf("string")
    def moved(formulas: pa.Array, rows: pa.Array, cols: pa.Array) -> pa.Array:
        return _copies(formulas, rows, cols)

    return moved(formula, d_row, d_col)


def _copies(formulas: pa.Array, rows: pa.Array, cols: pa.Array) -> pa.Array:
    """Copies of a batch: its formulas, rows and columns are numbered, and each set of numbers that occurs is one copy."""
    parts = [x.dictionary_encode(null_encoding="encode") for x in (formulas, rows, cols)]
    (f, r, c), (texts, downs, rights) = ([x.indices.to_numpy().astype(np.int64) for x in parts], [x.dictionary.to_pylist() for x in parts])
    pairs = pa.array(f * len(downs) + r).dictionary_encode()
    keys = pa.array(pairs.indices.to_numpy().astype(np.int64) * len(rights) + c).dictionary_encode()
    pair_of, made = pairs.dictionary.to_pylist(), []
    for key in keys.dictionary.to_pylist():
        pair, right = divmod(key, len(rights))
        text, down = divmod(pair_of[pair], len(downs))
        asked = texts[text], downs[down], rights[right]
        made.append(None if None in asked else translated_text(*asked))
    return pa.array(made, pa.string()).take(keys.indices)


def respell_formula(formula: Column) -> Column:
    """Every reference read and printed again: the same text for a formula whose references are in capitals."""
    return rewrite(formula, lambda _, points: points)["text"]


def book_index(sheet: Column) -> Column:
    """The number in brackets before a sheet's name, of another workbook; null without one."""
    return F.nullif(F.regexp_extract(sheet, r"^'?\[([0-9]{1,9})\]", 1), F.lit("")).cast("int")


def reference_table(formula: Column) -> Column:
    """array of struct<sheet, kind, c0, r0, c1, r1, c0_abs, r0_abs, c1_abs, r1_abs> for the references of a formula."""

    def described(x: Column) -> Column:
        first, last = F.get(x["points"], F.lit(0)), F.element_at(x["points"], -1)
        kind = F.when(~x["valid"], "invalid").when(first["row"].isNull(), "cols").when(first["col"].isNull(), "rows").when(F.size(x["points"]) == 1, "cell").otherwise("area")
        part = lambda p, c: F.when(x["valid"], p[c]) if c in ("col", "row") else F.when(x["valid"], p[c]).otherwise(False)
        columns = {"c0": (first, "col"), "r0": (first, "row"), "c1": (last, "col"), "r1": (last, "row"), "c0_abs": (first, "ca"), "r0_abs": (first, "ra"), "c1_abs": (last, "ca"), "r1_abs": (last, "ra")}
        sheet = F.nullif(F.substring(x["prefix"], F.lit(1), F.length(x["prefix"]) - 1), F.lit(""))
        return F.struct(sheet.alias("sheet"), kind.alias("kind"), *[part(p, c).alias(name) for name, (p, c) in columns.items()])

    return F.transform(references(formula), lambda ref: let(_split(ref), described))
