"""Copies of formulas: without lambdas over tokens, and with the same tokens as all other rewriting."""

import random

from pyspark.sql import functions as F

from cellarium.functions import formulas
from cellarium.plans import workbook
from cellarium.sources.tables import stored

_BITS = ["A1", "$A$1", "B2:C3", "a:$B", "$1:2", "Sheet1!", "'It''s'!", "[1]S!", "S0:S1!", '"', '"A1"', '""', "(", ")", "+", " ", "SUM(", "#REF!", "#N/A", "ZZZ9", "A0", "A01", "9999999", "1.5E3", ".5", "name", "_x", "é1", "²", "½A1", "Ⅷ", "٣A1", "A1.", "A1!", "[", "Sales[Q1]", "[[a]b]", "]", "\\A1", "?", "!", "$", ":", ",", "{", "%", "<>", "\n", "日本!A1", "😀", "@", "x.y!A1", "'", " ", "é!A1", "$$A1", "A$", "1A1", "E5", "#A1"]


def test_a_copy_needs_no_lambda(spark):
    df = spark.createDataFrame([("A1", 1, 1)], "f string, r int, c int").select(formulas.translate_formula(F.col("f"), F.col("r"), F.col("c")))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_odd_formulas_are_cut_in_the_same_way(spark):
    """A copy to its own place spells references anew, and nothing else."""
    random.seed(3)
    texts = ["".join(random.choice(_BITS) for _ in range(random.randint(1, 8))) for _ in range(4000)]
    f = F.col("f")
    df = spark.createDataFrame([(t,) for t in texts], "f string").select("f", formulas.translate_formula(f, F.lit(0), F.lit(0)).alias("copy"), formulas.respell_formula(f).alias("again"))
    assert [tuple(r) for r in stored(df).filter("copy <> again").take(3)] == []


def test_copies(spark):
    cases = [
        ("XFD1:A$2+b3&\"C4\"", 1, 1, '#REF!+C4&"C4"'), ("'a!'!A1:B2", -1, 0, "'a!'!#REF!"), ("A01+A0+ZZZ1", 1, 1, "B2+A0+ZZZ1"), ("Z9+az9+ZZ9", 0, 1, "AA9+BA9+AAA9"),
        ("²A1+½+eA1", 1, 0, "²A2+½+EA2"), ("A1048576+$A$1048576", 1, 0, "#REF!+$A$1048576"), ("A1", 1 << 40, 0, "#REF!"), (None, 1, 1, None), ("A1", None, 1, None), ("A1", 1, None, None), ("", 1, 1, ""),
    ]
    df = spark.createDataFrame(cases, "f string, r long, c long, want string")
    got = df.select("f", "want", formulas.translate_formula(F.col("f"), F.col("r"), F.col("c")).alias("got")).collect()
    assert [(r.f, r.got) for r in got] == [(r.f, r.want) for r in got]


def test_shared_formulas_need_no_lambda(spark):
    """Followers of a shared formula are copies too."""
    rows = [("p", "s", r, c, "shared", 0, "A1+$B$1" if r + c == 0 else None, (r + c == 0) or None) for r in range(3) for c in range(2)]
    cells = spark.createDataFrame(rows, "path string, part string, row int, col int, f_kind string, f_si long, f_text string, f_range boolean")
    df = workbook.expand_shared(cells)
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.row, r.col, r.f_text) for r in df.collect()) == [(r, c, f"{'AB'[c]}{r + 1}+$B$1") for r in range(3) for c in range(2)]
