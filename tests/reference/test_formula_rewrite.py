"""Trees of formulas with other trees in place of some nodes."""

import pytest
from pyspark.sql import functions as F

from cellarium.functions import formula_trees as t
from cellarium.functions.values import plain_number
from cellarium.sources.tables import stored

CASES = [
    ("X+1", "2*3", "(2*3)+1"),
    ("SUM( X ,X)", "A1:B2", "SUM( A1:B2 ,A1:B2)"),
    ("SUM(X,1)", "1+2", "SUM(1+2,1)"),
    ("-X%", "F(1,,2)", "-F(1,,2)%"),
    (" X ", "1-2", " 1-2 "),
    ("SUM( X*2 , Y)", "X", "SUM( X*2 , Y)"),
    ("F( X% )", "1+2", "F( (1+2)% )"),
    ("F(X(X(1),2),X)", "7", "F(7,7)"),
    ("{1,2;3}&X", '"a"', '{1,2;3}&"a"'),
    ("A1", "9", "A1"),
    ("(X)^X", "-1", "(-1)^(-1)"),
]


def shown(df, nodes):
    return [r[0] for r in stored(df.select(nodes.alias("made"))).select(t.print_formula(F.col("made"))).collect()]


def shape(nodes):
    return [tuple(n[f] for f in ("id", "parent", "ord", "depth", "kind", "text")) for n in nodes]


def test_replaced(spark):
    df = spark.createDataFrame(CASES, "f string, put string, want string")
    tree = lambda c: t.parse_formula(F.col(c))["nodes"]
    df = stored(df.select("f", "want", tree("f").alias("nodes"), tree("put").alias("put"), tree("want").alias("again")))
    made = stored(df.select("f", "want", "again", t.replace_nodes(F.col("nodes"), lambda n: n["text"] == "X", lambda _, put: put, F.col("put")).alias("made")))
    for r in made.select("*", t.print_formula(F.col("made")).alias("shown")).collect():
        assert r.shown == r.want, r.f
        assert shape(r.made) == shape(r.again), r.f


def test_made_from_the_node_and_nothing(spark):
    df = spark.createDataFrame([("1+22*1", 0.5), (None, 1.0)], "f string, v double")
    df = stored(df.select(t.parse_formula(F.col("f"))["nodes"].alias("nodes"), "v"))
    twice = t.map_nodes(F.col("nodes"), lambda n: {"text": F.when(n["kind"] == "number", plain_number(n["text"].cast("double") * F.col("v"))).otherwise(n["text"])})
    assert sorted(shown(df, twice), key=str) == ["0.5+11*0.5", None]
    own = t.replace_nodes(F.col("nodes"), lambda n: n["text"] == "22", lambda _, tree: tree, F.col("nodes"))
    assert sorted(shown(df, own), key=str) == ["1+(1+22*1)*1", None]
    lost = t.replace_nodes(F.col("nodes"), lambda n: n["text"] == "22", lambda *_: F.lit(None).cast("array<struct<id:int,parent:int,ord:int,depth:int,kind:string,text:string,before:string,after:string>>"))
    assert [r[0] for r in df.select(lost).collect()] == [None, None]


def test_long_sums(spark):
    df = stored(spark.createDataFrame([("+".join(["X"] * 300), "-2")], "f string, put string").select(*[t.parse_formula(F.col(c))["nodes"].alias(c) for c in ("f", "put")]))
    made = t.replace_nodes(F.col("f"), lambda n: n["text"] == "X", lambda _, put: put, F.col("put"))
    assert shown(df, made)[0] == "+".join(["(-2)"] * 300)


@pytest.mark.parametrize(("v", "want"), [(5.0, "5"), (-0.1, "-0.1"), (1e15, "1000000000000000"), (1.5e-30, "0.0000000000000000000000000000015"), (-2.5e25, "-25000000000000000000000000"), (0.0, "0"), (float("nan"), None), (float("inf"), None), (123456789.125, "123456789.125")])
def test_plain_numbers(spark, v, want):
    assert spark.range(1).select(plain_number(F.lit(v))).first()[0] == want
