"""Trees put in place of nodes by runs in Arrow batches: the trees that the expression gives."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from cellarium.functions import formula_trees as t
from cellarium.plans import queries
from cellarium.sources.tables import stored
from tests.reference.test_formula_rewrite import CASES


def _random_formula(depth: int) -> str:
    blank = lambda: random.choice(["", "", " "])
    if depth == 0 or random.random() < 0.2:
        return blank() + random.choice(["X", "A1", "2", '"x"', "X"]) + blank()
    inner = lambda: _random_formula(depth - 1)
    form = random.randrange(6)
    return [lambda: f"{inner()}{random.choice('+*^&-')}{inner()}", lambda: f"-{inner()}", lambda: f"{inner()}%", lambda: f"X({inner()},{inner()}, )", lambda: f"({inner()}){blank()}", lambda: f"{{{random.choice('12')};X}}"][form]()


def _trees(spark, rows):
    df = spark.createDataFrame(rows, "id int, f string, put string")
    return stored(df.select("id", "put", *[t.parse_formula(F.col(c))["nodes"].alias(n) for c, n in (("f", "nodes"), ("put", "tree"))]))


def test_equal_to_the_expression(spark):
    random.seed(5)
    puts = ["1+2", "A1", "-X", "X%", "F(X,1)", " (1) ", None, "1+"]
    rows = [(i, f, put) for i, (f, put, _) in enumerate(CASES)] + [(100 + i, _random_formula(random.randint(0, 4)), random.choice(puts)) for i in range(1500)]
    df = _trees(spark, [*rows, (-1, None, "1"), (-2, "X+", "1")])
    cases = {
        "given": (lambda n: n["text"] == "X", lambda _, tree: tree),
        "own": (lambda n: (n["text"] == "X") | (n["kind"] == "unary"), lambda n, tree: F.when(n["ord"] == 0, tree).otherwise(t.map_nodes(tree, lambda o: {"text": F.concat(o["text"], n["text"])}))),
        "none": (lambda n: F.lit(None).cast("boolean"), lambda _, tree: tree),
        "empty": (lambda n: n["text"] == "X", lambda _, tree: F.slice(tree, 1, 0)),
    }
    for name, (wanted, make) in cases.items():
        want = stored(df.select("id", t.replace_nodes(F.col("nodes"), wanted, make, F.col("tree")).alias("want")))
        both = stored(t.replace_trees(df, "nodes", wanted, make, F.col("tree"))).join(want, "id")
        assert both.count() == len(rows) + 2
        assert [tuple(r) for r in both.filter("NOT (nodes <=> want)").take(3)] == [], name


def test_trees_are_printed_as_before():
    """Also those whose nodes are in another order, which are printed by the links between them."""
    random.seed(6)
    trees = []
    while len(trees) < 300:
        try:
            trees.append(t.parse_text(_random_formula(4)))
        except t.BadFormula:
            continue
    mixed = [random.sample(x, len(x)) for x in trees]
    links = [[n | {"id": n["id"] * 3 + 7, "parent": None if n["parent"] is None else n["parent"] * 3 + 7} for n in x] for x in trees]
    for some in (trees, mixed, links):
        assert t._printed(pa.array([None, [], *some], pa.list_(t._NODE))) == [None, "", *map(t.print_nodes, some)]


def test_each_text_is_parsed_once(monkeypatch):
    seen = []
    parsed = t._parsed
    monkeypatch.setattr(t, "_parsed", lambda texts: (seen.extend(texts), parsed(texts))[1])
    texts = ["A1+1", None, "1+", "A1+1"] * 1000
    assert t._batch(pa.array(texts)).to_pylist() == parsed(texts).to_pylist()
    assert sorted(seen, key=str) == ["1+", "A1+1", None]


def test_the_query_replaces_by_runs(spark):
    """It ran lambdas over all nodes, for each node that made way."""
    plan = queries.formula_tree_rewrite(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_sort" not in plan
