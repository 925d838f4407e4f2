"""Trees of formulas go to Spark and come back field by field, a few formulas at a time."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from cellarium.functions import formula_trees as t

_TEXTS = ["1+2", None, "SUM(A1, B2 )*-3^2&\"x\"", "1+", "(A1,B1)%", '"open', "A1"]


def test_slices_join(spark):
    """More formulas than a slice holds, faults and nulls among them."""
    n = 1300
    df = spark.range(n, numPartitions=1).withColumn("f", F.element_at(F.array(*[F.lit(x) for x in _TEXTS]), (F.col("id") % len(_TEXTS) + 1).cast("int")))
    x = t.parse_formula(F.col("f"))
    rows = df.select("id", "f", x.alias("x"), t.print_formula(x["nodes"]).alias("again")).orderBy("id").collect()
    assert len(rows) == n
    for r in rows:
        fault = {"1+": ("UnexpectedEnd", 2), '"open': ("UnterminatedString", 0)}.get(r.f, (None, None))
        assert (r.x.fault, r.x.at) == fault and r.again == (r.f if fault[0] is None else None)
        assert (None if r.x.nodes is None else [n.asDict() for n in r.x.nodes]) == (t.parse_text(r.f) if r.f is not None and fault[0] is None else None)


def test_sliced_arrays_are_printed():
    trees = t._parsed([None, "1+2", None, "A1", "B1*2"]).field("nodes")
    assert t._printed(trees[1:4]) == ["1+2", None, "A1"] and t._printed(trees[:0]) == []


def test_nodes_of_a_batch_are_not_held_by_python():
    """A batch of formulas takes Python no more than a slice of it at a time."""
    texts = pa.array([_TEXTS[2]] * 5000)
    tracemalloc.start()
    made = t._batch(texts)
    parse = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    assert t._shown_batch(made.field("nodes")).to_pylist() == texts.to_pylist()
    shown = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(parse, shown) < 20_000_000
