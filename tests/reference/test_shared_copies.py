"""Copies of shared formulas: each is made once in a batch, and the rows of a group meet without a join."""

import random

import pyarrow as pa

from cellarium.functions import formulas
from cellarium.plans import queries


def test_equal_copies_are_made_once(monkeypatch):
    calls = []
    made = formulas.translated_text
    monkeypatch.setattr(formulas, "translated_text", lambda *asked: (calls.append(asked), made(*asked))[1])
    random.seed(2)
    rows = [(random.choice(["A1+$B$2", "C3", None, ""]), random.choice([0, 1, -5, 1 << 40, None]), random.choice([0, 2, None])) for _ in range(3000)]
    got = formulas._copies(*[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32()), strict=True)]).to_pylist()
    assert got == [None if None in x else made(*x) for x in rows]
    assert len(calls) == len({x for x in rows if None not in x})
    assert formulas._copies(pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int32())).to_pylist() == []


def test_lines_without_an_order_stay(spark, tmp_path):
    """As in the SQL of the query; a join on the order lost them."""
    rows = [(1, 2), (1, 3), (2, 1), (None, 4), (None, 6), (3, None), (4, None), (4, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = queries.formula_expand_shared(spark, str(tmp_path))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = [(k, n, None if n is None else f"A{n + 1}*$B$1") for k, n in rows]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
