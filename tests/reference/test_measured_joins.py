"""Joins of tables that take next to nothing in Parquet, and lookups of the next place in long sheets."""

from pyspark.sql import functions as F

from cellarium.plans import saving
from cellarium.sources import tables

PLANNED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_broadcast_by_size_in_memory(spark):
    many = tables.stored(spark.range(0, 300_000, 1, 2).select(F.col("id").alias("k"), F.lit("x" * 50).alias("t")))
    few = tables.stored(spark.range(0, 300_000, 1, 2).select(F.col("id").alias("k"), F.lit("y" * 50).alias("u")))
    joined = lambda df: _plan(df.join(few, "k"))
    assert "BroadcastHashJoin" in joined(many)
    before = spark.conf.get(PLANNED), spark.conf.get(MEASURED, None)
    assert "BroadcastExchange" not in tables.measured_joins(joined)(many)
    assert (spark.conf.get(PLANNED), spark.conf.get(MEASURED, None)) == before


def _runs_measured(spark, monkeypatch, call):
    seen = []

    def stop(df):
        seen.append((spark.conf.get(PLANNED), spark.conf.get(MEASURED, None)))
        raise InterruptedError

    monkeypatch.setattr(saving, "stored", stop)
    before = spark.conf.get(PLANNED)
    try:
        call()
    except InterruptedError:
        pass
    assert seen == [("-1", before)] and spark.conf.get(PLANNED) == before


def test_edits_of_cells_run_with_measured_joins(spark, monkeypatch):
    found = spark.createDataFrame([], "path string, content binary")
    edits = spark.createDataFrame([], "path string, sheet int, row long, col long, ord int, value_kind string, num double, text string, bool boolean")
    _runs_measured(spark, monkeypatch, lambda: saving.save_cells(found, edits))


def test_next_places_of_one_long_sheet(spark):
    there = spark.range(50_000).select(F.lit("p").alias("path"), (F.col("id") * 2).alias("row"), (F.col("id") + 7).alias("node_id"))
    wanted = spark.createDataFrame([("p", 1), ("p", 2), ("p", 99_997), ("p", 99_998), ("p", 200_000)], "path string, row long")
    found = saving._following(there, wanted, ["path"], "row")
    assert sorted(((r["row"], r["next"]) for r in found.collect()), key=lambda x: x[0]) == [(1, 8), (2, 9), (99_997, 50_006), (99_998, None), (200_000, None)]


def test_edits_of_fonts_run_with_measured_joins(spark, monkeypatch):
    found = spark.createDataFrame([], "path string, content binary")
    edits = spark.createDataFrame([], "path string, sheet int, row long, col long, name string, size double, bold boolean, italic boolean, underline boolean")
    _runs_measured(spark, monkeypatch, lambda: saving.save_fonts(found, edits))
