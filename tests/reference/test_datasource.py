"""Packages through the data sources: partitions, filters, commits and offsets."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellarium.plans.workbook import cells_of_books, read_cells
from cellarium.sources import datasource, writer
from cellarium.sources.packages import packages
from cellarium.sources.tables import stored
from cellarium.streaming.ingest import ingest_arrivals
from tests.reference.test_packages import book_cells


@pytest.fixture(scope="module")
def built(spark):
    datasource.register(spark)
    return stored(writer.build_packages(book_cells(spark)).select("path", "content"))


def shown(cells):
    return sorted(str((os.path.basename(r.path), r.sheet_name, r.row, r.col, r.value_kind, r.num, r.text, r.bool, r._error)) for r in cells.collect())


def test_source_reads_what_the_reader_does(spark, built, tmp_path):
    built.write.format("spreadsheet").mode("append").save(str(tmp_path))
    (tmp_path / "_hidden.xlsx").write_bytes(b"x")
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    assert sorted(os.listdir(tmp_path)) == ["_hidden.xlsx", "bad.xlsx", "p.xlsx", "q.xlsx"]
    rows = spark.read.format("spreadsheet").option("bytesPerPartition", "10").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    assert shown(cells_of_books(stored(rows))) == shown(read_cells(packages(spark, f"{tmp_path}/*.xlsx")))
    items = rows.filter("kind = 'item'").select("path", "item.text")
    assert {r.text for r in items.collect()} >= {"é"}
    one = rows.filter((F.col("part") == "/xl/workbook.xml") & (F.col("path") == str(tmp_path / "q.xlsx")))
    assert {(r.part, r.kind) for r in one.collect()} == {("/xl/workbook.xml", "node")} and one.rdd.getNumPartitions() == 1
    small = spark.read.format("spreadsheet").option("limit_input", "5").load(str(tmp_path))
    assert {r._error for r in small.collect()} == {"LimitInput"}


def test_reader_pushes_filters_down(spark, built, tmp_path):
    from pyspark.sql.datasource import EqualTo, In, Not

    reader = datasource.SpreadsheetReader({"path": str(tmp_path)}, spark.createDataFrame([], "path string").schema)
    filters = [EqualTo(("kind",), "item"), In(("part",), ("/a", "/b")), EqualTo(("part",), "/b"), Not(EqualTo(("path",), "x"))]
    assert list(reader.pushFilters(filters)) == filters and reader.only == {"kind": {"item"}, "part": {"/b"}}


def visible(folder):
    return sorted(x for x in os.listdir(folder) if x[0] not in "._")


def test_a_failed_write_leaves_nothing(spark, built, tmp_path):
    def fail(frames):
        for frame in frames:
            if "q" in set(frame["path"]):
                raise RuntimeError("lost")
            yield frame

    broken = built.repartition(2, "path").mapInPandas(fail, built.schema)
    with pytest.raises(Exception, match="lost"):
        broken.write.format("spreadsheet").mode("append").save(str(tmp_path))
    assert visible(tmp_path) == []
    twice = built.unionByName(built)
    with pytest.raises(Exception, match="one name"):
        twice.write.format("spreadsheet").mode("append").save(str(tmp_path))
    assert visible(tmp_path) == []
    built.write.format("spreadsheet").mode("append").save(str(tmp_path))
    built.filter("path = 'p'").write.format("spreadsheet").mode("overwrite").save(str(tmp_path))
    assert visible(tmp_path) == ["p.xlsx"]


def test_arrivals_come_in_bounded_batches(spark, built, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    many = built.filter("path = 'p'").select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit("b"), i.cast("string")))).alias("path"), "content")
    many.write.format("spreadsheet").mode("append").save(folder)
    assert ingest_arrivals(spark, folder, out, checkpoint, most=2) == 3
    assert ingest_arrivals(spark, folder, out, checkpoint, most=2) == 0
    built.write.format("spreadsheet").mode("append").save(folder)
    assert ingest_arrivals(spark, folder, out, checkpoint, most=2) == 1
    members = spark.read.parquet(out).groupBy("path").count().collect()
    assert sorted(os.path.basename(r.path) for r in members) == ["b1.xlsx", "b2.xlsx", "b3.xlsx", "b4.xlsx", "b5.xlsx", "p.xlsx", "q.xlsx"] and {r["count"] for r in members} == {7, 6}


def test_few_bytes_are_read_by_several_tasks(tmp_path):
    """Forty megabytes of packages, minutes of parsing, are no work of one task; the option still has its way."""
    for i in range(40):
        with open(tmp_path / f"f{i:02}.xlsx", "wb") as f:
            f.truncate(1 << 20)
    dealt = lambda options: [len(p.paths) for p in datasource.SpreadsheetReader({"path": str(tmp_path)} | options, StructType([])).partitions()]
    assert dealt({}) == [1] * 40
    assert dealt({"bytesperpartition": str(64 << 20)}) == [40]
    os.truncate(tmp_path / "f00.xlsx", 1 << 40)  # sparse: of much more, a task still reads 64 MB at most
    assert dealt({}) == [1, 39]
