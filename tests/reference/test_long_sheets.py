"""Sheets that number more rows than a workbook of the strict profile may have."""

import pytest
from pyspark.sql import functions as F

from cellarium.plans import queries
from cellarium.sources import sheets

BODY = b'<worksheet><sheetData><row r="1048577"><c/></row><row><c/><c r="B30000000"/></row><row r="36000000"><c/></row><row r="2000000000"><c/></row></sheetData></worksheet>'


def test_rows_are_a_quota(spark):
    parts = spark.createDataFrame([("p", "/s", bytearray(BODY))], "path string, part string, bytes binary")
    of = lambda limits: [(r["row"], r["_error"]) for r in sheets.sheet_cells(parts, limits).orderBy("cell_ord").collect()]
    assert of({"rows": 1 << 40}) == [(1048576, None), (1048577, None), (29999999, None), (35999999, None), (None, "BadRowNumber")]
    assert [e for _, e in of({})] == ["BadRowNumber", None, "BadCellRef", "BadRowNumber", "BadRowNumber"]


@pytest.fixture(scope="module")
def far_events(spark, tmp_path_factory):
    """Events whose numbers go beyond the rows of a sheet, with the user of a sheet each."""
    folder = str(tmp_path_factory.mktemp("far"))
    spark.range(1048000, 1049600).select(F.col("id").alias("event_id"), (F.col("id") * 31 % 97).alias("user_id")).write.parquet(f"{folder}/events.parquet")
    return folder


def expected(spark, folder):
    """event_id, sheet, row as plain counting gives them."""
    found, last = [], {}
    for k, user in sorted(map(tuple, spark.read.parquet(f"{folder}/events.parquet").collect())):
        row = k if k % 7 == 0 else last.get(user % 50, -1) + 1
        last[user % 50] = row
        found.append((k, user % 50, row))
    return found


@pytest.mark.parametrize("name", ["implicit_rows_package", "implicit_rows_split"])
def test_far_rows(spark, far_events, name):
    wanted = sorted((k, row) for k, _, row in expected(spark, far_events) if k % 3)
    assert sorted(map(tuple, queries.QUERIES[name](spark, far_events).collect())) == wanted


def test_far_counters(spark, far_events):
    last = {}
    for k, sheet, row in expected(spark, far_events):
        if k % 3:
            last[str(sheet)] = max(row, last.get(str(sheet), -1))
    assert {r["part"]: r["max_row"] for r in queries.sheet_counters(spark, far_events).collect()} == last
