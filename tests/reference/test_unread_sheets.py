"""Counts of sheets that can't be read to their end: no part of them looks like the whole."""

import pytest
from pyspark.sql import functions as F

from cellarium.plans import queries, workbook
from cellarium.sources import packages, sheets

PARTS = {"whole": "<row><c><v>1</v></c></row><row/>", "cut": "<row><c/></row><row><c/><row>", "bad": '<row r="0"><c/></row><row><c r="A5"/></row>', "none": "<row"}


def test_counts_of_unread_sheets(spark):
    parts = spark.createDataFrame([("p", k, bytearray(f"<worksheet><sheetData>{v}</sheetData></worksheet>", "utf-8")) for k, v in PARTS.items()], "path string, part string, bytes binary")
    stats = {r.part: (r.rows, r.cells, r.max_row, r.faults, r._error) for r in workbook.sheet_stats(sheets.sheet_cells(parts), ["part"]).collect()}
    assert stats["whole"] == (2, 1, 0, 0, None)
    assert stats["cut"][:3] == stats["none"][:3] == (None, None, None) and stats["cut"][4] == stats["none"][4] == "Malformed"
    assert stats["bad"][:2] == (2, 2) and stats["bad"][4] == "BadRowNumber"


@pytest.mark.parametrize("first,limit", [(0, 10), (-70, 8_000_000)])
def test_counters_stop_at_a_fault(spark, tmp_path, monkeypatch, first, limit):
    """A sheet of more elements than its quota, and rows that number below the first."""
    monkeypatch.setitem(packages.LIMITS, "nodes", limit)
    spark.range(first, first + 200).select(F.col("id").alias("event_id"), F.lit(7).cast("long").alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    with pytest.raises(Exception, match="sheet 7: (LimitNodes|BadRowNumber)"):
        queries.sheet_counters(spark, str(tmp_path)).collect()
