"""Parts with more elements than the quota of the strict profile, and long ones."""

import pytest
from pyspark.sql import functions as F

from cellarium.plans import queries
from cellarium.sources import packages, xml_events


def test_one_part_beyond_the_quota(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(packages.LIMITS, "nodes", 50)
    spark.range(300).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    found = sorted(map(tuple, queries.xml_node_at_wide(spark, str(tmp_path)).collect()))
    assert found == [(k, 2 * k + 1 + k % 2) for k in range(300)]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_nodes_by_stretches(spark, monkeypatch, size):
    body = b"<a><b>some longer text</b><!-- between --><c><d/></c></a>\n"
    events = xml_events.xml_events(spark.createDataFrame([("p", "/x", bytearray(body))], "path string, part string, bytes binary"))
    asked = spark.range(-2, len(body) + 3).select(F.lit("p").alias("path"), F.lit("/x").alias("part"), F.col("id").alias("offset"))
    whole = sorted(map(str, xml_events.nodes_at(events, asked).collect()))
    monkeypatch.setattr(xml_events, "_STRETCH", size)
    assert sorted(map(str, xml_events.nodes_at(events, asked).collect())) == whole


def test_a_late_fault_leaves_no_events(spark):
    body = "<a>" + "<b/>" * 60_000
    parts = spark.createDataFrame([("p", "/bad", bytearray(body, "utf-8")), ("p", "/good", bytearray(body + "</a>", "utf-8"))], "path string, part string, bytes binary")
    counts = {(r["part"], r["_error"]): r["count"] for r in xml_events.xml_events(parts).groupBy("part", "_error").count().collect()}
    assert counts == {("/bad", "Malformed"): 1, ("/good", None): 60_002}
