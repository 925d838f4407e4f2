"""Elements of many small parts and of long ones, which go on to Spark in common batches."""

from cellarium.sources import packages


def test_parts_share_batches(spark, capsys):
    sizes = {f"/{i}": i % 3 for i in range(500)} | {"/long": 45_000, "/end": 1}
    parts = spark.createDataFrame([("p", k, bytearray(f'<r a="{n}">' + "<a/>" * n + "x</r>", "utf-8")) for k, n in sizes.items()] + [("p", "/bad", bytearray(b"<r>")), ("p", "/null", None)], "path string, part string, bytes binary")
    nodes = packages.xml_nodes(parts)
    nodes.explain()
    assert "MapInArrow" in capsys.readouterr().out
    assert {r["part"]: r["count"] for r in nodes.filter("_error IS NULL").groupBy("part").count().collect()} == {k: n + 1 for k, n in sizes.items()}
    assert {r["part"]: (r["attrs"]["a"], r["text"]) for r in nodes.filter("depth = 0").collect()} == {k: (str(n), "x") for k, n in sizes.items()}
    assert sorted((r["part"], r["_error"]) for r in nodes.filter("_error IS NOT NULL").collect()) == [("/bad", "Malformed"), ("/null", "Malformed")]
