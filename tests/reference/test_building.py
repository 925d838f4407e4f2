"""Packages are built in one pass over their cells, within the quota of their readers."""

import io
import zipfile

from pyspark.sql import functions as F

from cellarium.plans import workbook
from cellarium.sources import writer
from cellarium.sources.tables import stored

CELL = "path string, sheet int, row int, col int, value_kind string, num double, text string, bool boolean"


def cells(spark):
    n, none = F.col("id"), F.lit(None)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("number", "text", "bool", "empty")]), (n % 4 + 1).cast("int"))
    return spark.range(400).select(
        F.concat(F.lit("p"), (n % 3).cast("string")).alias("path"), (n % 5 % 2).cast("int").alias("sheet"), (n % 40).cast("int").alias("row"), (n / 40).cast("int").alias("col"), kind.alias("value_kind"),
        F.when(kind == "number", n / 8).alias("num"), F.when(kind == "text", F.concat(F.lit("t"), (n % 7).cast("string"))).otherwise(none).alias("text"), F.when(kind == "bool", n % 3 == 0).alias("bool"),
    )


def test_cells_are_rendered_once(spark):
    plan = writer.build_packages(stored(cells(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3  # the cells, and strings for them and for their table


def test_rows_and_cells_are_in_order(spark):
    made = writer.build_packages(cells(spark).filter("path = 'p1'").repartition(7)).collect()
    assert [(r.path, r._error) for r in made] == [("p1", None)]
    text = zipfile.ZipFile(io.BytesIO(bytes(made[0].content))).read("xl/worksheets/sheet1.xml").decode()
    at = [int(x.split('"')[0]) for x in text.split('<row r="')[1:]]
    assert at == sorted(set(at)) and text.count("<row") == text.count("</row>")
    want = cells(spark).filter("path = 'p1' AND sheet = 0").orderBy("row", "col").select("row", "col", "value_kind", "num", "bool").collect()
    back = workbook.read_cells(stored(writer.build_packages(cells(spark)))).filter("path = 'p1' AND sheet = 0").orderBy("row", "col")
    assert [tuple(r) for r in back.select("row", "col", "value_kind", "num", "bool").collect()] == [tuple(r) for r in want]


def test_a_package_beyond_the_quota_is_a_row(spark):
    some = cells(spark).filter("path = 'p0' OR col = 0")
    size = sum(len(b) for b in _bodies(some, "p0"))
    for part, bad in ((size, []), (size - 1, ["p0"]), (40, ["p0", "p1", "p2"])):
        rows = writer.build_packages(some, {"part": part}).collect()
        assert sorted(r.path for r in rows) == ["p0", "p1", "p2"]
        assert sorted(r.path for r in rows if r.content is None and r._error == "LimitPart") == bad
        assert all(r._error is None for r in rows if r.content is not None)


def _bodies(some, path):
    """What stands between the tags of sheets and strings."""
    content = next(bytes(r.content) for r in writer.build_packages(some).collect() if r.path == path)
    archive = zipfile.ZipFile(io.BytesIO(content))
    for name, first in [("xl/sharedStrings.xml", '/main">'), *((n, "<sheetData>") for n in archive.namelist() if "/sheet" in n)]:
        yield archive.read(name).decode().split(first, 1)[1].rsplit("</sst>" if "shared" in name else "</sheetData>", 1)[0]
