"""Streams of arriving packages: one query runs all batches, and a listing serves many of them."""

import io
import os
import zipfile

from pyspark.sql.streaming.readwriter import DataStreamWriter

from cellarium.sources import datasource
from cellarium.sources.packages import entries
from cellarium.streaming.ingest import ingest_arrivals


def _put(folder, name, second):
    (folder / name).write_bytes(b"x")
    os.utime(folder / name, (second, second))
    os.utime(folder, (second, second))


def _batch(reader, start):
    rows, end = reader.read(start)
    return [os.path.basename(path) for path, _ in rows], end


def test_a_listing_serves_many_batches(tmp_path, monkeypatch):
    for i in range(20):
        _put(tmp_path, f"f{i:02}", 1000 + i)
    times, listed = [], datasource._listed
    monkeypatch.setattr(datasource, "_listed", lambda *a: times.append(1) or listed(*a))
    reader = datasource.ArrivalsReader({"path": str(tmp_path), "maxfilesperbatch": "2"})
    at, seen = reader.initialOffset(), []
    for n in range(12):
        if n == 4:
            _put(tmp_path, "new", 2000)
        names, at = _batch(reader, at)
        assert len(names) <= 2
        seen += names
    assert seen == [*(f"f{i:02}" for i in range(20)), "new"]
    assert len(times) == 3  # at first, after the change, and when nothing was left


def test_a_folder_that_just_changed_is_listed_anew(tmp_path):
    reader = datasource.ArrivalsReader({"path": str(tmp_path), "maxfilesperbatch": "1"})
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(b"x")
    first, at = _batch(reader, reader.initialOffset())
    (tmp_path / "c").write_bytes(b"x")
    rest = []
    for _ in range(3):
        names, at = _batch(reader, at)
        rest += names
    assert sorted(first + rest) == ["a", "b", "c"]


def test_all_batches_run_in_one_query(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"f{i}").write_bytes(b"x")
    starts, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: starts.append(1) or start(self, *a, **k))
    assert ingest_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), most=2) == 3
    assert len(starts) == 1
    assert spark.read.parquet(str(tmp_path / "out")).select("path").distinct().count() == 5


def test_a_batch_is_one_pass_of_python(spark, tmp_path):
    """Members of files, bad ones and those that are gone included, without their contents on the way."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.comment = b"c"
        for name in ("a.xml", "b/", "c.xml"):
            z.writestr(name, "x")
    for name, content in (("good", buffer.getvalue()), ("bad", b"PK"), ("cut", buffer.getvalue()[:-20])):
        (tmp_path / name).write_bytes(content)
    files = spark.createDataFrame([(str(tmp_path / name),) for name in ("good", "bad", "cut", "gone")], "path string")
    found, wanted = datasource.file_entries(files, str(tmp_path)), entries(datasource.contents(files, str(tmp_path)))
    assert found.schema == wanted.schema and sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.count() == 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan
