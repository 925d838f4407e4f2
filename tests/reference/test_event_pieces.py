"""Events of parts in pieces: those of the whole part, wherever it is cut, and no value that holds the part."""

import random

from pyspark.sql import functions as F

from cellarium.plans import queries
from cellarium.sources import event_pieces, xml_events
from cellarium.sources.packages import LIMITS
from cellarium.sources.tables import stored

PIECES = [b"<a>", b"</a>", b"<a/>", b"<b x='1' y = \"2\"/>", b'<b x="1" x="2"/>', b"</b >", b"<b>t</b>", b"<c><a/></c>", b"t", b" ", b"\xc3\xa9", b"\xff", b"<!-- <a> -->", b"<![CDATA[<a>]]>", b"<?p <a>?>", b"<!DOCTYPE a>"]
SHARES = [6, 6, 3, 2, 0.1, 0.2, 3, 2, 3, 2, 1, 0.05, 1, 0.5, 1, 0.05]


def _part(draw):
    depth, out = 0, []
    for p in draw.choices(PIECES, SHARES, k=draw.randrange(14)):
        if p == b"</a>" and not depth and draw.random() < 0.9:
            continue
        depth += (p == b"<a>") - (p == b"</a>")
        out.append(p)
    body = b"".join(out) + b"</a>" * max(depth - (draw.random() < 0.05), 0)
    return draw.choice([b"", b"<?xml version='1.0'?>\n", b"\xef\xbb\xbf"]) + draw.choice([b"<r>%s</r>"] * 9 + [b"%s"]) % body + draw.choice([b"", b"\n", b"<!-- end -->"])


def test_pieces_give_the_events_of_the_whole(spark):
    draw, parts, pieces = random.Random(11), [], []
    for i in range(1500):
        content = _part(draw)
        parts.append(("p", f"/{i}", bytearray(content)))
        tags = [n for n, c in enumerate(content) if c == 60]
        cuts = sorted({0, len(content), *draw.sample(tags, min(len(tags), draw.randrange(6))), *([draw.randrange(len(content) + 1)] if i % 10 == 0 else [])})
        pieces += [("p", f"/{i}", at, bytearray(content[at:to])) for at, to in zip(cuts, cuts[1:], strict=False)] or [("p", f"/{i}", 0, bytearray())]
    limits = {"depth": 6, "nodes": 12}
    shown = lambda events: sorted(map(str, events.select(*sorted(events.columns)).collect()))
    whole = shown(xml_events.xml_events(spark.createDataFrame(parts, "path string, part string, bytes binary"), limits))
    draw.shuffle(pieces)
    assert shown(event_pieces.piece_events(spark.createDataFrame(pieces, "path string, part string, at long, bytes binary").repartition(8), limits)) == whole
    assert len(whole) > 8000


def test_no_task_reads_a_part_without_doubt_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(event_pieces, "xml_events", lambda df, limits: seen.append(stored(df).count()) or xml_events.xml_events(df, limits))
    pieces = [("p", "/x", -1, bytearray(b"<all>")), ("p", "/x", 0, bytearray(b"<o/>" * 500)), ("p", "/x", 7, bytearray(b"<o><v/>" * 3)), ("p", "/x", 8, bytearray(b"</o>" * 3 + b"</all>"))]
    events = event_pieces.piece_events(spark.createDataFrame(pieces, "path string, part string, at long, bytes binary"))
    assert seen == [0]
    last = events.filter("name = 'all' AND kind = 'End'").collect()[0]
    assert (last.node_id, last.depth, last.parent_id, last.end) == (0, 0, None, 5 + 2000 + 21 + 12 + 6)


def test_the_wide_part_comes_in_pieces(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    sizes = [len(r.bytes) for r in queries._order_pieces(spark, str(tmp_path)).collect()]
    assert len(sizes) == 7 and max(sizes) <= 4096 * 25 and sum(sizes) == 20_000 * 25 + 11
    assert LIMITS["nodes"] == 8_000_000
