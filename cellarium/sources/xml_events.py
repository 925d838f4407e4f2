"""XML parts as tables of events that tile the bytes: every byte belongs to one event, so the events give the part back.

Edits are joins with that table: an event's text changes, events go, or fragments come in between. seq is a label that keeps order
under edits: an array of numbers, compared from the first on. The n-th event of a part is [n, 0]; what comes before event [.., n, 0] is
[.., n, -1, k, 0] with k counting on from edit to edit, and an end that an element gets of its own is [.., n, 1, 0].

What lies in what is told by sweeps: starts, ends and questions of a part in one order, with a running count of what is open.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.functions import markup
from cellarium.sources.packages import LIMITS
from cellarium.sources.sheets import arrow_schema

#: Events that go on to Spark at once, and bytes of a part that are searched together.
_ROWS, _STRETCH = 20_000, 1 << 20

EVENT = "path string, part string, seq long, kind string, start long, end long, name string, empty boolean, depth int, node_id long, parent_id long, raw string, _error string"
_NAME = rb"[^\s<>/=\"'?!][^\s<>/=\"']*"
_EVENT = re.compile(
    rb"(?s)(?P<Decl><\?xml\s.*?\?>)|(?P<Pi><\?.*?\?>)|(?P<Comment><!--.*?-->)|(?P<CData><!\[CDATA\[.*?\]\]>)|(?P<Doctype><!DOCTYPE)"
    rb"|</(?P<end>" + _NAME + rb")\s*>|<(?P<start>" + _NAME + rb")(?P<attrs>(?:\s+" + _NAME + rb"\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(?P<closed>/?)>|(?P<Text>[^<]+)"
)
_ATTR = re.compile(rb"\s(" + _NAME + rb")\s*=")


def _events(content: bytes, limits: dict) -> Iterator[tuple]:
    open_: list[tuple[bytes, int]] = []
    at, seq, nodes, rooted = 0, 0, 0, False
    while at < len(content):
        m = _EVENT.match(content, at)
        if m is None or m["Doctype"]:
            raise ValueError("Doctype" if m else "Malformed")
        parent = open_[-1][1] if open_ else None
        raw = m[0].decode()
        if m["start"] is not None:
            names = _ATTR.findall(m["attrs"])
            if len(set(names)) < len(names):
                raise ValueError("DuplicateAttribute")
            if len(open_) >= limits["depth"] or len(names) > limits["attrs"] or nodes >= limits["nodes"] or not open_ and rooted:
                raise ValueError("LimitDepth" if len(open_) >= limits["depth"] else "LimitAttrs" if len(names) > limits["attrs"] else "LimitNodes" if nodes >= limits["nodes"] else "Malformed")
            yield seq, "Start", at, m.end(), m["start"].decode(), bool(m["closed"]), len(open_), nodes, parent, raw
            if not m["closed"]:
                open_.append((m["start"], nodes))
            nodes, rooted = nodes + 1, True
        elif m["end"] is not None:
            if not open_ or open_[-1][0] != m["end"]:
                raise ValueError("Malformed")
            name, node = open_.pop()
            yield seq, "End", at, m.end(), name.decode(), False, len(open_), node, open_[-1][1] if open_ else None, raw
        else:
            kind = m.lastgroup
            if kind == "Text" and not open_ and raw.lstrip("\ufeff").strip() or kind == "CData" and not open_:
                raise ValueError("Malformed")
            yield seq, kind, at, m.end(), None, False, len(open_), None, parent, raw
        at, seq = m.end(), seq + 1
    if open_ or not rooted:
        raise ValueError("Malformed")


def xml_events(members: DataFrame, limits: dict | None = None) -> DataFrame:
    """Events of XML parts (path, part, bytes) in order: kind (Decl, Pi, Comment, CData, Start, End, Text), the bytes they
    cover, their raw text, the name and node of elements, and the node around them.

    A part that isn't well-formed UTF-8, has a DOCTYPE or exceeds a quota is one row with _error.
    """
    limits = LIMITS | (limits or {})

    schema = arrow_schema(EVENT)

    def batch(path: str, part: str, rows: list[tuple]) -> pa.RecordBatch:
        columns = [[path] * len(rows), [part] * len(rows), *zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for path, part, content in zip(*(some.column(c).to_pylist() for c in ("path", "part", "bytes")), strict=True):
                content = content or b""
                try:
                    found = _events(content, limits)
                    rows = list(islice(found, _ROWS))
                    if len(rows) == _ROWS:  # a part with a fault has no events, so a long one is read to its end first
                        deque(found, 0)
                        found = _events(content, limits)
                        rows = list(islice(found, _ROWS))
                except ValueError as e:
                    yield batch(path, part, [(*[None] * 10, "NotUtf8" if isinstance(e, UnicodeDecodeError) else str(e))])
                    continue
                while rows:
                    yield batch(path, part, [(*e, None) for e in rows])
                    rows = list(islice(found, _ROWS))

    return members.select("path", "part", "bytes").mapInArrow(read, EVENT).withColumn("seq", F.when(F.col("seq").isNotNull(), F.array("seq", F.lit(0).cast("long"))))


def is_blank(raw: Column) -> Column:
    return ~raw.rlike("[^ \\t\\r\\n]")


def tiling(events: DataFrame) -> DataFrame:
    """path, part, length, tiled: whether each event begins where the one before it ends, the first at 0."""
    before = F.lag("end", 1, 0).over(Window.partitionBy("path", "part").orderBy("seq"))  # one part, bounded by its quota
    return events.filter("_error IS NULL").select("path", "part", "end", (before == F.col("start")).alias("ok")).groupBy("path", "part").agg(F.max("end").alias("length"), F.every("ok").alias("tiled"))


def depths(events: DataFrame) -> DataFrame:
    """events with level, counted from starts and ends alone."""
    step = F.when((F.col("kind") == "Start") & ~F.col("empty"), 1).when(F.col("kind") == "End", -1).otherwise(0)
    run = Window.partitionBy("path", "part").orderBy("seq")
    return events.withColumn("level", (F.sum(step).over(run) - F.when(step > 0, step).otherwise(0)).cast("int"))


def attributes(events: DataFrame) -> DataFrame:
    """path, part, node_id, ord, qname, raw, value, quote of the attributes of elements, as they stand."""
    pattern = r"\s([^\s<>/=\"']+)\s*=\s*(\"[^\"]*\"|'[^']*')"
    names, quoted = F.regexp_extract_all("raw", F.lit(pattern), F.lit(1)), F.regexp_extract_all("raw", F.lit(pattern), F.lit(2))
    found = events.filter("kind = 'Start'").select("path", "part", "node_id", F.posexplode(F.arrays_zip(names.alias("n"), quoted.alias("q"))).alias("ord", "a"))
    raw = F.substring("a.q", F.lit(2), F.length("a.q") - 2)
    return found.select("path", "part", "node_id", "ord", F.col("a.n").alias("qname"), raw.alias("raw"), markup.unescape_attr(raw).alias("value"), F.substring("a.q", 1, 1).alias("quote"))


def serialize(events: DataFrame) -> DataFrame:
    """path, part, bytes: the events' raw text in order. Parts with an error have none."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "raw")))  # one part, bounded by its quota
    return events.filter("_error IS NULL").groupBy("path", "part").agg(F.array_join(F.transform(ordered, lambda x: x["raw"]), "").cast("binary").alias("bytes"))


_KEY = ["path", "part", "node_id"]


def _quoted(text: Column) -> Column:
    """text as the replacement of a pattern."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def _named(qname: Column) -> Column:
    return F.concat(F.lit(r"(\s"), F.regexp_replace(qname, r"([.\-\\$^()\[\]{}*+?|])", r"\\$1"), F.lit(r"\s*=\s*)"))


def set_attributes(events: DataFrame, edits: DataFrame) -> DataFrame:
    """events after edits (path, part, node_id, qname, value; one for each attribute): an attribute keeps its place and
    quotes, a new one follows the others, a null value removes it. All else keeps its spelling."""
    listed = edits.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("qname", "value"))).alias("_edits"))

    def one(raw: Column, e: Column) -> Column:
        name = _named(e["qname"])
        double, single = F.concat(name, F.lit('"[^"]*"')), F.concat(name, F.lit("'[^']*'"))
        value = lambda quote: _quoted(markup.escape_attr(e["value"], quote))
        there = F.regexp_replace(F.regexp_replace(raw, double, F.concat(F.lit('$1"'), value('"'), F.lit('"'))), single, F.concat(F.lit("$1'"), value("'"), F.lit("'")))
        added = F.regexp_replace(raw, F.lit(r"\s*(/?)>$"), F.concat(F.lit(" "), _quoted(e["qname"]), F.lit('="'), value('"'), F.lit('"$1>')))
        has = F.regexp_like(raw, F.concat(name, F.lit("[\"']")))
        removed = F.regexp_replace(raw, F.concat(F.lit(r"\s+"), F.regexp_replace(e["qname"], r"([.\-])", r"\\$1"), F.lit(r"""\s*=\s*("[^"]*"|'[^']*')""")), F.lit(""))
        return F.when(e["value"].isNull(), removed).when(has, there).otherwise(added)

    joined = events.join(listed, _KEY, "left")
    fresh = F.aggregate("_edits", F.col("raw"), one)
    return joined.withColumn("raw", F.when((F.col("kind") == "Start") & F.col("_edits").isNotNull(), fresh).otherwise(F.col("raw"))).select(events.columns)


_PART = ["path", "part"]


def _marked(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """events with _mark (whether an event is a start or end of one of nodes), _step (1 where one opens, -1 where one closes) and
    _level, how many of them are open after the event."""
    marked = events.join(nodes.select(_KEY).distinct().withColumn("_mark", F.lit(True)), _KEY, "left").withColumn("_mark", F.coalesce("_mark", F.lit(False)))
    step = F.when(F.col("_mark") & (F.col("kind") == "Start") & ~F.col("empty"), 1).when(F.col("_mark") & (F.col("kind") == "End"), -1).otherwise(0)
    return marked.withColumn("_step", step).withColumn("_level", F.sum("_step").over(Window.partitionBy(*_PART).orderBy("seq")))


def subtrees(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, part, node_id, xml: the text of each of these elements with all in it, to be put elsewhere."""
    marked = _marked(events.filter("_error IS NULL"), nodes)
    alone = (F.col("_mark") & F.col("empty") & (F.col("kind") == "Start")).cast("int")
    held = marked.withColumn("_cover", F.col("_level") + F.when(F.col("_step") == -1, 1).otherwise(0) + alone).filter("_cover > 0")
    each = held.withColumn("_at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_cover"))))  # a row for each element around it
    opens = F.when(F.col("_mark") & (F.col("kind") == "Start") & (F.col("_at") == F.col("_cover")), F.col("node_id"))
    owner = F.last(opens, ignorenulls=True).over(Window.partitionBy(*_PART, "_at").orderBy("seq"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "raw")))
    return each.withColumn("node_id", owner).groupBy(*_KEY).agg(F.array_join(F.transform(ordered, lambda x: x["raw"]), "").alias("xml"))


def remove_nodes(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """events without these elements (path, part, node_id) and all in them."""
    return _marked(events, nodes).filter("_level = 0 AND NOT _mark").select(events.columns)


def _insert(events: DataFrame, fragments: DataFrame) -> DataFrame:
    """events with fragments (path, part, at, xml, ord) right before the events labelled at; those of one place in the order of
    ord and then xml, after what earlier edits have put there."""
    place = F.concat(F.slice("at", F.lit(1), F.size("at") - 1), F.array(F.lit(-1).cast("long")))
    used = events.filter("kind = 'Fragment'").groupBy(*_PART, F.slice("seq", F.lit(1), F.size("seq") - 2).alias("_place")).agg(F.max(F.element_at("seq", -2)).alias("_used"))
    at = F.row_number().over(Window.partitionBy(*_PART, "_place").orderBy("ord", "xml"))
    placed = fragments.withColumn("_place", place).withColumn("_k", at).join(used, [*_PART, "_place"], "left")
    seq = F.concat("_place", F.array((F.coalesce("_used", F.lit(-1)) + F.col("_k")).cast("long"), F.lit(0).cast("long")))
    known = {"path": F.col("path"), "part": F.col("part"), "seq": seq, "kind": F.lit("Fragment"), "raw": F.col("xml")}
    return events.unionByName(placed.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields]))


def _opened(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """events in which these elements, if they were closed at once, have an end of their own."""
    marked = events.join(nodes.select(_KEY).distinct().withColumn("_open", F.lit(True)), _KEY, "left")
    both = F.col("_open") & F.col("empty") & (F.col("kind") == "Start")
    end = F.concat(F.slice("seq", F.lit(1), F.size("seq") - 1), F.array(F.lit(1).cast("long"), F.lit(0).cast("long")))
    start = F.struct("kind", F.col("seq"), F.col("raw"), F.col("empty"))
    opened = F.array(
        F.struct(F.col("kind"), F.col("seq"), F.regexp_replace("raw", r"\s*/>$", ">").alias("raw"), F.lit(False).alias("empty")),
        F.struct(F.lit("End").alias("kind"), end.alias("seq"), F.concat(F.lit("</"), F.col("name"), F.lit(">")).alias("raw"), F.lit(False).alias("empty")),
    )
    each = marked.withColumn("_e", F.explode(F.when(F.coalesce(both, F.lit(False)), opened).otherwise(F.array(start))))
    return each.select(*[F.col(f"_e.{c}").alias(c) if c in ("kind", "seq", "raw", "empty") else F.col(c) for c in events.columns])


def _ordered(df: DataFrame) -> DataFrame:
    return df if "ord" in df.columns else df.withColumn("ord", F.lit(0))


def set_contents(events: DataFrame, edits: DataFrame) -> DataFrame:
    """events after edits (path, part, node_id, xml; perhaps ord): all in the element gives way to the fragments."""
    opened = _marked(_opened(events, edits), edits)
    left = opened.filter(F.col("_level") - F.greatest(F.col("_step"), F.lit(0)) <= 0).select(events.columns)
    return append_children(left, edits)


def set_texts(events: DataFrame, edits: DataFrame) -> DataFrame:
    """events after edits (path, part, node_id, value): all in the element gives way to the text."""
    return set_contents(events, edits.select(*_KEY, markup.escape_text(F.col("value")).alias("xml")))


def append_children(events: DataFrame, fragments: DataFrame) -> DataFrame:
    """events with fragments (path, part, node_id, xml; perhaps ord, which orders those of one place) as the last children of their elements."""
    opened = _opened(events, fragments)
    ends = opened.filter("kind = 'End'").select(*_KEY, F.col("seq").alias("at"))
    return _insert(opened, _ordered(fragments).join(ends, _KEY))


def insert_before(events: DataFrame, fragments: DataFrame) -> DataFrame:
    """events with fragments (path, part, node_id, xml; perhaps ord, which orders those of one place) before their elements."""
    starts = events.filter("kind = 'Start'").select(*_KEY, F.col("seq").alias("at"))
    return _insert(events, _ordered(fragments).join(starts, _KEY))


def new_element(qname: Column, attributes: list[tuple[str, Column]], content: Column | None = None) -> Column:
    """The text of an element with attributes that are not null, around a fragment or closed at once."""
    given = [F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), markup.escape_attr(v, '"'), F.lit('"'))).otherwise("") for k, v in attributes]
    head = F.concat(F.lit("<"), qname, *given)
    closed = F.concat(head, F.lit("/>"))
    return closed if content is None else F.when(content.isNull() | (content == ""), closed).otherwise(F.concat(head, F.lit(">"), content, F.lit("</"), qname, F.lit(">")))


def node_paths(nodes: DataFrame) -> DataFrame:
    """nodes (of xml_nodes) with location: the steps from the root, numbered where siblings share a name.

    Each node asks for its step at every depth above it, which is that of the last node before it in document order that is so deep.
    """
    same = Window.partitionBy("path", "part", "parent_id", "local")
    at, n = F.row_number().over(same.orderBy("ord")), F.count("*").over(same)
    steps = nodes.filter("_error IS NULL").withColumn("_step", F.concat(F.lit("/"), "local", F.when(n > 1, F.concat(F.lit("["), at.cast("string"), F.lit("]"))).otherwise("")))
    each = steps.select(*_KEY, "depth", "_step", F.explode(F.sequence(F.lit(0), "depth")).alias("_at"))
    above = F.last(F.when(F.col("depth") == F.col("_at"), F.col("_step")), ignorenulls=True).over(Window.partitionBy(*_PART, "_at").orderBy("node_id"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_up"))), lambda x: x["_up"]), "")
    places = each.withColumn("_up", above).groupBy(*_KEY).agg(joined.alias("location"))
    return steps.drop("_step").join(places, _KEY)


def extents(events: DataFrame) -> DataFrame:
    """path, part, node_id, depth, from, to: the bytes of each element with all in it."""
    return events.filter("kind IN ('Start', 'End')").groupBy(*_KEY).agg(F.first("depth").alias("depth"), F.min("start").alias("from"), F.max("end").alias("to"))


def nodes_at(events: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets (path, part, offset) with node_id: the deepest element that covers the byte; null where none does.

    Events tile a part, so the last event that begins at or before the byte says it: a sorted stream of events and questions for each
    stretch of a part, and an event is in every stretch that it reaches.
    """
    stretch = lambda at: F.floor(at / _STRETCH)
    reached = F.sequence(stretch(F.col("start")), stretch(F.greatest(F.col("start"), F.col("end") - 1)))
    tiles = events.filter("_error IS NULL AND start IS NOT NULL").select(*_PART, F.explode(reached).alias("_stretch"), F.col("start").alias("_pos"), F.lit(0).alias("_asked"), F.struct("end", F.coalesce("node_id", "parent_id").alias("node_id")).alias("_tile"))
    at = F.col("offset").cast("long")
    asked = offsets.select(*_PART, stretch(at).alias("_stretch"), at.alias("_pos"), F.lit(1).alias("_asked"), F.struct(*offsets.columns).alias("_row"))
    both = tiles.unionByName(asked, allowMissingColumns=True)
    last = F.last("_tile", ignorenulls=True).over(Window.partitionBy(*_PART, "_stretch").orderBy("_pos", "_asked"))
    found = both.withColumn("_tile", last).filter("_asked = 1")
    return found.select("_row.*", F.when(F.col("_pos") < F.col("_tile.end"), F.col("_tile.node_id")).alias("node_id"))


def declarations(events: DataFrame) -> DataFrame:
    """path, part, node_id, prefix, uri of the names that elements declare; the empty prefix is the default."""
    declared = attributes(events).filter("qname = 'xmlns' OR qname LIKE 'xmlns:%'")
    return declared.select(*_KEY, F.regexp_replace("qname", "^xmlns:?", "").alias("prefix"), F.col("value").alias("uri"))


def resolve_prefixes(events: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (path, part, node_id, prefix) with uri: the innermost declaration around the element or its own; null without one.

    A sweep for each prefix: declarations open and close, a running count says how many are open, and the last that opened at a
    question's level is the innermost one.
    """
    ends = events.filter("kind = 'End' OR kind = 'Start' AND empty").select(*_KEY, F.col("seq").alias("_close"))
    starts = events.filter("kind = 'Start'").select(*_KEY, "seq")
    declared = declarations(events).join(starts, _KEY).join(ends, _KEY)
    opens = declared.select(*_PART, "prefix", "seq", F.lit(0).alias("_phase"), F.lit(1).alias("_step"), F.struct("uri").alias("_uri"))
    closes = declared.select(*_PART, "prefix", F.col("_close").alias("seq"), F.lit(2).alias("_phase"), F.lit(-1).alias("_step"))
    questions = asked.join(starts, _KEY, "left").select(*_PART, "prefix", "seq", F.lit(1).alias("_phase"), F.lit(0).alias("_step"), F.struct(*[asked[c] for c in asked.columns]).alias("_row"))
    stream = opens.unionByName(closes, allowMissingColumns=True).unionByName(questions, allowMissingColumns=True)
    one = [*_PART, "prefix"]
    leveled = stream.withColumn("_level", F.sum("_step").over(Window.partitionBy(*one).orderBy("seq", "_phase").rowsBetween(Window.unboundedPreceding, 0)))
    innermost = F.last(F.when(F.col("_phase") == 0, F.col("_uri")), ignorenulls=True).over(Window.partitionBy(*one, "_level").orderBy("seq", "_phase"))
    found = leveled.withColumn("_found", F.when(F.col("_level") > 0, innermost)).filter("_phase = 1")
    uri = F.when(F.col("prefix") == "xml", "http://www.w3.org/XML/1998/namespace").otherwise(F.nullif("_found.uri", F.lit("")))
    return found.withColumn("uri", uri).select("_row.*", "uri")
