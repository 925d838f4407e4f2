"""Events of parts that come in pieces, each parsed by itself: what is around a piece follows from a short summary of those before it.

No task holds a part. A part that can't be told by its pieces alone (cut within an event, or with a fault anywhere) is read whole by xml_events().
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.sources.packages import LIMITS
from cellarium.sources.sheets import arrow_schema
from cellarium.sources.tables import stored
from cellarium.sources.xml_events import _ATTR, _EVENT, _ROWS, EVENT, xml_events

_PART = ["path", "part"]
_SUMMARY = "path string, part string, at long, length long, events long, nodes long, deepest long, closed array<string>, opened array<string>, opened_nodes array<long>, top array<long>, doubt boolean"
_AROUND = "path string, part string, at long, start0 long, seq0 long, node0 long, names array<string>, around array<long>, doubt boolean"


class _Piece:
    """The events of a piece. Elements that it opens are numbered from 0; those around it are -1, -2 and so on, from the innermost outwards."""

    def __init__(self, limits: dict):
        self.limits = limits
        self.open: list[tuple[bytes, int]] = []
        self.closed: list[bytes] = []
        self.nodes = self.deepest = 0
        #: Elements right in each element around, a text counted twice: outside of the root there is one and no text.
        self.top: list[int] = [0]

    def _parent(self) -> int:
        return self.open[-1][1] if self.open else -len(self.closed) - 1

    def events(self, content: bytes) -> Iterator[tuple]:
        """kind, start, end, name, empty, depth, node, parent, raw; depth counts from that at the beginning of the piece."""
        at = 0
        while at < len(content):
            m = _EVENT.match(content, at)
            if m is None or m["Doctype"]:
                raise ValueError
            raw, parent, level = m[0].decode(), self._parent(), len(self.open) - len(self.closed)
            kind = m.lastgroup
            if kind == "closed":
                names = _ATTR.findall(m["attrs"])
                if len(names) > self.limits["attrs"] or len(set(names)) < len(names):
                    raise ValueError
                self.deepest = max(self.deepest, level + 1)
                if not self.open:
                    self.top[-1] += 1
                yield "Start", at, m.end(), m["start"].decode(), bool(m["closed"]), level, self.nodes, parent, raw
                if not m["closed"]:
                    self.open.append((m["start"], self.nodes))
                self.nodes += 1
            elif kind == "end":
                if self.open:
                    name, node = self.open.pop()
                    if name != m["end"]:
                        raise ValueError
                else:
                    node = parent
                    self.closed.append(m["end"])
                    self.top.append(0)
                yield "End", at, m.end(), m["end"].decode(), False, level - 1, node, self._parent(), raw
            else:
                if not self.open and (kind == "CData" or kind == "Text" and raw.lstrip("﻿").strip()):
                    self.top[-1] += 2
                yield kind, at, m.end(), None, False, level, None, parent, raw
            at = m.end()


def _follow(summaries: pd.DataFrame, limits: dict) -> pd.DataFrame:
    """What is around each piece of a part, and whether there is doubt about the part."""
    stack: list[tuple[str, int]] = []
    start = seq = nodes = roots = 0
    doubt, out = False, []
    for p in summaries.sort_values("at").itertuples(index=False):
        out.append((p.path, p.part, p.at, start, seq, nodes, [name for name, _ in stack], [node for _, node in stack], False))
        closed = len(p.closed)
        doubt |= bool(p.doubt) or closed > len(stack) or list(p.closed) != [name for name, _ in reversed(stack)][:closed] or len(stack) + p.deepest > limits["depth"]
        if doubt:
            break
        if closed == len(stack):  # outside of the root, where one element may stand and no text
            roots += int(p.top[-1])
            doubt |= roots > 1
        stack = stack[: len(stack) - closed] + [(name, nodes + int(node)) for name, node in zip(p.opened, p.opened_nodes, strict=True)]
        start, seq, nodes = start + p.length, seq + p.events, nodes + p.nodes
    if doubt or stack or roots != 1 or nodes > limits["nodes"]:
        out = [(summaries["path"].iloc[0], summaries["part"].iloc[0], None, None, None, None, None, None, True)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in _AROUND.split(", ")], dtype=object)


def piece_events(pieces: DataFrame, limits: dict | None = None) -> DataFrame:
    """xml_events() of parts in pieces (path, part, at, bytes), which follow each other in the order of at."""
    limits, schema, summary = LIMITS | (limits or {}), arrow_schema(EVENT), [c.split()[0] for c in _SUMMARY.split(", ")]
    pieces = stored(pieces.select(*_PART, F.col("at").cast("long").alias("at"), "bytes"))
    first = {c: pa.list_(pa.string()) for c in ("closed", "opened")} | {c: pa.list_(pa.int64()) for c in ("opened_nodes", "top")}

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, part, at, content in zip(*batch.columns, strict=True):
                content, piece, events, doubt = content.as_py() or b"", _Piece(limits), 0, False
                try:
                    events = sum(1 for _ in piece.events(content))
                except ValueError:
                    doubt = True
                doubt = doubt or content[:1] not in (b"", b"<")
                names = lambda found: [x.decode("utf-8", "replace") for x in found]
                rows.append((path.as_py(), part.as_py(), at.as_py(), len(content), events, piece.nodes, piece.deepest, names(piece.closed), names(x for x, _ in piece.open), [n for _, n in piece.open], piece.top, doubt))
            if rows:
                kinds = {"path": pa.string(), "part": pa.string(), "doubt": pa.bool_()} | first
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(summary, zip(*rows, strict=True), strict=True)], names=summary)

    told = stored(pieces.mapInArrow(summarize, _SUMMARY))
    around = stored(told.groupBy(*_PART).applyInPandas(lambda found: _follow(found, limits), _AROUND))  # a short row for each piece

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(path: str, part: str, rows: list[tuple]) -> pa.RecordBatch:
            columns = [[path] * len(rows), [part] * len(rows), *zip(*rows, strict=True), [None] * len(rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for path, part, content, start0, seq0, node0, outer in zip(*batch.columns, strict=True):
                path, part, start0, seq0, node0, outer = path.as_py(), part.as_py(), start0.as_py(), seq0.as_py(), node0.as_py(), outer.as_py()
                number = lambda n: None if n is None or -n > len(outer) else node0 + n if n >= 0 else outer[n]  # noqa: B023, E731
                rows = []
                for seq, (kind, start, end, name, empty, level, node, parent, raw) in enumerate(_Piece(limits).events(content.as_py() or b""), seq0):
                    rows.append((seq, kind, start0 + start, start0 + end, name, empty, len(outer) + level, number(node), number(parent), raw))
                    if len(rows) == _ROWS:
                        yield made(path, part, rows)
                        rows = []
                if rows:
                    yield made(path, part, rows)

    sure = pieces.join(around.filter("NOT doubt"), [*_PART, "at"]).select(*_PART, "bytes", "start0", "seq0", "node0", "around")
    events = sure.mapInArrow(read, EVENT).withColumn("seq", F.array("seq", F.lit(0).cast("long")))
    whole = lambda found: pd.DataFrame([(found["path"].iloc[0], found["part"].iloc[0], b"".join(bytes(b) for b in found.sort_values("at")["bytes"] if b is not None))], columns=["path", "part", "bytes"])
    doubtful = pieces.join(around.filter("doubt").select(*_PART), _PART, "left_semi").groupBy(*_PART).applyInPandas(whole, "path string, part string, bytes binary")
    return events.unionByName(xml_events(doubtful, limits))
