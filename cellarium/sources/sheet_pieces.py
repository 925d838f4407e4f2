"""One sheet read by many tasks: its text is cut at row starts while it is inflated, and the pieces are parsed side by side.

A piece does not know how many rows came before it, so rows without a number count from an unknown start; a running sum over one
summary for each piece (rows, cells, the last number given) tells every piece where it begins. What can't be read that way is
read whole, so the cells are those of sheet_cells() whatever the size of the pieces.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xml.parsers import expat

from cellarium.sources.packages import LIMITS, _fault, _open
from cellarium.sources.sheets import _CHUNK, _MOST_ROWS, _ROWS, CELL, _Cells, arrow_schema, sheet_cells
from cellarium.sources.tables import stored

#: Bytes of a piece; it goes on to the next row.
PIECE_BYTES = 4 << 20
PIECE = "path string, part string, piece int, head binary, bytes binary, tail binary, _error string"
_SUMMARY = "piece int, next_row long, n_rows long, n_cells long, seen long"
#: Rows of a piece count from here until one has a number.
_UNKNOWN = -_MOST_ROWS
_PART = ["path", "part"]

_TOKEN = re.compile(rb"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(?P<close>/?)(?P<name>[^\s<>/!?]+)(?:[^<>"']++|"[^"]*"|'[^']*')*+>""")
_CLOSING = {b"<!--": b"-->", b"<![CDATA[": b"]]>", b"<?": b"?>"}


class _Context(NamedTuple):
    """What stands around the rows of a part: the tags that are open there, how they close, and what to look for from where on."""

    head: bytes
    tail: bytes
    marks: re.Pattern
    longest: int
    start: int


def _context(text: bytearray) -> _Context | None:
    """The context of the rows, unless their data do not begin in this text or its letters take several bytes."""
    if b"\0" in text[:4] or text[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return None
    declaration, opened, at = b"", [], 0
    while (at := text.find(b"<", at)) >= 0:
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        at, name = m.end(), m["name"]
        if name is None:
            declaration = declaration or (m[0] if re.match(rb"<\?xml\s", m[0]) else b"")
        elif m["close"]:
            del opened[-1:]
        elif not m[0].endswith(b"/>"):
            opened.append((name, m[0]))
            prefix, colon, local = name.rpartition(b":")
            if local == b"sheetData":
                prefix = re.escape(prefix + colon)
                marks = re.compile(rb"<!--|<!\[CDATA\[|<\?|<" + prefix + rb"row(?=[\s/>])|(?P<end></" + prefix + rb"sheetData(?=[\s>]))")
                tail = b"".join(b"</" + n + b">" for n, _ in reversed(opened))
                return _Context(declaration + b"".join(t for _, t in opened), tail, marks, len(name) + 2, at)
    return None


def cut_rows(chunks: Iterable[bytes], size: int) -> Iterator[tuple[bytes, bytes, bytes]]:
    """What must stand before a piece, the piece, and what must stand after it. Pieces joined are the text.

    A text is cut only before rows of its data, never in comments or the like; one that has no rows is one piece.
    """
    held, tried, context, at, closing, cut, done = bytearray(), 0, None, 0, None, False, False
    for chunk in chunks:
        held += chunk
        if context is None and len(held) >= max(size, 2 * tried):
            tried = len(held)
            context = _context(held)
            at = context.start if context else 0
        while context is not None and not done:
            if closing is not None:
                end = held.find(closing, at)
                if end < 0:
                    at = max(at, len(held) - 2)
                    break
                at, closing = end + len(closing), None
            m = context.marks.search(held, at)
            if m is None:
                at = max(at, len(held) - context.longest)
                break
            at, closing, done = m.end(), _CLOSING.get(m[0]), m["end"] is not None
            if closing is None and not done and m.start() >= size:
                yield context.head if cut else b"", bytes(held[: m.start()]), context.tail
                del held[: m.start()]
                at, cut = at - m.start(), True
    yield context.head if cut else b"", bytes(held), b""


def _rows_of(path: str, part: str, chunks: Iterable[bytes], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A batch for each piece, so that a task holds one at a time."""
    for k, (head, text, tail) in enumerate(cut_rows(chunks, size)):
        yield pa.RecordBatch.from_pylist([{"path": path, "part": part, "piece": k, "head": head, "bytes": text, "tail": tail}], schema=schema)


def part_pieces(members: DataFrame, size: int = PIECE_BYTES) -> DataFrame:
    """PIECE columns of sheet parts (path, part, bytes, _error); one with an error is a row with it and no bytes."""
    schema = arrow_schema(PIECE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for path, part, content, fault in zip(*(some.column(i).to_pylist() for i in range(4)), strict=True):
                if fault is not None:
                    yield pa.RecordBatch.from_pylist([{"path": path, "part": part, "_error": fault}], schema=schema)
                    continue
                text, step = memoryview(content or b""), min(size, _CHUNK)
                yield from _rows_of(path, part, (text[i : i + step] for i in range(0, len(text), step)), size, schema)

    faults = "_error" if "_error" in members.columns else F.lit(None).cast("string").alias("_error")
    return members.select("path", "part", "bytes", faults).mapInArrow(cut, PIECE)


def package_pieces(found: DataFrame, pattern: str = "/xl/worksheets/[^/]*", limits: dict | None = None, size: int = PIECE_BYTES) -> DataFrame:
    """PIECE columns of the members of packages (path, content) whose part name matches.

    A member is inflated in steps and its quotas are checked on what comes out, so a task never holds more than a piece of it.
    Archives and members that can't be read, to their checksum, are a row with _error and no bytes.
    """
    limits, wanted, schema = LIMITS | (limits or {}), re.compile(pattern, re.DOTALL), arrow_schema(PIECE)

    def inflated(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> Iterator[bytes]:
        seen = 0
        with archive.open(info) as member:
            while data := member.read(min(size, _CHUNK)):
                seen += len(data)
                if max(seen, info.file_size) > limits["part"]:
                    raise ValueError("LimitPart")
                if info.compress_size and max(seen, info.file_size) // info.compress_size > limits["ratio"]:
                    raise ValueError("LimitRatio")
                yield data

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for path, content in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                part = None
                try:
                    archive = _open(content or b"", limits)
                    for info in archive.infolist():
                        part = "/" + info.orig_filename.lstrip("/")
                        if info.orig_filename.endswith("/") or not wanted.fullmatch(part):
                            continue
                        try:
                            yield from _rows_of(path, part, inflated(archive, info), size, schema)
                        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, ValueError) as e:
                            yield pa.RecordBatch.from_pylist([{"path": path, "part": part, "_error": _fault(e)}], schema=schema)
                except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "_error": _fault(e)}], schema=schema)

    return found.select("path", "content").mapInArrow(cut, PIECE)


def _parsed(pieces: DataFrame, limits: dict) -> DataFrame:
    """Cells of pieces by themselves, and for each piece a row more that sums it up, with a fault if it has one."""
    ddl = f"{CELL}, {_SUMMARY}"
    schema = arrow_schema(ddl)
    width, more = len(arrow_schema(CELL)), len(arrow_schema(_SUMMARY))

    def batch(path: str, part: str, piece: int, rows: list[tuple]) -> pa.RecordBatch:
        full = [(path, part, *r, piece, *[None] * (more - 1)) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], f.type) for i, f in enumerate(schema)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for path, part, piece, head, text, tail in zip(*(c.to_pylist() for c in some.columns), strict=True):
                reader, fault = _Cells(limits), None
                reader.next_row = _UNKNOWN if piece else 0
                try:
                    reader.parser.Parse(head, False)
                    for at in range(0, len(text), _CHUNK):
                        reader.parser.Parse(text[at : at + _CHUNK], False)
                        if len(reader.rows) >= _ROWS:
                            yield batch(path, part, piece, reader.rows)
                            reader.rows = []
                    reader.parser.Parse(tail, True)
                except (expat.ExpatError, ValueError) as e:
                    fault = str(e)
                yield batch(path, part, piece, reader.rows)
                summary = {"path": path, "part": part, "_error": fault, "piece": piece, "next_row": reader.next_row, "n_rows": reader.row_ord + 1, "n_cells": reader.cell_ord + 1, "seen": reader.seen}
                yield pa.RecordBatch.from_pylist([summary], schema=schema)

    assert width + more == len(schema)
    return pieces.filter("bytes IS NOT NULL").select("path", "part", "piece", "head", "bytes", "tail").mapInArrow(read, ddl)


def piece_cells(pieces: DataFrame, limits: dict | None = None) -> DataFrame:
    """The cells of pieces as sheet_cells() gives them for whole parts.

    Pieces and what is parsed from them are written to the shared folder, one after another by all tasks. A part with a fault in
    any piece, or with more elements than its quota, is put together and read whole, so that its cells end where its fault
    is; a part that came with an error is that error only.
    """
    limits = LIMITS | (limits or {})
    pieces = stored(pieces.repartition("path", "part", "piece"))
    parsed = stored(_parsed(pieces, limits))
    lost = pieces.filter("_error IS NOT NULL").select(*_PART, "_error")
    marks = parsed.filter("n_rows IS NOT NULL").join(lost.select(*_PART).distinct(), _PART, "left_anti")
    again = marks.groupBy(_PART).agg((F.max(F.col("_error").isNotNull()) | (F.sum("seen") > limits["nodes"])).alias("again")).filter("again").select(_PART)

    # Pieces of one part are as few as its quota allows. A number that a piece gives starts a run, in which later rows add up.
    inner = Window.partitionBy(_PART).orderBy("piece")
    known = F.col("next_row") >= 0
    runs = marks.join(again, _PART, "left_anti").withColumn("_run", F.sum(known.cast("int")).over(inner))
    reached = F.sum(F.when(known, F.col("next_row")).otherwise(F.col("next_row") - _UNKNOWN)).over(Window.partitionBy(*_PART, "_run").orderBy("piece"))
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_reached", reached).select(*_PART, "piece", F.lag("_reached", 1, 0).over(inner).alias("_row"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("n_rows", "n_cells")])

    names = [c.split()[0] for c in CELL.split(", ")]
    cells = parsed.filter("n_rows IS NULL").drop("n_rows", "n_cells").join(starts, [*_PART, "piece"])
    row = F.when(F.col("row") < 0, F.col("row") - _UNKNOWN + F.col("_row")).otherwise(F.col("row")).cast("int")
    cells = cells.withColumns({"row": row, "row_ord": F.col("row_ord") + F.col("_n_rows"), "cell_ord": F.col("cell_ord") + F.col("_n_cells")})
    beyond = F.coalesce((F.col("row") >= min(limits["rows"], _MOST_ROWS)) & F.col("cell_ord").isNotNull(), F.lit(False))
    placed = cells.withColumns({"_error": F.when(beyond, "BadCellRef").otherwise(F.col("_error")), "row": F.when(~beyond, F.col("row")), "col": F.when(~beyond, F.col("col"))}).select(names)

    joined = pieces.join(again, _PART, "left_semi").groupBy(_PART).agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY piece)").alias("bytes"))
    faults = lost.select(*[F.col(c) if c in lost.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in CELL.split(", "))])
    return placed.unionByName(sheet_cells(joined, limits)).unionByName(faults)
