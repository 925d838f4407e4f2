"""One pass over spreadsheet packages: cells, shared strings, and the nodes of their small parts, as one stream of rows.

What a part is follows from its first element, wherever that stands and however the part is encoded; relationships are
followed afterwards, by joins. An archive is opened once, a member is inflated piece by piece, and a member that is no part of a
workbook is left at its first element.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.sources.packages import LIMITS, NODE, _fault, _open, _Walk
from cellarium.sources.sheets import CELL, ITEM, _Cells, _Items, arrow_schema

#: Bytes inflated and parsed at once, and rows after which a batch goes on.
_CHUNK, _ROWS = 1 << 18, 20_000
_OWN = "path string, part string, kind string, _error string"
_KINDS = {"cell": [c for c in CELL.split(", ") if c.split()[0] not in ("path", "part")], "item": [c for c in ITEM.split(", ") if c.split()[0] not in ("path", "part")], "node": [c for c in NODE.split(", ") if c.split()[0] not in ("path", "part")]}
BOOK = f"{_OWN}, " + ", ".join(f"{k} struct<{', '.join(x.replace(' ', ': ', 1) for x in columns)}>" for k, columns in _KINDS.items())
_STRUCTS = {k: pa.struct(list(arrow_schema(", ".join(columns)))) for k, columns in _KINDS.items()}
_SCHEMA = pa.schema([*arrow_schema(_OWN), *(pa.field(k, t) for k, t in _STRUCTS.items())])


class _Other(Exception):
    """The first element is that of no part of a workbook."""


class _Nodes:
    """_Walk with the rows of the readers of sheets."""

    def __init__(self, limits: dict):
        self.walk = _Walk(limits)
        self.parser = self.walk.parser

    @property
    def rows(self) -> list:
        return [(*r[:6], list(r[6].items()), *r[7:]) for r in self.walk.rows]

    @rows.setter
    def rows(self, _: list) -> None:
        self.walk.rows = []


# First elements of the parts of a workbook that cells follow from.
_READERS = {"worksheet": ("cell", _Cells), "sst": ("item", _Items), "workbook": ("node", _Nodes), "Relationships": ("node", _Nodes), "Types": ("node", _Nodes)}


class _First:
    """The local name of a part's first element, as soon as it has been read."""

    def __init__(self):
        self.parser, self.name = expat.ParserCreate(namespace_separator="\n"), None
        self.parser.StartElementHandler, self.parser.StartDoctypeDeclHandler = self.start, self.doctype

    def start(self, name: str, _: dict) -> None:
        self.name = self.name or name.rpartition("\n")[2]

    def doctype(self, *_) -> None:
        raise ValueError("Doctype")


def _batch(path: str, part: str | None, kind: str, rows: list[tuple], fault: str | None = None) -> pa.RecordBatch:
    n = 1 if kind == "fault" else len(rows)
    columns = [pa.array([path] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array([fault] * n, pa.string())]
    for k, t in _STRUCTS.items():
        if k == kind:
            fields = zip(*rows, strict=True) if rows else [()] * t.num_fields
            columns.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(fields, t, strict=True)], fields=list(t)))
        else:
            columns.append(pa.nulls(n, t))
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _pieces(archive: zipfile.ZipFile, info: zipfile.ZipInfo, limits: dict) -> Iterator[bytes]:
    """A member's bytes; what comes out is checked against the quotas as it comes, whatever the directory says."""
    if info.file_size > limits["part"]:
        raise ValueError("LimitPart")
    if info.compress_size and info.file_size // info.compress_size > limits["ratio"]:
        raise ValueError("LimitRatio")
    out = 0
    with archive.open(info) as member:
        while piece := member.read(_CHUNK):
            out += len(piece)
            if out > limits["part"]:
                raise ValueError("LimitPart")
            yield piece


def _part_rows(path: str, part: str, pieces: Iterator[bytes], limits: dict, kinds: set[str] | None = None) -> Iterator[pa.RecordBatch]:
    kind, reader, first, seen = "fault", None, _First(), []
    try:
        for piece in pieces:
            if reader is None:
                seen.append(piece)
                first.parser.Parse(piece, False)
                if first.name is None:
                    continue
                if first.name not in _READERS:
                    raise _Other
                kind, make = _READERS[first.name]
                if kinds is not None and kinds.isdisjoint({kind, "fault", *(["sheet"] if kind == "cell" else [])}):
                    raise _Other
                reader, piece, seen = make(limits), b"".join(seen), []
                if kind == "cell":
                    yield _batch(path, part, "sheet", [()])
                    if kinds is not None and kinds.isdisjoint({"cell", "fault"}):
                        raise _Other  # that it is a sheet is all that is asked
            reader.parser.Parse(piece, False)
            if kind != "node" and len(reader.rows) >= _ROWS:
                yield _batch(path, part, kind, [(*r, *[None] * (_STRUCTS[kind].num_fields - len(r))) for r in reader.rows])
                reader.rows = []
        (reader or first).parser.Parse(b"", True)
        fault = None
    except _Other:
        return
    except (expat.ExpatError, ValueError) as e:
        fault = "Malformed" if isinstance(e, expat.ExpatError) else str(e)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
        fault = _fault(e)
    if reader is not None and not (fault and kind == "node"):
        yield _batch(path, part, kind, [(*r, *[None] * (_STRUCTS[kind].num_fields - len(r))) for r in reader.rows])
    if fault is not None:
        yield _batch(path, part, "fault", [], fault)


def archive_rows(path: str, content: bytes | None, limits: dict, parts: set[str] | None = None, kinds: set[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of one archive, in batches; with parts and kinds, at least the rows of these, and no part beyond need is read to its end."""
    try:
        archive = _open(content or b"", limits)
        infos = [i for i in archive.infolist() if not i.orig_filename.endswith("/")]
    except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
        yield _batch(path, None, "fault", [], _fault(e))
        return
    for info in infos:
        name = "/" + info.orig_filename.lstrip("/")
        if parts is None or name in parts:
            yield from _part_rows(path, name, _pieces(archive, info, limits), limits, kinds)


def book_rows(found: DataFrame, limits: dict | None = None, kinds: set[str] | None = None) -> DataFrame:
    """path, part, kind and, by kind, cell (as of sheet_cells), item (of string_items) or node (of xml_nodes) of packages (path, content).

    kind is sheet for one row of each sheet part, cells or not. It is fault, with _error, for an archive that can't be read (no part), for a part that can't be read to its end, and for a member
    that is no XML at all, which need not matter. With kinds, at least the rows of these, and no part beyond need is read to its end.
    """
    limits = LIMITS | (limits or {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from archive_rows(path, content.as_py(), limits, kinds=kinds)

    return found.select("path", "content").mapInArrow(read, BOOK)


def rows_of(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind, as columns."""
    names = [c.split()[0] for c in _KINDS[kind]]
    return rows.filter(F.col("kind") == kind).select("path", "part", *[F.col(f"{kind}.{c}").alias(c) for c in names])
