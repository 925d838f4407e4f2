"""Sheets and shared strings in one pass: a cell or an item is a row when its element closes, whatever the part's size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.functions.addresses import MAX_COL
from cellarium.sources.packages import LIMITS, SML

#: Bytes handed to the parser at once, and rows after which a batch goes on.
_CHUNK, _ROWS = 1 << 18, 20_000
_ADDRESS = re.compile("([A-Za-z]{1,3})([0-9]{1,10})")
_WHOLE = re.compile("[0-9]{1,10}")
#: Most rows that a sheet may number, whatever its quota, so that places stay whole numbers of 32 bits.
_MOST_ROWS = 1 << 30

CELL = "path string, part string, row_ord long, cell_ord long, row int, col int, row_r string, cell_r string, t string, s string, v string, is_text string, f_text string, f_t string, f_ref string, f_si string, _error string"
ITEM = "path string, part string, idx long, text string, runs int, preserved int, simple boolean, _error string"


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


class _Texts:
    """The text of an item: its own fragment or its runs in order, phonetic ones left out."""

    def __init__(self):
        self.parts: list[str] = []
        self.runs = self.preserved = self.fragments = 0
        self.phonetic = False
        self.inside = False
        self.run = False

    def open(self, name: str, attrs: dict) -> None:
        if name == "rPh":
            self.phonetic = True
        elif name == "r":
            self.run = True
        elif name == "t" and not self.phonetic:
            self.inside = True
            self.runs += 1
            self.fragments += not self.run
            self.preserved += attrs.get("http://www.w3.org/XML/1998/namespace\nspace") == "preserve"

    def close(self, name: str) -> None:
        if name == "rPh":
            self.phonetic = False
        elif name == "r":
            self.run = False
        elif name == "t":
            self.inside = False

    def text(self) -> str:
        return "".join(self.parts)


class _Reader:
    """Element names of the spreadsheet vocabulary, from bytes in pieces; a DOCTYPE and too deep or too many elements are faults."""

    def __init__(self, limits: dict):
        self.rows: list[tuple] = []
        self.limits, self.depth, self.seen = limits, 0, 0
        self.parser = expat.ParserCreate(namespace_separator="\n")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._start, self._end, self.text
        self.parser.StartDoctypeDeclHandler = self._doctype

    def _doctype(self, *_):
        raise ValueError("Doctype")

    def _start(self, name: str, attrs: dict) -> None:
        self.depth += 1
        self.seen += 1
        if self.depth > self.limits["depth"] or self.seen > self.limits["nodes"]:
            raise ValueError("LimitDepth" if self.depth > self.limits["depth"] else "LimitNodes")
        ns, _, local = name.rpartition("\n")
        if not ns or ns == SML:
            self.open(local, attrs)

    def _end(self, name: str) -> None:
        self.depth -= 1
        ns, _, local = name.rpartition("\n")
        if not ns or ns == SML:
            self.close(local)


class _Cells(_Reader):
    """Cells of a sheet. A cell's own address wins over its row's; without one it follows the cell before it, a row without
    a number the row before it. A row without cells is a row of its own, for it counts too."""

    def __init__(self, limits: dict):
        super().__init__(limits)
        self.row_ord, self.cell_ord, self.next_row, self.next_col = -1, -1, 0, 0
        self.in_row = self.cell = self.into = self.texts = None
        self.in_data = False
        self.most = min(limits["rows"], _MOST_ROWS)
        self.digits = len(str(self.most))

    def open(self, name: str, attrs: dict) -> None:
        if name == "sheetData":
            self.in_data = True
        elif not self.in_data:
            return
        elif name == "row":
            self.row_ord += 1
            given = attrs.get("r")
            number = int(given) - 1 if given is not None and len(given) <= self.digits and _WHOLE.fullmatch(given) else None
            bad = given is not None and (number is None or not 0 <= number < self.most)
            row = self.next_row if given is None else None if bad else number
            self.next_row, self.next_col = (self.next_row if row is None else row) + 1, 0
            self.in_row = [row, given, "BadRowNumber" if bad else None, 0]
        elif name == "c":
            self._cell(attrs)
        elif self.cell is not None and name in ("v", "f"):
            self.into = name
            self.cell[name] = ""
            if name == "f":
                self.cell.update(f_t=attrs.get("t"), f_ref=attrs.get("ref"), f_si=attrs.get("si"))
        elif self.cell is not None and name == "is":
            self.texts = _Texts()
        elif self.texts is not None:
            self.texts.open(name, attrs)

    def _cell(self, attrs: dict) -> None:
        row, row_r, fault, _ = self.in_row or [None, None, None, 0]
        if self.in_row:
            self.in_row[3] += 1
        self.cell_ord += 1
        given, col = attrs.get("r"), self.next_col
        if given is not None:
            m, fault = _ADDRESS.fullmatch(given), None
            row = col = None
            if m and len(m[2]) <= self.digits:
                col = 0
                for c in m[1].upper():
                    col = col * 26 + ord(c) - 64
                row, col = int(m[2]) - 1, col - 1
            if row is None or not (0 <= row < self.most and col <= MAX_COL):
                row, col, fault = None, None, "BadCellRef"
        elif row is not None and (row >= self.most or col > MAX_COL):
            row, col, fault = None, None, "BadCellRef"
        self.next_col = (self.next_col if col is None else col) + 1
        self.cell = {"row": row, "col": col, "row_r": row_r, "r": given, "t": attrs.get("t"), "s": attrs.get("s"), "fault": fault}

    def close(self, name: str) -> None:
        if name == "sheetData":
            self.in_data = False
        elif name == "c" and self.cell is not None:
            c = self.cell
            text = self.texts.text() if self.texts is not None else None
            self.rows.append((self.row_ord, self.cell_ord, c["row"], c["col"], c["row_r"], c["r"], c["t"], c["s"], c.get("v"), text, c.get("f"), c.get("f_t"), c.get("f_ref"), c.get("f_si"), c["fault"]))
            self.cell = self.into = self.texts = None
        elif name in ("v", "f"):
            self.into = None
        elif name == "row" and self.in_row is not None:
            row, given, fault, cells = self.in_row
            if not cells:
                self.rows.append((self.row_ord, None, row, None, given, *[None] * 9, fault))
            self.in_row = None
        elif self.texts is not None and name != "is":
            self.texts.close(name)

    def text(self, data: str) -> None:
        if self.into is not None:
            self.cell[self.into] += data
        elif self.texts is not None and self.texts.inside:
            self.texts.parts.append(data)


class _Items(_Reader):
    """Items of a table of shared strings."""

    def __init__(self, limits: dict):
        super().__init__(limits)
        self.idx, self.texts = 0, None

    def open(self, name: str, attrs: dict) -> None:
        if name == "si":
            self.texts = _Texts()
        elif self.texts is not None:
            self.texts.open(name, attrs)

    def close(self, name: str) -> None:
        if name == "si" and self.texts is not None:
            t = self.texts
            self.rows.append((self.idx, t.text(), t.runs, t.preserved, t.fragments == 1 and t.runs == 1, None))
            self.idx, self.texts = self.idx + 1, None
        elif self.texts is not None:
            self.texts.close(name)

    def text(self, data: str) -> None:
        if self.texts is not None and self.texts.inside:
            self.texts.parts.append(data)


def _read(members: DataFrame, ddl: str, make: Callable[[dict], _Reader], limits: dict | None) -> DataFrame:
    limits, schema = LIMITS | (limits or {}), arrow_schema(ddl)

    def batch(path: str, part: str, rows: list[tuple]) -> pa.RecordBatch:
        columns = [[path] * len(rows), [part] * len(rows), *(zip(*rows, strict=True) if rows else [()] * (len(schema) - 2))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for path, part, content, fault in zip(*(some.column(i).to_pylist() for i in range(4)), strict=True):
                reader = make(limits)
                if fault is None:
                    try:
                        for at in range(0, len(content), _CHUNK):
                            reader.parser.Parse(content[at : at + _CHUNK], False)
                            if len(reader.rows) >= _ROWS:
                                yield batch(path, part, reader.rows)
                                reader.rows = []
                        reader.parser.Parse(b"", True)
                    except (expat.ExpatError, ValueError) as e:
                        fault = "Malformed" if isinstance(e, expat.ExpatError) else str(e)
                yield batch(path, part, reader.rows)
                if fault is not None:
                    yield batch(path, part, [(*[None] * (len(schema) - 3), fault)])

    faults = "_error" if "_error" in members.columns else F.lit(None).cast("string").alias("_error")
    return members.select("path", "part", "bytes", faults).mapInArrow(read, ddl)


def sheet_cells(members: DataFrame, limits: dict | None = None) -> DataFrame:
    """Cells of sheet parts (path, part, bytes, _error) as they stand, with their places; rows without cells have no cell_ord.

    row and col count from 0 and are null where an address or a row number is none, which _error names. A part that can't be
    read to its end is one more row with _error; so is one that came with an error.
    """
    return _read(members, CELL, _Cells, limits)


def string_items(members: DataFrame, limits: dict | None = None) -> DataFrame:
    """Items of tables of shared strings (path, part, bytes, _error): text before escapes are undone, how many fragments it
    has, how many keep their white space, and whether it is one plain text."""
    return _read(members, ITEM, _Items, limits)
