"""Edits of cells put among the bytes of a sheet in one pass over it; what no edit names stays byte for byte."""

from __future__ import annotations

import functools
import io
import re
import zipfile
import zlib
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.functions.addresses import MAX_COL, MAX_ROW
from cellarium.sources.books import _pieces
from cellarium.sources.packages import LIMITS, _fault, _open
from cellarium.sources.sheets import _Cells, arrow_schema
from cellarium.sources.xml_events import _ATTR, _EVENT, _NAME, _events

_ATTRIBUTE = re.compile(r"""\s([^\s<>/="']+)\s*=\s*("[^"]*"|'[^']*')""", re.ASCII)
#: An end, or a start with its attributes: of an element closed at once, of one that holds a text and nothing else (with its end), or of any other.
_TAG = re.compile(rb"<(?:/(" + _NAME + rb")\s*>|(" + _NAME + rb")((?:\s+" + _NAME + rb"\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(?:(/)>|>(?:([^<]*)</\2\s*>)?))")
_OWN_R = re.compile(rb'\s+r="([^"&]*)"')
_REFERENCE = re.compile(r"&(?:#x([0-9A-Fa-f]{1,8})|#([0-9]{1,10})|([A-Za-z]+));|&")
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
_A1, _ROW = re.compile("^([A-Za-z]{1,3})([0-9]{1,7})$"), re.compile("^[0-9]{1,7}$")
# Elements of a sheet that come after its data.
AFTER_DATA = frozenset(
    "sheetCalcPr sheetProtection protectedRanges scenarios autoFilter sortState dataConsolidate customSheetViews mergeCells phoneticPr conditionalFormatting dataValidations hyperlinks printOptions pageMargins pageSetup headerFooter rowBreaks colBreaks customProperties cellWatches ignoredErrors smartTags drawing drawingHF picture oleObjects controls webPublishItems tableParts extLst".split()
)
_BLANK = " \t\n\r\v\f"
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError)


def _attribute(raw: str, name: str) -> str | None:
    """The value of an attribute of a start tag, as XML reads it; null without one, or where a reference is none."""
    value = next((q[1:-1] for n, q in _ATTRIBUTE.findall(raw) if n == name), None)
    if value is None or "&" not in value:
        return value
    out, last = [], 0
    for m in _REFERENCE.finditer(value):
        code = int(m[1], 16) if m[1] else int(m[2]) if m[2] else None
        text = _NAMED.get(m[3]) if m[3] else chr(code) if code is not None and code < 0x110000 else None
        if text is None:
            return None
        out += [value[last : m.start()], text]
        last = m.end()
    return "".join(out) + value[last:]


@functools.cache
def _column(letters: str) -> int:
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return col - 1


def _place(address: str | None) -> tuple[int, int] | None:
    m = _A1.search(address) if address else None
    if not m:
        return None
    row, col = int(m[2]) - 1, _column(m[1])
    return (row, col) if 0 <= row <= MAX_ROW and col <= MAX_COL else None


def _address(row: int, col: int) -> str:
    letters, n = "", col + 1
    while n:
        n, digit = divmod(n - 1, 26)
        letters = chr(65 + digit) + letters
    return f"{letters}{row + 1}"


def _tags(content: bytes, limits: dict) -> Iterator[tuple]:
    """The starts and ends of _events(): name (null for an end), attributes, where the start tag begins and ends, whether it closes at once,
    where the end tag begins and ends if it is known, depth, node and the node around it. A fault is that of _events(), which reads again.
    """
    try:
        content.decode()
        open_: list[tuple[bytes, int]] = []
        at, nodes, rooted, find, match = 0, 0, False, content.find, _TAG.match
        most_attrs, most_nodes, most_depth = limits["attrs"], limits["nodes"], limits["depth"]
        while True:
            start = find(b"<", at)
            if not open_ and start != at and content[at : start if start >= 0 else len(content)].decode().lstrip("\ufeff").strip():
                raise ValueError
            if start < 0:
                break
            m = match(content, start)
            if m is None:
                other = _EVENT.match(content, start)
                if other is None or other.lastgroup not in ("Decl", "Pi", "Comment", "CData") or not open_ and other.lastgroup == "CData":
                    raise ValueError
                at = other.end()
                continue
            at = m.end()
            end, name, attrs, closed, text = m.groups()
            if end is not None:
                if not open_ or open_[-1][0] != end:
                    raise ValueError
                _, node = open_.pop()
                yield None, None, 0, 0, False, start, at, len(open_), node, None
                continue
            if attrs and (most_attrs < 2 or attrs.count(b"=") > 1):
                names = _ATTR.findall(attrs)
                if len(names) > most_attrs or len(set(names)) < len(names):
                    raise ValueError
            if len(open_) >= most_depth or nodes >= most_nodes or not open_ and rooted:
                raise ValueError
            parent = open_[-1][1] if open_ else None
            if closed:
                yield name, attrs, start, at, True, at, at, len(open_), nodes, parent
            elif text is not None:
                yield name, attrs, start, m.start(5), False, m.end(5), at, len(open_), nodes, parent
            else:
                yield name, attrs, start, at, False, -1, -1, len(open_), nodes, parent
                open_.append((name, nodes))
            nodes, rooted = nodes + 1, True
        if open_ or not rooted:
            raise ValueError
    except ValueError:
        deque(_events(content, limits), 0)
        raise ValueError("Malformed") from None


class _Element:
    """Where an element's start tag begins and ends and where its end begins and ends, and what is to become of it."""

    __slots__ = ("name", "at", "end", "empty", "close", "stop", "node", "attributes", "last", "children")

    def __init__(self, name: bytes, at: int, end: int, empty: bool, close: int, stop: int, node: int):
        self.name, self.at, self.end, self.empty, self.close, self.stop, self.node = name, at, end, empty, close, stop, node
        self.attributes: list[tuple[str, str | None, str | None]] = []
        self.last: list[tuple[int, str]] = []
        self.children: list[_Element] | None = None


class _Line:
    """Elements in document order with their places: the first one of a place, and the first one of a later place."""

    def __init__(self):
        self.most: list[int] = []
        self.starts: list[int] = []
        self.first: dict = {}

    def add(self, key, place: int, element: _Element) -> None:
        self.first.setdefault(key, element)
        if not self.most or place > self.most[-1]:
            self.most.append(place)
            self.starts.append(element.at)

    def after(self, place: int) -> int | None:
        at = bisect_right(self.most, place)
        return self.starts[at] if at < len(self.starts) else None


class _Sheet:
    """The elements of a sheet that its edits need: rows, and the cells of the rows that are asked for."""

    def __init__(self, content: bytes, asked: set[int], limits: dict):
        self.root = self.data = self.dimension = self.after = None
        self.rows, self.cells = _Line(), {}
        row = cell = child = line = None
        next_row = next_col = number = cut = 0
        prefix = b""
        for name, attrs, at, end, empty, close, stop, depth, node, parent in _tags(content, limits):
            if depth > 4:
                continue
            if name is None:
                for e in (child, cell, row, self.data, self.root):
                    if e is not None and e.node == node:
                        e.close, e.stop = close, stop
                        break
                continue
            if depth >= 3 and line is None:
                continue
            if depth == 0:
                cut = name.rfind(b":") + 1
                prefix = name[:cut]
                self.root = _Element(name, at, end, empty, close, stop, node)
                continue
            if name.rfind(b":") + 1 != cut or name[:cut] != prefix:
                continue
            local = name[cut:]
            if depth == 1:
                if local == b"sheetData" and self.data is None:
                    self.data = _Element(name, at, end, empty, close, stop, node)
                elif local == b"dimension" and self.dimension is None:
                    self.dimension = _Element(name, at, end, empty, close, stop, node)
                elif self.after is None and local.decode() in AFTER_DATA:
                    self.after = at
            elif depth == 2:
                if local == b"row" and self.data is not None and parent == self.data.node:
                    row = _Element(name, at, end, empty, close, stop, node)
                    given = _given(attrs)
                    m = _ROW.search(given) if given else None
                    value = int(m[0]) - 1 if m else -1
                    number = value if 0 <= value <= MAX_ROW else next_row
                    next_row, next_col, line = number + 1, 0, None
                    if number in asked and number not in self.rows.first:
                        line = self.cells[number] = _Line()
                    self.rows.add(number, number, row)
            elif depth == 3:
                if local == b"c" and parent == row.node:
                    cell = _Element(name, at, end, empty, close, stop, node)
                    place = _place(_given(attrs))
                    col = place[1] if place else next_col
                    next_col = col + 1
                    line.add((place[0] if place else number, col), col, cell)
            elif local in (b"v", b"f", b"is") and cell is not None and parent == cell.node:
                child = _Element(name, at, end, empty, close, stop, node)
                cell.children = [*(cell.children or ()), child]
        self.prefix = prefix.decode()


def _given(attrs: bytes) -> str | None:
    """The attribute r, which mostly is the first one."""
    m = _OWN_R.match(attrs)
    return m[1].decode() if m else _attribute(attrs.decode(), "r") if attrs else None


def _tag(qname: str, attributes: list[tuple[str, str | None]], content: str | None = None) -> str:
    head = f"<{qname}" + "".join(f' {k}="{v}"' for k, v in attributes if v is not None)
    return f"{head}>{content}</{qname}>" if content else f"{head}/>"


def _with_attribute(raw: str, name: str, double: str | None, single: str | None) -> str:
    """A start tag with an attribute in its place and quotes, or after the others; null takes it away."""
    if name in raw:
        there, in_double, in_single, gone = _spelled(name)
        if double is None:
            return gone.sub("", raw)
        if there.search(raw):
            return in_single.sub(lambda m: f"{m[1]}'{single}'", in_double.sub(lambda m: f'{m[1]}"{double}"', raw))
    if double is None:
        return raw
    close = "/>" if raw.endswith("/>") else ">"
    return f'{raw[: -len(close)].rstrip(_BLANK)} {name}="{double}"{close}'


@functools.cache
def _spelled(name: str) -> list[re.Pattern]:
    key = rf"(\s{name}\s*=\s*)"
    return [re.compile(x, re.ASCII) for x in (key + "[\"']", key + '"[^"]*"', key + "'[^']*'", rf"""\s+{name}\s*=\s*("[^"]*"|'[^']*')""")]


def spliced(content: bytes, edits: list[dict], limits: dict) -> bytes:
    """A sheet's bytes after edits: row, col, kind, a1, t, s and s1 (for either quote), shown (a value), inner and keep (an inline text).

    What becomes of a sheet is said by splice_cells() of plans.saving, which does the same to tables of events.
    """
    sheet = _Sheet(content, {e["row"] for e in edits}, limits)
    q, touched, before = sheet.prefix, {}, defaultdict(list)

    def touch(e: _Element) -> _Element:
        touched[e.node] = e
        return e

    def put(next_: int | None, around: _Element, order: int, xml: str) -> None:
        before[next_].append((order, xml)) if next_ is not None else touch(around).last.append((order, xml))

    fresh: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for e in edits:
        kind, body = e["kind"], None
        if kind not in ("clear", "style"):
            body = _tag(f"{q}is", [], _tag(f"{q}t", [("xml:space", "preserve" if e["keep"] else None)], e["inner"])) if e["inline"] else _tag(f"{q}v", [], e["shown"])
        row = sheet.rows.first.get(e["row"])
        cell = row and sheet.cells[e["row"]].first.get((e["row"], e["col"]))
        if cell:
            if kind != "style":
                touch(cell).attributes.append(("t", e["t"], e["t"]))
            if e["s"] is not None:
                touch(cell).attributes.append(("s", e["s"], e["s1"]))
            if kind == "style":
                cell.children = None
            if body is not None:
                cell.last.append((0, body))
        elif kind != "clear":
            xml = _tag(f"{q}c", [("r", e["a1"]), ("s", e["s"]), ("t", e["t"])], body)
            if row:
                put(sheet.cells[e["row"]].after(e["col"]), row, e["col"], xml)
            else:
                fresh[e["row"]].append((e["col"], xml))
    rows = [(n, _tag(f"{q}row", [("r", str(n + 1))], "".join(xml for _, xml in sorted(cells)))) for n, cells in sorted(fresh.items())]
    if sheet.data is not None:
        for n, xml in rows:
            put(sheet.rows.after(n), sheet.data, n, xml)
    elif rows:
        put(sheet.after, sheet.root, 0, _tag(f"{q}sheetData", [], "".join(xml for _, xml in rows)))

    kept = [e for e in edits if e["kind"] != "clear"]
    ends = (_attribute(content[sheet.dimension.at : sheet.dimension.end].decode(), "ref") or "").split(":") if sheet.dimension and kept else []
    corners = [_place(x) for x in ends]
    if 1 <= len(corners) <= 2 and None not in corners:
        old = min(r for r, _ in corners), min(c for _, c in corners), max(r for r, _ in corners), max(c for _, c in corners)
        new = min(old[0], *(e["row"] for e in kept)), min(old[1], *(e["col"] for e in kept)), max(old[2], *(e["row"] for e in kept)), max(old[3], *(e["col"] for e in kept))
        if new != old:
            area = f"{_address(*new[:2])}:{_address(*new[2:])}"
            touch(sheet.dimension).attributes.append(("ref", area, area))

    ops = [(at, at, "".join(xml for _, xml in sorted(pieces))) for at, pieces in before.items()]
    for e in touched.values():
        raw, last = content[e.at : e.end].decode(), "".join(xml for _, xml in sorted(e.last))
        for name, double, single in sorted(e.attributes, key=lambda a: a[0]):
            raw = _with_attribute(raw, name, double, single)
        if e.last and e.empty:
            raw = raw[:-2].rstrip(_BLANK) + f">{last}</{e.name.decode()}>"
        elif e.last:
            ops.append((e.close, e.close, last))
        ops += [(e.at, e.end, raw), *((c.at, c.stop, "") for c in e.children or ())]
    out, at = [], 0
    for start, end, text in sorted(ops):
        out += [content[at:start], text.encode()]
        at = end
    return b"".join([*out, content[at:]])


def _each_part(found: DataFrame, asked: DataFrame, ddl: str, f: Callable[[str, zipfile.ZipFile, zipfile.ZipInfo, list[dict]], list[tuple]]) -> DataFrame:
    """path, part and f's rows of the parts in asked (path, part, and what f is told of a part, a row each) of packages (path, content)."""
    told = [c for c in asked.columns if c not in ("path", "part")]
    by_part = asked.groupBy("path", "part").agg(F.collect_list(F.struct(*(told or [F.lit(1).alias("one")]))).alias("told"))  # edits of one part
    wanted = by_part.groupBy("path").agg(F.collect_list(F.struct("part", "told")).alias("parts")).hint("merge")
    schema = arrow_schema(ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, parts in zip(batch.column("path"), batch.column("content"), batch.column("parts"), strict=True):
                told_of = {p["part"]: p["told"] for p in parts.as_py()}
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                    infos = archive.infolist()
                except _BROKEN:
                    continue
                for info in infos:
                    name = "/" + info.orig_filename.lstrip("/")
                    rows = f(path.as_py(), archive, info, told_of[name]) if name in told_of else []
                    if rows:
                        columns = [[path.as_py()] * len(rows), [name] * len(rows), *zip(*rows, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return found.select("path", "content").join(wanted, "path").mapInArrow(read, ddl)


def part_faults(found: DataFrame, asked: DataFrame, limits: dict | None = None) -> DataFrame:
    """path, part, _fault of those parts (path, part) that are not read to their end, as xml_events() names it; none for the others."""
    limits = LIMITS | (limits or {})

    def fault(_: str, archive: zipfile.ZipFile, info: zipfile.ZipInfo, __: list[dict]) -> list[tuple]:
        try:
            deque(_tags(archive.read(info), limits), 0)
        except ValueError as e:
            return [("NotUtf8" if isinstance(e, UnicodeDecodeError) else str(e),)]
        except _BROKEN as e:
            return [(_fault(e),)]
        return []

    return _each_part(found, asked.select("path", "part").distinct(), "path string, part string, _fault string", fault)


def splice_parts(found: DataFrame, edits: DataFrame, limits: dict | None = None) -> DataFrame:
    """path, part, bytes of sheets after edits (path, part, and what spliced() needs); those with a fault are no rows."""
    limits = LIMITS | (limits or {})

    def splice(_: str, archive: zipfile.ZipFile, info: zipfile.ZipInfo, told: list[dict]) -> list[tuple]:
        try:
            return [(spliced(archive.read(info), told, limits),)]
        except (ValueError, *_BROKEN):
            return []  # refused before, by part_faults()

    return _each_part(found, edits, "path string, part string, bytes binary", splice)


def asked_formats(found: DataFrame, asked: DataFrame, limits: dict | None = None) -> DataFrame:
    """path, part, row, col, s of the cells in asked (path, part, row, col) that are there: what their first element says of a format."""
    limits = LIMITS | (limits or {})

    def formats(_: str, archive: zipfile.ZipFile, info: zipfile.ZipInfo, told: list[dict]) -> list[tuple]:
        wanted, seen, reader = {(t["row"], t["col"]) for t in told}, {}, _Cells(limits)

        def keep() -> None:
            for r in reader.rows:
                if r[1] is not None and (r[2], r[3]) in wanted:
                    seen.setdefault((r[2], r[3]), r[7])
            reader.rows = []

        try:
            _open(archive.fp.getvalue(), limits)
            for piece in _pieces(archive, info, limits):
                reader.parser.Parse(piece, False)
                keep()
            reader.parser.Parse(b"", True)
        except (expat.ExpatError, ValueError, *_BROKEN):
            pass  # cells before a fault; the part itself is judged by part_faults()
        keep()
        return [(*place, s) for place, s in seen.items()]

    return _each_part(found, asked.select("path", "part", "row", "col"), "path string, part string, row long, col long, s string", formats)
