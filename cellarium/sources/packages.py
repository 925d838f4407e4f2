"""Spreadsheet packages as DataFrames: members, XML nodes, raw cells. Python touches the bytes once; the rest is columns."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.functions.addresses import MAX_ROW
from cellarium.functions.markup import part_key

# Quotas of the strict profile; rows is how many a sheet may number.
LIMITS = {"input": 64 << 20, "entries": 8192, "part": 128 << 20, "total": 512 << 20, "ratio": 200, "depth": 256, "attrs": 4096, "nodes": 8_000_000, "name": 1024, "rows": MAX_ROW + 1}
#: No quota at all, for packages that one has made oneself.
PERMISSIVE = dict.fromkeys(LIMITS, 1 << 62) | {"rows": LIMITS["rows"]}
SML = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def packages(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of each file under path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


ENTRY = "path string, idx int, name string, flags int, method int, dos_time int, dos_date int, crc32 long, comp_size long, uncomp_size long, header_start long, version_needed int, external_attrs long, extra binary, comment binary, is_dir boolean, data_start long, data_end long, end long, cd_start long, cd_end long, prefix long, length long, _error string"


def _open(content: bytes, limits: dict) -> zipfile.ZipFile:
    if len(content) > limits["input"]:
        raise ValueError("LimitInput")
    archive = zipfile.ZipFile(io.BytesIO(content))
    infos = archive.infolist()
    if len(infos) > limits["entries"]:
        raise ValueError("LimitEntries")
    if sum(i.file_size for i in infos) > limits["total"]:
        raise ValueError("LimitTotal")
    if any(len(i.orig_filename.encode()) > limits["name"] for i in infos):
        raise ValueError("LimitName")
    return archive


def _fault(e: Exception) -> str:
    return str(e) if isinstance(e, ValueError) and str(e).isalpha() else type(e).__name__


def extent(content: bytes, info: zipfile.ZipInfo) -> tuple[int, int, int]:
    """Where a member's data begin and end, and where all of it ends, with the descriptor that may follow."""
    at = info.header_offset
    name, extra = struct.unpack_from("<HH", content, at + 26)
    start = at + 30 + name + extra
    end = start + info.compress_size
    signed = content[end : end + 4] == b"PK\x07\x08"
    return start, end, end + (12 + 4 * signed if info.flag_bits & 8 else 0)


def directory(archive: zipfile.ZipFile, content: bytes) -> dict[str, int]:
    """Where the directory begins and the archive ends, what stands before the archive, and how long all is."""
    end = content.rfind(b"PK\x05\x06")
    size, at, comment = struct.unpack_from("<IIH", content, end + 12)
    wide = content[end - 20 : end - 16] == b"PK\x06\x07"
    return {"cd_start": archive.start_dir, "cd_end": end + 22 + comment, "prefix": 0 if wide else archive.start_dir - at, "length": len(content)}


def archive_gaps(members: DataFrame) -> DataFrame:
    """path, start, end, kind of what no member of entries() covers: prefix, gap, before the directory, trailing; overlap where two do."""
    good = members.filter("_error IS NULL OR header_start IS NOT NULL")
    before = F.lag("end").over(Window.partitionBy("path").orderBy("header_start", "idx"))  # an archive's members are bounded by its quota
    spans = good.select("path", "header_start", before.alias("before"))
    between = spans.filter("before <> header_start").select("path", F.least("before", "header_start").alias("start"), F.greatest("before", "header_start").alias("end"), F.when(F.col("before") > F.col("header_start"), "overlap").otherwise("gap").alias("kind"))
    whole = good.groupBy("path").agg(F.min("header_start").alias("first"), F.max("end").alias("last"), *[F.first(c).alias(c) for c in ("cd_start", "cd_end", "length")])
    ends = whole.select("path", F.explode(F.array(*[F.struct(a.cast("long").alias("start"), b.alias("end"), F.lit(k).alias("kind")) for a, b, k in ((F.lit(0), F.col("first"), "prefix"), (F.col("last"), F.col("cd_start"), "before directory"), (F.col("cd_end"), F.col("length"), "trailing"))])).alias("x")).select("path", "x.*")
    return between.unionByName(ends.filter("start < end"))


def entry_rows(path: str, content: bytes | None, limits: dict) -> list[dict]:
    """The rows of entries() of one archive."""
    rows: list[dict] = []
    try:
        archive = _open(content or b"", limits)
        around = directory(archive, content)
        for idx, i in enumerate(archive.infolist()):
            y, mo, d, h, mi, s = i.date_time
            fault = "Encrypted" if i.flag_bits & 65 else "UnsupportedMethod" if i.compress_type not in (0, 8) else None
            rows.append(dict(path=path, idx=idx, name=i.orig_filename, flags=i.flag_bits, method=i.compress_type, dos_time=h << 11 | mi << 5 | s // 2, dos_date=(y - 1980) << 9 | mo << 5 | d, crc32=i.CRC, comp_size=i.compress_size, uncomp_size=i.file_size, header_start=i.header_offset, version_needed=i.extract_version, external_attrs=i.external_attr, extra=i.extra, comment=i.comment, is_dir=i.orig_filename.endswith("/"), **dict(zip(("data_start", "data_end", "end"), extent(content, i), strict=True)), **around, _error=fault))
    except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
        rows.append(dict(path=path, _error=_fault(e)))
    return rows


def entries(found: DataFrame, limits: dict | None = None) -> DataFrame:
    """One row for each member of the archives (path, content), in the order of the directory; nothing is decompressed.

    An archive that can't be read is one row with _error; so is a null content.
    """
    limits = LIMITS | (limits or {})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        for frame in frames:
            rows = [r for path, content in zip(frame["path"], frame["content"], strict=True) for r in entry_rows(path, content, limits)]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.where(out.notna(), None)

    return found.select("path", "content").mapInPandas(read, ENTRY)


def raw_members(found: DataFrame, limits: dict | None = None) -> DataFrame:
    """path, idx, name, raw: the compressed bytes of each member as they stand; archives that can't be read have none."""
    at = entries(found, limits).filter("_error IS NULL").select("path", "idx", "name", "data_start", "data_end")
    data = F.substring(F.col("content"), (F.col("data_start") + 1).cast("int"), (F.col("data_end") - F.col("data_start")).cast("int"))
    return found.select("path", "content").join(at, "path").select("path", "idx", "name", data.alias("raw"))


def is_limit(error: Column) -> Column:
    """Whether an error names a quota."""
    return error.startswith("Limit")


_ROOT = re.compile(rb"<(?![?!])(?:[^\s<>/:]+:)?([^\s<>/:]+)")


def _root(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> str | None:
    """The local name of the first element of a member, from its first bytes."""
    with archive.open(info) as member:
        m = _ROOT.search(re.sub(rb"<!--.*?-->", b"", member.read(8192), flags=re.DOTALL))
    return m[1].decode("utf-8", "replace") if m else None


def parts(found: DataFrame, pattern: str = ".*", limits: dict | None = None, roots: set[str] | None = None) -> DataFrame:
    """path, part (with a leading slash), bytes, _error of members whose part name matches, decompressed within quotas.

    With roots, only members whose first element has one of these local names. An archive that can't be read is one row with
    _error and no part.
    """
    limits, wanted = LIMITS | (limits or {}), re.compile(pattern, re.DOTALL)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows: list[tuple] = []
                try:
                    archive = _open(content or b"", limits)
                    for i in archive.infolist():
                        name = "/" + i.orig_filename.lstrip("/")
                        if i.orig_filename.endswith("/") or not wanted.fullmatch(name):
                            continue
                        if i.file_size > limits["part"] or i.compress_size and i.file_size // i.compress_size > limits["ratio"]:
                            rows.append((path, name, None, "LimitPart" if i.file_size > limits["part"] else "LimitRatio"))
                            continue
                        try:
                            if roots is None or _root(archive, i) in roots:
                                rows.append((path, name, archive.read(i), None))
                        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
                            rows.append((path, name, None, _fault(e)))
                except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
                    rows.append((path, None, None, _fault(e)))
                yield pd.DataFrame(rows, columns=["path", "part", "bytes", "_error"], dtype=object)

    return found.select("path", "content").mapInPandas(read, "path string, part string, bytes binary, _error string")


def named_parts(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, part (as the archive names it), bytes of just the parts in wanted (path, part), whatever the case of A-Z; those that are
    not there, or can't be read, are no rows."""
    keys = wanted.groupBy("path").agg(F.collect_set(part_key(F.col("part"))).alias("keys"))  # parts of one package

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for path, content, asked in zip(frame["path"], frame["content"], frame["keys"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                    named = [(i, "/" + i.orig_filename.lstrip("/")) for i in archive.infolist()]
                    rows += [(path, name, archive.read(i)) for i, name in named if "".join(c.lower() if c.isascii() else c for c in name) in asked]
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "part", "bytes"], dtype=object)

    return found.select("path", "content").join(keys, "path").mapInPandas(read, "path string, part string, bytes binary")


class _Walk:
    """Rows of one part's elements, in document order."""

    def __init__(self, limits: dict):
        self.rows: list[list] = []
        self.open: list[int] = []
        self.counts: list[int] = [0]
        self.limits = limits
        self.parser = expat.ParserCreate(namespace_separator="\n")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.text
        self.parser.StartDoctypeDeclHandler = self.doctype

    def doctype(self, *_):
        raise ValueError("Doctype")

    def start(self, name: str, attrs: dict) -> None:
        if len(self.open) >= self.limits["depth"] or len(attrs) > self.limits["attrs"] or len(self.rows) >= self.limits["nodes"]:
            raise ValueError("LimitDepth" if len(self.open) >= self.limits["depth"] else "LimitAttrs" if len(attrs) > self.limits["attrs"] else "LimitNodes")
        ns, _, local = name.rpartition("\n")
        node = len(self.rows)
        self.rows.append([node, self.open[-1] if self.open else None, self.counts[-1], len(self.open), local, ns or None, {k.rpartition("\n")[2] if "\n" not in k else k.replace("\n", "#"): v for k, v in attrs.items()}, "", self.parser.CurrentByteIndex])
        self.counts[-1] += 1
        self.counts.append(0)
        self.open.append(node)

    def end(self, _: str) -> None:
        self.open.pop()
        self.counts.pop()

    def text(self, data: str) -> None:
        self.rows[self.open[-1]][7] += data


#: Elements that go on to Spark at once.
_ROWS = 20_000
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}
NODE = "path string, part string, node_id long, parent_id long, ord int, depth int, local string, ns string, attrs map<string,string>, text string, start long, _error string"


def xml_nodes(members: DataFrame, limits: dict | None = None) -> DataFrame:
    """Elements of XML parts (path, part, bytes): numbered in document order, with their own text.

    A part that isn't well-formed, has a DOCTYPE or exceeds a quota is one row with _error; one that came with an _error
    keeps it.
    """
    limits = LIMITS | (limits or {})

    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in NODE.split(", "))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # of many small parts, so that they go on together
        for some in batches:
            for path, part, content, fault in zip(*some.columns, strict=True):
                path, part, fault, walk = path.as_py(), part.as_py(), fault.as_py(), _Walk(limits)
                try:
                    if fault is not None:
                        raise ValueError(fault)
                    walk.parser.Parse(content.as_py() or b"", True)
                    rows += [(path, part, *r[:6], list(r[6].items()), *r[7:], None) for r in walk.rows]
                except (expat.ExpatError, ValueError) as e:
                    rows.append((path, part, *[None] * 9, "Malformed" if isinstance(e, expat.ExpatError) else str(e)))
                if len(rows) >= _ROWS:
                    for at in range(0, len(rows), _ROWS):
                        yield batch(rows[at : at + _ROWS])
                    rows = []
        if rows:
            yield batch(rows)

    faults = "_error" if "_error" in members.columns else F.lit(None).cast("string").alias("_error")
    return members.select("path", "part", "bytes", faults).mapInArrow(read, NODE)


def spreadsheet_nodes(nodes: DataFrame) -> DataFrame:
    """Elements of the spreadsheet vocabulary: its namespace or none at all."""
    return nodes.filter(F.coalesce("ns", F.lit(SML)) == SML)
