"""Workbooks from tables of cells."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.functions import markup, values
from cellarium.functions.addresses import a1
from cellarium.operators.grid import build_strings
from cellarium.sources.packages import LIMITS, directory, extent
from cellarium.sources.tables import stored

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_SML = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def sheet_cells_xml(cells: DataFrame, strings: DataFrame | None = None) -> DataFrame:
    """path, sheet, row, col, xml: the cell elements of sheets, texts through the shared strings of their package (build_strings())."""
    strings = build_strings(cells) if strings is None else strings
    # Cells without a text have keys of their own, which no string has.
    spare = F.pmod(F.hash("row", "col"), F.lit(4096))
    coded = cells.withColumn("_spare", F.when(F.col("text").isNull(), spare).otherwise(-1)).join(strings.withColumn("_spare", F.lit(-1)), ["path", "text", "_spare"], "left")
    place = F.concat(F.lit('<c r="'), a1("row", "col"), F.lit('"'))
    xml = (
        F.when(F.col("value_kind") == "number", F.concat(place, F.lit("><v>"), values.stored_number(F.col("num")), F.lit("</v></c>")))
        .when(F.col("value_kind") == "text", F.concat(place, F.lit(' t="s"><v>'), F.col("idx").cast("string"), F.lit("</v></c>")))
        .when(F.col("value_kind") == "bool", F.concat(place, F.lit(' t="b"><v>'), F.col("bool").cast("int").cast("string"), F.lit("</v></c>")))
        .otherwise(F.concat(place, F.lit("/>")))
    )
    return coded.select("path", "sheet", "row", "col", F.coalesce(xml, F.lit("")).alias("xml"))


def _row_elements(rows: np.ndarray, xml: list[str]) -> list[str]:
    """Cells in order, with the tags of their rows around them."""
    out, starts = [], [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), len(xml)]
    for first, end in zip(starts, starts[1:], strict=False):
        out += [f'<row r="{rows[first] + 1}">', *xml[first:end], "</row>"]
    return out


def build_packages(cells: DataFrame, limits: dict | None = None) -> DataFrame:
    """path, content, _error: one archive for each path of cells (path, sheet, row, col, value_kind, num, text, bool).

    Cells and strings are rendered as columns and put in order by Spark; a task only joins one package's pieces and compresses
    them, and a package beyond the quota of its readers is not built but a row with _error. All pieces are made once.
    """
    limits = LIMITS | (limits or {})
    strings = stored(build_strings(cells))
    rows = sheet_cells_xml(cells, strings).select("path", F.col("sheet").alias("a"), F.col("row").cast("long").alias("b"), F.col("col").cast("long").alias("c"), "xml")
    items = strings.select("path", F.lit(-1).alias("a"), F.col("idx").alias("b"), F.lit(0).cast("long").alias("c"), F.concat(F.lit('<si><t xml:space="preserve">'), markup.escape_text(markup.encode_x_escapes(F.col("text"))), F.lit("</t></si>")).alias("xml"))
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("_error", pa.string())])

    def build(pieces: pa.Table) -> pa.Table:
        made = lambda content, fault: pa.table([[pieces["path"][0].as_py()], [content], [fault]], schema=schema)
        if pieces["xml"].null_count:
            return made(None, "LimitPart")
        a, b, xml = pieces["a"].to_numpy(), pieces["b"].to_numpy(), pieces["xml"].to_pylist()
        names = [int(x) for x in np.unique(a) if x >= 0]
        body = {i: (xml[slice(*at)] if i < 0 else _row_elements(b[slice(*at)], xml[slice(*at)])) for i, at in ((i, np.searchsorted(a, [i, i + 1])) for i in (-1, *names))}
        if sum(len(x) for pieces_ in body.values() for x in pieces_) > limits["part"]:
            return made(None, "LimitPart")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:

            def put(name: str, body: str) -> None:
                archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + body, zipfile.ZIP_DEFLATED)

            over = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in names)
            put("[Content_Types].xml", f'<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{over}</Types>')
            put("_rels/.rels", f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            put("xl/workbook.xml", f'<workbook xmlns="{_SML}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="Sheet{i + 1}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i in names) + "</sheets></workbook>")
            put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PKG}/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in names) + f'<Relationship Id="rIdS" Type="{_REL}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
            put("xl/sharedStrings.xml", f'<sst xmlns="{_SML}">' + "".join(body[-1]) + "</sst>")
            for i in names:
                put(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{_SML}"><sheetData>' + "".join(body[i]) + "</sheetData></worksheet>")
        return made(out.getvalue(), None)

    # In order of sheets, rows and cells; of a package whose pieces alone are beyond the quota one is left, without its text.
    ordered = Window.partitionBy("path").orderBy("a", "b", "c", "xml")
    sized = rows.unionByName(items).select("*", F.sum(F.length("xml")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size"), F.row_number().over(ordered).alias("at"))
    fits = F.col("size") <= limits["part"]
    pieces = sized.filter(fits | (F.col("at") == 1)).select("path", "a", "b", F.when(fits, F.col("xml")).alias("xml"))
    return pieces.groupBy("path").applyInArrow(build, "path string, content binary, _error string")


def _member(name: str, body: bytes) -> tuple[bytes, bytes]:
    """The local part and the directory record of a new member."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    at = archive.start_dir
    return out.getvalue()[:at], out.getvalue()[at:-22]


def _key(part: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in part)


def rewritten(content: bytes, edits: dict[str, tuple[str, bytes | None]]) -> bytes:
    """An archive after edits (by key: part name and bytes, or None to delete).

    All other members are copied byte for byte in their order, with what stands between and before them; the directory
    keeps their records but for the offsets. New members follow at the end.
    """
    archive = zipfile.ZipFile(io.BytesIO(content))
    end = directory(archive, content)
    infos = archive.infolist()
    records, at = {}, end["cd_start"]
    for i in infos:
        size = 46 + sum(struct.unpack_from("<HHH", content, at + 28))
        records[i] = content[at : at + size]
        at += size
    out, fresh, left, last = io.BytesIO(), {}, dict(edits), 0
    for i in sorted(infos, key=lambda i: i.header_offset):
        key, stop = _key("/" + i.orig_filename.lstrip("/")), extent(content, i)[2]
        out.write(content[last : i.header_offset])
        fresh[i] = (out.tell(), records[i])
        if key not in left:
            out.write(content[i.header_offset : stop])
        else:
            body = left.pop(key)[1]
            fresh[i] = None
            if body is not None:
                local, record = _member(i.orig_filename, body)
                fresh[i] = (out.tell(), record)
                out.write(local)
        last = stop
    listed = [fresh[i] for i in infos if fresh[i]]
    for part, body in left.values():
        if body is not None:
            local, record = _member(part.lstrip("/"), body)
            listed.append((out.tell(), record))
            out.write(local)
    start = out.tell()
    for offset, record in listed:
        out.write(record[:42] + struct.pack("<I", offset - end["prefix"]) + record[46:])
    size = out.tell() - start
    comment = content[end["cd_end"] - len(archive.comment) : end["cd_end"]] if archive.comment else b""
    out.write(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, len(listed), len(listed), size, start - end["prefix"], len(comment)) + comment)
    return out.getvalue()


def save_packages(found: DataFrame, edits: DataFrame) -> DataFrame:
    """path, content, _error: packages (path, content) after edits of parts (path, part, bytes; null bytes delete a part).

    Parts without an edit keep their compressed bytes, so a package without any comes back as it was. A package that can't be
    read keeps its content, with an _error. A package's edits travel as one row, within the quota of a package.
    """
    gathered = edits.groupBy("path").agg(F.collect_list(F.struct("part", "bytes")).alias("edits")).hint("merge")  # whole parts, which Parquet makes small

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content, wanted in zip(frame["path"], frame["content"], frame["edits"], strict=True):
                try:
                    made = content if wanted is None else rewritten(bytes(content), {_key(e["part"]): (e["part"], None if e["bytes"] is None else bytes(e["bytes"])) for e in wanted})
                    out.append((path, made, None))
                except (zipfile.BadZipFile, struct.error, TypeError, NotImplementedError) as e:
                    out.append((path, content, type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "content", "_error"], dtype=object)

    return found.select("path", "content").join(gathered, "path", "left").mapInPandas(save, "path string, content binary, _error string")
