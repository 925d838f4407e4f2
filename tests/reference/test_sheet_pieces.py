"""Sheets cut into pieces give the cells of sheets read whole."""

import io
import random
import zipfile

import pytest

from cellarium.sources import packages, sheet_pieces, sheets

SML = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def random_rows(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        number = r.choice(["", "", "", f' r="{r.randint(1, 90)}"', ' r="0"', ' r="x"', " ht='3>2'"])
        cells = "".join(r.choice(["<c><v>1</v></c>", f'<c r="C{r.randint(1, 99)}"/>', '<c r="?"/>', '<c t="inlineStr"><is><t>&lt;row></t></is></c>', "<c><f>A1</f></c>"]) for _ in range(r.randint(0, 3)))
        rows.append(r.choice(["<row{0}>{1}</row>", "<row{0} >{1}</row>\n", "<!-- <row> --><row{0}>{1}</row>", "<row{0}><![CDATA[<row>]]>{1}</row>", "<?go <row ?><row{0}>{1}</row>", "<row{0}/>"]).format(number, cells))
    return "".join(rows)


def bodies() -> dict[str, bytes]:
    plain = {f"/{i}": f'<worksheet xmlns="{SML}"><sheetData>{random_rows(i)}</sheetData></worksheet>' for i in range(8)}
    many = "<row><c/></row>" * 40
    plain |= {
        "/prefix": f'<?xml version="1.0"?><!-- <x:sheetData> --><x:worksheet xmlns:x="{SML}" xmlns:y="u"><x:cols><x:col/></x:cols><x:sheetData a=">">' + random_rows(9).replace("<", "<x:").replace("<x:!", "<!").replace("<x:?", "<?").replace("<x:/", "</x:") + "<x:row><x:c/><y:row/></x:row></x:sheetData><x:z/></x:worksheet>",
        "/none": f'<worksheet xmlns="{SML}"><sheetData/></worksheet>',
        "/last": f'<worksheet><sheetData><row r="1048570"><c/></row>{many}<row r="5"/>{many}</sheetData></worksheet>',
        "/tail": f"<worksheet><sheetData>{many}</sheetData><ext><row><c/></row><row/></ext></worksheet>",
        "/nested": f"<worksheet><sheetData>{many}<row><c/><ext><row><c/></row></ext></row>{many}</sheetData></worksheet>",
        "/cut": f"<worksheet><sheetData>{many}<row><c>",
        "/bad": f"<worksheet><sheetData>{many}<row><c></row>{many}</sheetData></worksheet>",
        "/doctype": f"<!DOCTYPE worksheet><worksheet><sheetData>{many}</sheetData></worksheet>",
        "/text": "no XML",
        "/empty": "",
    }
    found = {k: v.encode() for k, v in plain.items()}
    found["/wide"] = f'<?xml version="1.0" encoding="UTF-16"?><worksheet><sheetData>{many}</sheetData></worksheet>'.encode("utf-16")
    found["/latin"] = f'<?xml version="1.0" encoding="ISO-8859-1"?><worksheet><sheetData>{many}<row><c><v>é</v></c></row>{many}<row><c><v>ü</v></c></row></sheetData></worksheet>'.encode("latin-1")
    return found


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [1, 37, 300, 1 << 20])
def test_pieces_equal_the_whole(spark, size):
    parts = spark.createDataFrame([("p", k, bytearray(v), None) for k, v in bodies().items()] + [("p", "/e", None, "LimitPart"), ("q", None, None, "BadZipFile")], "path string, part string, bytes binary, _error string")
    pieces = sheet_pieces.part_pieces(parts, size)
    most = max(r["count"] for r in pieces.groupBy("part").count().collect())
    assert most == 1 if size > 1 << 19 else most > 5
    assert rows(sheet_pieces.piece_cells(pieces)) == rows(sheets.sheet_cells(parts))


def test_quota_of_elements(spark):
    parts = spark.createDataFrame([("p", "/s", bytearray(b"<worksheet><sheetData>" + b"<row><c/></row>" * 50 + b"</sheetData></worksheet>"))], "path string, part string, bytes binary")
    for nodes in (60, 102, 103):
        limits = {"nodes": nodes}
        assert rows(sheet_pieces.piece_cells(sheet_pieces.part_pieces(parts, 30), limits)) == rows(sheets.sheet_cells(parts, limits))


def test_cuts_are_the_text():
    for text in bodies().values():
        for size, step in ((1, 1), (50, 7), (200, 64)):
            assert b"".join(p for _, p, _ in sheet_pieces.cut_rows((text[i : i + step] for i in range(0, len(text), step)), size)) == text


def test_packages(spark):
    def archive(damage=False):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for i in range(3):
                z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{SML}"><sheetData>{random_rows(i)}</sheetData></worksheet>')
            z.writestr("xl/other.xml", "<a/>")
        content = out.getvalue()
        return content.replace(b"<v>1</v>", b"<v>2</v>", 1) if damage else content

    found = spark.createDataFrame([("good", bytearray(archive())), ("damaged", bytearray(archive(True))), ("none", bytearray(b"x")), ("null", None)], "path string, content binary")
    for limits in ({}, {"part": 3000}):
        whole = sheets.sheet_cells(packages.parts(found, "/xl/worksheets/[^/]*", limits), limits)
        assert rows(sheet_pieces.piece_cells(sheet_pieces.package_pieces(found, limits=limits, size=100), limits)) == rows(whole)
