"""Parts with their types and relationships, written into packages."""

import io
import re
import zipfile

from cellarium.plans.part_saving import LINK, UNLINK, save_parts
from cellarium.plans import workbook
from cellarium.sources import packages

PKG = "http://schemas.openxmlformats.org/package/2006"
EDIT = "path string, part string, bytes binary, ct string"
TYPES = f'<?xml version="1.0"?><!-- t --><q:Types xmlns:q="{PKG}/content-types"><q:Default Extension="XML" ContentType="application/xml"/> <q:Override ContentType="old" PartName="/A/Two.xml"/></q:Types>'
ROOT = f'<Relationships xmlns="{PKG}/relationships"><Relationship Id="rId1" Type="t/one" Target="a/one.xml"/><!-- x --><Relationship Id="rId1" Type="t/again" Target="/A/TWO.xml"/><Relationship Id="far" TargetMode="External" Type="t/far" Target="a/two.xml"/></Relationships>'
ONE = f'<Relationships xmlns="{PKG}/relationships"><Relationship Id="z" Type="t/next" Target="two.xml"/></Relationships>'


def package(**more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in ({"[Content_Types].xml": TYPES, "_rels/.rels": ROOT, "a/one.xml": "<one/>", "a/two.xml": "<two/>", "a/_rels/one.xml.rels": ONE, "a/_rels/two.xml.rels": ONE, "blob.bin": "x" * 99} | more).items():
            if body is not None:
                z.writestr(name, body)
    return bytearray(out.getvalue())


def members(content):
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        return {n: z.read(n).decode() for n in z.namelist()}


def run(spark, found, edits=(), links=(), unlinks=()):
    saved, refused = save_parts(spark.createDataFrame(found, "path string, content binary"), spark.createDataFrame(list(edits), EDIT), spark.createDataFrame(list(links), LINK), spark.createDataFrame(list(unlinks), UNLINK))
    return {r.path: bytes(r.content) for r in saved.collect()}, sorted(((r.path, r.what, r.part, r.detail, r._error) for r in refused.collect()), key=str)


def test_add_delete_link(spark):
    found = [("add", package()), ("delete", package()), ("none", package())]
    edits = [("add", "/new/part.xml", bytearray(b"<n/>"), "x/new"), ("add", "/a/plain.xml", bytearray(b"<p/>"), "application/xml"), ("add", "/A/two.XML", bytearray(b"<2/>"), "newer"), ("add", "/b.bin", bytearray(b"b"), None), ("delete", "/a/TWO.xml", None, None)]
    links = [("add", "/", "t/new", "new/part.xml", "Internal"), ("add", "/new/part.xml", "t/web", "http://x/?a=1&b=2", "External"), ("add", "/A/ONE.xml", "t/b", "../b.bin", None)]
    saved, refused = run(spark, found, edits, links, [("delete", "/", "rId1")])
    assert refused == [] and saved["none"] == bytes(found[2][1])
    got = members(saved["add"])
    assert got["new/part.xml"] == "<n/>" and got["a/plain.xml"] == "<p/>" and got["a/two.xml"] == "<2/>" and got["b.bin"] == "b" and got["a/one.xml"] == "<one/>"
    assert got["[Content_Types].xml"] == TYPES.replace('<q:Override ContentType="old" PartName="/A/Two.xml"/>', "").replace("</q:Types>", '<q:Override PartName="/A/two.XML" ContentType="newer"/><q:Override PartName="/new/part.xml" ContentType="x/new"/></q:Types>')
    assert got["_rels/.rels"] == ROOT.replace("</Relationships>", '<Relationship Id="rId4" Type="t/new" Target="new/part.xml"/></Relationships>')
    assert '<Relationship Id="rId1" Type="t/web" Target="http://x/?a=1&amp;b=2" TargetMode="External"/>' in got["new/_rels/part.xml.rels"]
    assert got["a/_rels/one.xml.rels"] == ONE.replace("</Relationships>", '<Relationship Id="rId2" Type="t/b" Target="../b.bin"/></Relationships>') and got["a/_rels/two.xml.rels"] == ONE
    got = members(saved["delete"])
    assert "a/two.xml" not in got and "a/_rels/two.xml.rels" not in got and "Override" not in got["[Content_Types].xml"]
    assert re.findall('Id="([^"]*)"', got["_rels/.rels"]) == ["far"] and "<!-- x -->" in got["_rels/.rels"] and "Relationship " not in got["a/_rels/one.xml.rels"]


def test_refusals(spark):
    found = [("p", package()), ("bad", bytearray(b"no archive")), ("typeless", package(**{"[Content_Types].xml": None})), ("broken", package(**{"_rels/.rels": "<a>"}))]
    b = bytearray(b"1")
    edits = [("p", "rel.xml", b, None), ("p", "/a//b", b, None), ("p", None, b, None), ("p", "/x", b, None), ("p", "/X", b, None), ("p", "/gone", None, None), ("p", "/_rels/.rels", b, None), ("p", "/[content_types].xml", b, None), ("bad", "/y", b, None), ("typeless", "/y.bin", b, "kind"), ("broken", "/y", b, None), ("nowhere", "/y", b, None)]
    links = [("p", "/gone", "t", "u", "Internal"), ("p", "/", "t", "u", "Sideways"), ("broken", "/", "t", "u", "Internal")]
    saved, refused = run(spark, found, edits, links, [("p", "/", "rId7"), ("p", "/a/two.xml", "z")])
    want = [("/X", "DuplicateEdit"), ("/[content_types].xml", "ReservedPart"), ("/_rels/.rels", "ReservedPart"), ("/a//b", "BadPartName"), ("/gone", "PartNotFound"), ("/x", "DuplicateEdit"), ("rel.xml", "BadPartName"), (None, "BadPartName")]
    assert sorted(((r[2], r[4]) for r in refused if r[0] == "p" and r[1] == "part"), key=str) == sorted(want, key=str)
    assert {r[1:] for r in refused if r[0] == "p" and r[1] != "part"} == {("link", "/gone", "u", "OwnerNotFound"), ("link", "/", "u", "BadMode"), ("unlink", "/", "rId7", "RelationshipNotFound")}
    assert {(r[0], r[1], r[4]) for r in refused if r[0] != "p"} == {("bad", "part", "BadZipFile"), ("broken", "part", "Malformed"), ("broken", "link", "Malformed"), ("nowhere", "part", "PackageNotFound")}
    assert saved["bad"] == b"no archive" and saved["broken"] == bytes(found[3][1]) and "nowhere" not in saved
    assert "Relationship " not in members(saved["p"])["a/_rels/two.xml.rels"] and members(saved["p"])["_rels/.rels"] == ROOT
    assert '<Override PartName="/y.bin" ContentType="kind"/>' in members(saved["typeless"])["[Content_Types].xml"]


def test_read_back(spark):
    links = [("p", "/a/two.xml", "t", f"n{i}", "Internal") for i in range(12)]
    saved, _ = run(spark, [("p", package())], (), links)
    nodes = packages.xml_nodes(packages.parts(spark.createDataFrame([("p", bytearray(saved["p"]))], "path string, content binary"), ".*two.xml.rels"))
    ids = [r.id for r in workbook.relationships(nodes).collect()]
    assert len(ids) == len(set(ids)) == 13
