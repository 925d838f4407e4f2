"""Escaping for XML and HTML, escapes inside cell text, part names and content types, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FORBIDDEN = "[^\\x09\\x0A\\x0D\\x20-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]"


def _replaced(s: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def is_xml_text(s: Column) -> Column:
    """Whether XML 1.0 allows every character."""
    return ~s.rlike(_FORBIDDEN)


def escape_text(s: Column) -> Column:
    """For element content; null where XML has no way to hold it."""
    return F.when(is_xml_text(s), _replaced(s, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#xD;")))


def escape_attr(s: Column, quote: str = '"') -> Column:
    """For an attribute between these quotes."""
    return _replaced(escape_text(s), ("\n", "&#xA;"), ("\t", "&#x9;"), (quote, "&quot;" if quote == '"' else "&apos;"))


_REFERENCE = r"&(?:#x[0-9A-Fa-f]{1,8}|#[0-9]{1,10}|[A-Za-z]+);"
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def _referred(piece: Column) -> Column:
    """The character of one reference; null if XML knows none such."""
    body = F.substring(piece, F.lit(2), F.length(piece) - 2)
    code = F.when(body.startswith("#x"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)).when(body.startswith("#"), F.substring(body, F.lit(2), F.length(body))).try_cast("long")
    allowed = code.isin(9, 10, 13) | code.between(0x20, 0xD7FF) | code.between(0xE000, 0xFFFD) | code.between(0x10000, 0x10FFFF)
    utf8 = F.when(code < 0x80, F.hex(code)).when(code < 0x800, F.hex((F.shiftright(code, 6) + 0xC0) * 256 + code % 64 + 0x80)).when(code < 0x10000, F.hex(((F.shiftright(code, 12) + 0xE0) * 256 + F.shiftright(code, 6) % 64 + 0x80) * 256 + code % 64 + 0x80)).otherwise(F.hex((((F.shiftright(code, 18) + 0xF0) * 256 + F.shiftright(code, 12) % 64 + 0x80) * 256 + F.shiftright(code, 6) % 64 + 0x80) * 256 + code % 64 + 0x80))
    named = F.lit(None).cast("string")
    for name, char in _NAMED.items():
        named = F.when(body == name, char).otherwise(named)
    return F.when(body.startswith("#"), F.when(allowed, F.decode(F.unhex(utf8), "utf-8"))).otherwise(named)


def _decoded(raw: Column, plain: Column) -> Column:
    """Text whose references are read; plain is raw after what is done to all other characters."""
    pieces = F.regexp_extract_all(plain, F.lit(rf"(?s){_REFERENCE}|[^&]+|&"), F.lit(0))
    read = F.transform(pieces, lambda p: F.when(p.startswith("&"), _referred(p)).otherwise(p))
    whole = F.when(~F.exists(read, lambda p: p.isNull()), F.array_join(read, ""))
    return F.when(raw.contains("&"), whole).otherwise(plain)


def unescape(s: Column) -> Column:
    """Element content as XML reads it: named and numeric references, line ends as one \\n; null where a reference is none."""
    return _decoded(s, F.when(s.contains("\r"), F.regexp_replace(s, "\r\n?", "\n")).otherwise(s))


def unescape_attr(s: Column) -> Column:
    """An attribute's value as XML reads it: as unescape(), but a tab or line end that is no reference is a space."""
    return _decoded(s, F.when(s.rlike("[\t\n\r]"), F.regexp_replace(s, "\r\n?|[\t\n]", " ")).otherwise(s))


def escape_html(s: Column) -> Column:
    return _replaced(s, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


_CONTROLS = [*range(0x09), 0x0B, 0x0C, *range(0x0D, 0x20)]


def encode_x_escapes(s: Column) -> Column:
    """Control characters as _xHHHH_, and an underscore that would read as such an escape as _x005F_."""
    coded = F.regexp_replace(s, "_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
    for code in _CONTROLS:
        coded = F.replace(coded, F.lit(chr(code)), F.lit(f"_x{code:04X}_"))
    return F.when(s.rlike(r"[\x00-\x08\x0B-\x1F]|_x[0-9A-Fa-f]{4}_"), coded).otherwise(s)


def decode_x_escapes(s: Column) -> Column:
    """The inverse: escapes of control characters, and _x005F_ before another escape; all else stays."""
    coded = "_x(?:00[01][0-9A-Fa-f]|005[Ff])_"
    pieces = F.regexp_extract_all(s, F.lit(rf"(?s)_x00[01][0-9A-Fa-f]_|_x005[Ff]_(?=x[0-9A-Fa-f]{{4}}_)|[^_]+|_"), F.lit(0))
    kept = ("09", "0a")

    def read(p: Column) -> Column:
        code = F.lower(F.substring(p, 5, 2))
        return F.when(F.length(p) < 7, p).when(~p.rlike("^_x00"), p).when(code == "5f", "_").when(code.isin(*kept), p).otherwise(F.decode(F.unhex(code), "utf-8"))

    return F.when(s.rlike(coded), F.array_join(F.transform(pieces, read), "")).otherwise(s)


def part_key(name: Column) -> Column:
    """The name under which parts are compared: only A-Z fold."""
    return F.translate(name, _ASCII_UPPER, _ASCII_LOWER)


def is_part_name(name: Column) -> Column:
    """Starts with `/`; no empty, `.` or `..` segment, none that ends in a dot, no backslash, no control character."""
    return name.rlike(r"^(/(?![^/]*\.(/|$))[^/\\\x00-\x1F\x7F]+)+$")


def part_dir(name: Column) -> Column:
    return F.regexp_extract(name, "^(.*/)", 1)


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def part_extension(name: Column) -> Column:
    """What follows the last dot of the last segment; null if nothing does."""
    return F.nullif(F.regexp_extract(last_segment(name), r"\.([^.]*)$", 1), F.lit(""))


def is_rels_part(name: Column) -> Column:
    return part_key(name).rlike(r"^(.*/)?_rels/[^/]*\.rels$")


def rels_part(owner: Column) -> Column:
    """The part that holds an owner's relationships; `/` is the package."""
    return F.concat(part_dir(owner), F.lit("_rels/"), last_segment(owner), F.lit(".rels"))


def rels_owner(name: Column) -> Column:
    """The owner of a relationships part; null for other parts."""
    return F.when(is_rels_part(name), F.regexp_replace(name, r"(?i)_rels/([^/]*)\.rels$", "$1"))


def resolve_target(owner: Column, target: Column) -> Column:
    """The absolute part that a relationship's target names; null where `..` leads out of the package."""
    bare = F.regexp_replace(target, "[#?].*$", "")
    decoded = F.try_url_decode(F.replace(F.regexp_replace(bare, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))
    path = F.when(decoded.startswith("/"), decoded).otherwise(F.concat(part_dir(owner), decoded))
    none = F.lit(None).cast("array<string>")
    step = lambda a, s: F.when(a.isNull(), none).when(s == "..", F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(none)).when(s.isin("", "."), a).otherwise(F.concat(a, F.array(s)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/")))


def is_xml_content_type(content_type: Column) -> Column:
    bare = F.trim(F.regexp_extract(content_type, "^([^;]*)", 1))
    return part_key(bare).isin("application/xml", "text/xml") | bare.endswith("+xml")
