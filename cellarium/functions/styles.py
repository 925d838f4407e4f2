"""Number formats, colours and sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of built-in number formats that show dates.
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)
# The indexed palette, whose first eight colours come twice, and the default theme.
INDEXED = (
    "000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF "
    "800000 008000 000080 808000 800080 008080 C0C0C0 808080 9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF "
    "000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF 00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99 "
    "3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696"
).split()
THEME = "FFFFFF 000000 E7E6E6 44546A 4472C4 ED7D31 A5A5A5 FFC000 5B9BD5 70AD47 0563C1 954F72".split()
# How a line class looks.
BORDER_CSS = {"hair": "1px dotted", "thin": "1px solid", "medium": "2px solid", "thick": "3px solid", "double": "3px double", "dashed": "1px dashed", "dotted": "1px dotted"}
# Line styles by class.
BORDER_CLASSES = {"hair": ["hair"], "thin": ["thin"], "medium": ["medium"], "thick": ["thick"], "double": ["double"], "dashed": ["dashed", "mediumDashed", "slantDashDot"], "dotted": ["dotted", "dashDot", "dashDotDot", "mediumDashDot", "mediumDashDotDot"]}


def is_date_format(code: Column) -> Column:
    """Whether a format code shows a date or time: y, m, d, h or s outside quotes, escapes and brackets, or elapsed time."""
    bare = F.regexp_replace(code, r'"[^"]*("|$)|\\.|_.', "")
    elapsed = bare.rlike(r"(?i)\[(h+|m+|s+)\]")
    return elapsed | F.regexp_replace(bare, r"\[[^\]]*(\]|$)", "").rlike("(?i)[ymdhs]") & ~F.lower(bare).isin("general")


def is_date_id(num_fmt_id: Column) -> Column:
    return num_fmt_id.isin(*DATE_FORMATS)


def apply_tint(rgb: Column, tint: Column) -> Column:
    """0xRRGGBB made darker (tint below 0) or lighter, each channel cut to a whole number."""
    channel = lambda shift: F.shiftright(rgb.cast("int"), shift).bitwiseAND(255)
    t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tint))
    tinted = lambda c: F.floor(F.when(t < 0, c * (1 + t)).otherwise(c + (255 - c) * t)).cast("int")
    return (F.shiftleft(tinted(channel(16)), 16) + F.shiftleft(tinted(channel(8)), 8) + tinted(channel(0))).cast("int")


def css_color(rgb: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(rgb), 6, "0")))


def color_css(color: Column) -> Column:
    """#rrggbb of a struct<rgb, indexed, theme, tint> as attributes have them; null where the surroundings decide."""
    picked = lambda names, i: F.get(F.array(*[F.lit(int(x, 16)) for x in names]), i)
    rgb = F.conv(F.right(color["rgb"], F.lit(6)), 16, 10).cast("int")
    theme = apply_tint(picked(THEME, color["theme"].try_cast("int")), F.coalesce(color["tint"].try_cast("double"), F.lit(0.0)))
    return css_color(F.coalesce(rgb, picked(INDEXED, color["indexed"].try_cast("int")), theme))


def border_css(style: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, css in BORDER_CSS.items():
        out = F.when(border_class(style) == name, css).otherwise(out)
    return out


def border_class(style: Column) -> Column:
    """One of eight classes; an unknown or missing style is none."""
    out = F.lit("none")
    for name, styles in BORDER_CLASSES.items():
        out = F.when(style.isin(*styles), name).otherwise(out)
    return out


def max_digit_width(points: Column) -> Column:
    """Width of a digit in pixels by font size; 7 if the size is no size."""
    return F.when(points > 0, F.greatest(F.lit(2.0), F.round(points * 0.62))).otherwise(F.lit(7.0))


def col_width_px(chars: Column, digit: Column) -> Column:
    return F.when((chars > 0) & (digit > 0), F.round(chars * digit + 5)).otherwise(F.lit(0.0))


def row_height_px(points: Column) -> Column:
    return F.when(points > 0, F.round(points * 4 / 3)).otherwise(F.lit(0.0))


def font_size_text(points: Column) -> Column:
    """At most two decimals, no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", points), "0+$", ""), r"\.$", "")


def size_text(n: Column) -> Column:
    """A number of bytes for reading, in units of 1024 with one decimal beyond the first."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / 1024.0**power), F.lit(f" {unit}"))).otherwise(out)
    return out
