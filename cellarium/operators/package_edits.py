"""Edits of packages as joins: parts, content types, relationships, and what a change of values asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.functions.markup import part_extension, part_key, rels_part


def content_type_tables(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Defaults (path, ext, ct) and overrides (path, part, ct) of the nodes of [Content_Types].xml."""
    a = lambda name: F.try_element_at(F.col("attrs"), F.lit(name))
    defaults = nodes.filter("local = 'Default'").select("path", a("Extension").alias("ext"), a("ContentType").alias("ct"))
    return defaults, nodes.filter("local = 'Override'").select("path", a("PartName").alias("part"), a("ContentType").alias("ct"))


def main_parts(paths: DataFrame, rels: DataFrame, part_names: DataFrame, type_end: str, owner: str | None, fallback: str) -> DataFrame:
    """path, part: the first relationship of a type (of this owner, or of any in rels) whose target exists, else the usual
    name if it exists, else null."""
    there = part_names.select("path", part_key(F.col("part")).alias("_key"), F.col("part").alias("_part"))
    wanted = rels.filter((F.lit(owner is None) | (F.col("owner") == owner)) & F.col("type").endswith(type_end)).select("path", "ord", part_key(F.col("resolved")).alias("_key"))
    by_rel = wanted.join(there, ["path", "_key"]).groupBy("path").agg(F.min_by("_part", "ord").alias("_by_rel"))
    usual = there.filter(F.col("_key") == fallback.lower()).groupBy("path").agg(F.first("_part").alias("_usual"))
    return paths.select("path").distinct().join(by_rel, "path", "left").join(usual, "path", "left").select("path", F.coalesce("_by_rel", "_usual").alias("part"))


def next_rel_number(rels: DataFrame) -> DataFrame:
    """path, owner, n: the smallest number from the count of relationships + 1 on for which rId<n> is free."""
    sizes = rels.groupBy("path", "owner").agg(F.count("*").alias("size"))
    tried = sizes.withColumn("n", F.explode(F.sequence(F.col("size") + 1, F.col("size") * 2 + 1)))  # one of these is free
    taken = rels.select("path", "owner", F.regexp_extract("id", "^rId([0-9]{1,9})$", 1).try_cast("long").alias("n"))
    return tried.join(taken, ["path", "owner", "n"], "left_anti").groupBy("path", "owner").agg(F.min("n").alias("n"))


def add_relationships(rels: DataFrame, fresh: DataFrame) -> DataFrame:
    """rels (path, owner, ord, id, type, target, mode) and fresh ones (path, owner, type, target, mode), with ids of their own.

    Numbers count on from the largest in use, so several new ones of an owner never clash.
    """
    used = rels.groupBy("path", "owner").agg(F.max(F.regexp_extract("id", "^rId([0-9]{1,9})$", 1).try_cast("long")).alias("top"), F.count("*").alias("size"), F.max("ord").alias("last"))
    at = F.row_number().over(Window.partitionBy("path", "owner").orderBy("type", "target"))
    joined = fresh.join(used, ["path", "owner"], "left").withColumn("k", at)
    number = F.greatest(F.coalesce("top", F.lit(0)), F.coalesce("size", F.lit(0))) + F.col("k")
    added = joined.select("path", "owner", (F.coalesce("last", F.lit(-1)) + F.col("k")).cast("int").alias("ord"), F.concat(F.lit("rId"), number.cast("string")).alias("id"), "type", "target", "mode")
    return rels.select("path", "owner", "ord", "id", "type", "target", "mode").unionByName(added)


def edit_parts(parts: DataFrame, edits: DataFrame) -> DataFrame:
    """path, part, bytes, kind after edits (path, part, bytes; null bytes delete).

    kind is verbatim where the bytes did not really change, replace where they did, new for parts that were not there.
    """
    old = parts.select("path", "part", "bytes", part_key(F.col("part")).alias("_key"))
    new = edits.select("path", F.col("part").alias("_part"), F.col("bytes").alias("_bytes"), part_key(F.col("part")).alias("_key"), F.lit(True).alias("_edit"))
    both = old.join(new, ["path", "_key"], "full")
    kind = F.when(F.col("part").isNull(), "new").when(F.col("_edit").isNull() | F.col("bytes").eqNullSafe(F.col("_bytes")), "verbatim").otherwise("replace")
    kept = both.filter("_edit IS NULL OR _bytes IS NOT NULL")
    return kept.select("path", F.coalesce("part", "_part").alias("part"), F.when(F.col("_edit"), F.col("_bytes")).otherwise(F.col("bytes")).alias("bytes"), kind.alias("kind"))


def remove_parts(parts: DataFrame, rels: DataFrame, overrides: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the parts in gone (path, part), their overrides, their relationships and those to them."""
    keys = gone.select("path", part_key(F.col("part")).alias("_key")).distinct()
    own = gone.select("path", part_key(rels_part(F.col("part"))).alias("_key")).distinct()
    without = lambda df, column: df.withColumn("_key", part_key(F.col(column))).join(keys, ["path", "_key"], "left_anti").drop("_key")
    left = without(parts, "part").withColumn("_key", part_key(F.col("part"))).join(own, ["path", "_key"], "left_anti").drop("_key")
    inner = rels.withColumn("_key", F.when(F.col("mode") == "Internal", part_key(F.col("resolved")))).join(keys, ["path", "_key"], "left_anti").drop("_key")
    return left, without(inner, "owner"), without(overrides, "part")


def ensure_overrides(defaults: DataFrame, overrides: DataFrame, wanted: DataFrame) -> DataFrame:
    """overrides and those of wanted (path, part, ct) whose type does not follow from the tables yet."""
    key, ext = part_key(F.col("part")), part_key(part_extension(F.col("part")))
    o = overrides.groupBy("path", key.alias("_key")).agg(F.first("ct").alias("_o"))
    d = defaults.groupBy("path", part_key(F.col("ext")).alias("_ext")).agg(F.first("ct").alias("_d"))
    found = wanted.withColumn("_key", key).withColumn("_ext", ext).join(o, ["path", "_key"], "left").join(d, ["path", "_ext"], "left")
    missing = found.filter(~F.coalesce("_o", "_d").eqNullSafe(F.col("ct")))
    kept = overrides.withColumn("_key", key).join(missing.select("path", "_key"), ["path", "_key"], "left_anti")
    return kept.select("path", "part", "ct").unionByName(missing.select("path", "part", "ct"))


def remove_relationships(rels: DataFrame, gone: DataFrame) -> DataFrame:
    """rels without the first relationship of each owner and id in gone (path, owner, id)."""
    first = rels.join(gone.select("path", "owner", "id").distinct(), ["path", "owner", "id"]).groupBy("path", "owner", "id").agg(F.min("ord").alias("ord"))
    return rels.join(first, ["path", "owner", "id", "ord"], "left_anti").select(rels.columns)


# Elements of a workbook that come after the one of calculation.
_AFTER_CALC = ("oleSize", "customWorkbookViews", "pivotCaches", "smartTagPr", "smartTagTypes", "webPublishing", "fileRecoveryPr", "webPublishObjects", "extLst")


def mark_full_recalc(text: Column) -> Column:
    """The text of a workbook part that asks for all formulas to be worked out anew when it is opened.

    An element of calculation keeps its other attributes; without one it is made where its place is, with the prefix of the
    part's own elements.
    """
    prefix = F.regexp_extract(text, r"<((?:[^\s<>/:!?]+:)?)workbook[\s>]", 1)
    old = F.regexp_extract(text, r"<(?:[^\s<>/:!?]+:)?calcPr(?=[\s/>])[^>]*>", 0)
    bare = F.regexp_replace(old, r"""\s+(calcId|fullCalcOnLoad)\s*=\s*("[^"]*"|'[^']*')""", "")
    marked = F.regexp_replace(bare, r"\s*(/?)>$", ' calcId="0" fullCalcOnLoad="1"$1>')
    fresh = F.concat(F.lit("<"), prefix, F.lit('calcPr calcId="0" fullCalcOnLoad="1"/>'))
    before = r"(?s)<(?:[^\s<>/:!?]+:)?(?:" + "|".join(_AFTER_CALC) + r")[\s/>].*$|</(?:[^\s<>/:!?]+:)?workbook\s*>\s*$"
    rest = F.regexp_extract(text, before, 0)
    made = F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(rest)), fresh, rest)
    return F.when(old != "", F.replace(text, old, marked)).when(rest != "", made).otherwise(text)


def calc_chains(paths: DataFrame, rels: DataFrame, part_names: DataFrame) -> DataFrame:
    """path, part of the chain of calculation that a relationship or its usual name leads to, where there is one."""
    return main_parts(paths, rels, part_names, "/calcChain", None, "/xl/calcChain.xml").filter("part IS NOT NULL")
