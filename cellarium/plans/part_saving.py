"""Parts, content types and relationships written into packages: what an edit asks of other parts follows, and all other bytes stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.functions import markup
from cellarium.operators.package_edits import add_relationships, ensure_overrides
from cellarium.plans.saving import _NO_RELS, _PART, _TYPES, _roots
from cellarium.sources.packages import entries, parts
from cellarium.sources.tables import stored
from cellarium.sources.writer import save_packages
from cellarium.sources.xml_events import append_children, attributes, new_element, remove_nodes, serialize, xml_events

_NO_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'
_SMALL = r"(?i)/\[Content_Types\]\.xml|(/.*)?/_rels/[^/]*\.rels"
LINK = "path string, owner string, type string, target string, mode string"
UNLINK = "path string, owner string, id string"
_REFUSED = ["path", "what", "part", "detail", "_error"]


def _said(events: DataFrame) -> DataFrame:
    """path, part, node_id, said: the attributes of elements by name."""
    pair = F.struct("qname", "value")
    return attributes(events).groupBy(*_PART, "node_id").agg(F.map_from_entries(F.collect_list(pair)).alias("said"))


def save_parts(found: DataFrame, edits: DataFrame, links: DataFrame | None = None, unlinks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Packages (path, content) after edits of parts and relationships, and what was refused.

    edits: path, part, bytes, ct. Null bytes delete a part, with its type, its own relationships and those that lead to it; others
    replace it or add it, and where the types of the package do not say ct of it already, it gets a type of its own. A null
    ct leaves types alone. links: path, owner, type, target, mode (Internal or External); each gets an id that is free, in a part
    that is made where there is none; the owner `/` is the package. unlinks: path, owner, id; the first of that id goes.

    The first result is path, content, _error of all packages; those without an edit come back byte for byte, and in the parts of types
    and relationships all but the elements that come or go stays. The second is path, what (part, link, unlink), part (or
    owner), detail (target or id) and _error: BadPartName, ReservedPart (types and relationships, which follow from edits),
    DuplicateEdit (more than one of a part; none is done), PartNotFound, OwnerNotFound, BadMode, RelationshipNotFound, PackageNotFound, or
    what is wrong with the package or a part of it that would have to change, in which case nothing in that package does.
    """
    spark, key = found.sparkSession, markup.part_key
    links = spark.createDataFrame([], LINK) if links is None else links
    unlinks = spark.createDataFrame([], UNLINK) if unlinks is None else unlinks
    asked = edits.select(*_PART, "bytes", "ct").withColumn("_key", key(F.col("part")))
    asked_links = links.select("path", "owner", "type", "target", F.coalesce("mode", F.lit("Internal")).alias("mode")).withColumn("_key", key(F.col("owner")))
    asked_unlinks = unlinks.select("path", "owner", "id").distinct().withColumn("_key", key(F.col("owner")))
    paths = asked.select("path").unionByName(asked_links.select("path")).unionByName(asked_unlinks.select("path")).distinct()
    some = found.join(paths, "path", "left_semi")

    # What is there: names, and the events of the small parts. What can't be read stops its package.
    listed = stored(entries(some).select("path", F.concat(F.lit("/"), F.regexp_replace("name", "^/+", "")).alias("part"), key(F.concat(F.lit("/"), F.regexp_replace("name", "^/+", ""))).alias("_key"), "_error"))
    small = stored(parts(some, _SMALL))
    events = stored(xml_events(small.filter("part IS NOT NULL AND _error IS NULL")))
    faults = listed.filter("_error IS NOT NULL").select("path", "_error").unionByName(small.filter("_error IS NOT NULL").select("path", "_error")).unionByName(events.filter("_error IS NOT NULL").select("path", "_error"))
    missing = paths.join(found.select("path"), "path", "left_anti").select("path", F.lit("PackageNotFound").alias("_error"))
    stopped = stored(faults.unionByName(missing).groupBy("path").agg(F.min("_error").alias("_stop")))
    there = listed.filter("_error IS NULL").select("path", "_key").distinct().withColumn("_there", F.lit(True))

    # Edits of parts.
    times = F.count("*").over(Window.partitionBy("path", "_key"))
    reserved = (F.col("_key") == key(F.lit(_TYPES))) | markup.is_rels_part(F.col("part"))
    wrong = (
        F.when(~F.coalesce(markup.is_part_name(F.col("part")), F.lit(False)), "BadPartName")
        .when(reserved, "ReservedPart")
        .when(F.col("_times") > 1, "DuplicateEdit")
        .when(F.col("bytes").isNull() & F.col("_there").isNull(), "PartNotFound")
    )
    judged = stored(asked.withColumn("_times", times).join(stopped, "path", "left").join(there, ["path", "_key"], "left").withColumn("_error", F.coalesce("_stop", wrong)))
    good = judged.filter("_error IS NULL")
    gone = good.filter("bytes IS NULL").select("path", "_key")
    left = there.select("path", "_key").join(gone, ["path", "_key"], "left_anti").unionByName(good.filter("bytes IS NOT NULL").select("path", "_key")).unionByName(paths.select("path", F.lit("/").alias("_key"))).distinct().withColumn("_left", F.lit(True))

    # Relationships as they are, and those that go.
    rel_events = events.filter(markup.is_rels_part(F.col("part")) & F.col("_error").isNull())
    elements = rel_events.filter("kind = 'Start' AND depth = 1").select(*_PART, "node_id")
    s = lambda name: F.try_element_at("said", F.lit(name))
    rels = _said(rel_events).join(elements, [*_PART, "node_id"]).select(*_PART, "node_id", markup.rels_owner(F.col("part")).alias("owner"), s("Id").alias("id"), s("Type").alias("type"), s("Target").alias("target"), F.coalesce(s("TargetMode"), F.lit("Internal")).alias("mode"))
    place = F.row_number().over(Window.partitionBy(*_PART).orderBy("node_id"))  # relationships of one part
    rels = stored(rels.withColumn("_owner", key(F.col("owner"))).withColumn("ord", (place - 1).cast("int")).withColumn("_target", F.when(F.col("mode") == "Internal", key(markup.resolve_target(F.col("owner"), F.col("target"))))))
    first = rels.groupBy("path", F.col("_owner").alias("_key"), "id").agg(F.min(F.struct("ord", "node_id", "part")).alias("_first"))
    judged_unlinks = stored(asked_unlinks.join(stopped, "path", "left").join(first, ["path", "_key", "id"], "left").withColumn("_error", F.coalesce("_stop", F.when(F.col("_first").isNull(), "RelationshipNotFound"))))
    unlinked = judged_unlinks.filter("_error IS NULL").select("path", "_first.part", "_first.node_id")
    led = rels.join(gone.withColumnRenamed("_key", "_target"), ["path", "_target"], "left_semi").select(*_PART, "node_id")
    leaving = stored(unlinked.unionByName(led).distinct())

    # Relationships that come.
    bad_link = F.when(~F.col("mode").isin("Internal", "External"), "BadMode").when(F.col("_left").isNull(), "OwnerNotFound")
    judged_links = stored(asked_links.join(stopped, "path", "left").join(left, ["path", "_key"], "left").withColumn("_error", F.coalesce("_stop", bad_link)))
    names = listed.filter("_error IS NULL").groupBy("path", "_key").agg(F.min("part").alias("_name"))
    made = judged_links.filter("_error IS NULL").join(names, ["path", "_key"], "left").select("path", F.coalesce("_name", "owner").alias("owner"), "type", "target", "mode")
    known = rels.join(names.withColumnRenamed("_key", "_owner"), ["path", "_owner"], "left").select("path", F.coalesce("_name", "owner").alias("owner"), "ord", "id", "type", "target", "mode")
    fresh = stored(add_relationships(known, made).join(known.select("path", "owner", "id"), ["path", "owner", "id"], "left_anti"))
    rel_names = small.filter(markup.is_rels_part(F.col("part"))).select("path", key(F.col("part")).alias("_rels"), F.col("part").alias("_there"))
    holders = fresh.select("path", "owner").distinct().withColumn("_made", markup.rels_part(F.col("owner"))).withColumn("_rels", key(F.col("_made"))).join(rel_names, ["path", "_rels"], "left").select("path", "owner", F.coalesce("_there", "_made").alias("part"), F.col("_there").isNull().alias("_new"))
    holders = stored(holders)
    blank = xml_events(holders.filter("_new").select(*_PART, F.lit(_NO_RELS).cast("binary").alias("bytes")))
    touched = leaving.select(*_PART).unionByName(holders.select(*_PART)).distinct()
    own = judged.filter("_error IS NULL AND bytes IS NULL").select("path", key(markup.rels_part(F.col("part"))).alias("_rels")).join(rel_names, ["path", "_rels"]).select("path", F.col("_there").alias("part"))
    rel_events = stored(rel_events.unionByName(blank).join(touched, _PART, "left_semi").join(own, _PART, "left_anti"))
    element = new_element(F.concat("prefix", F.lit("Relationship")), [("Id", F.col("id")), ("Type", F.col("type")), ("Target", F.col("target")), ("TargetMode", F.when(F.col("mode") == "External", F.col("mode")))])
    more = _roots(rel_events).join(holders.drop("_new"), _PART).join(fresh, ["path", "owner"]).select(*_PART, "node_id", element.alias("xml"), F.col("ord").cast("long").alias("ord"))
    new_rels = serialize(append_children(stored(remove_nodes(rel_events, leaving)), stored(more)))

    # Types.
    type_events = events.filter((key(F.col("part")) == key(F.lit(_TYPES))) & F.col("_error").isNull())
    typeless = good.select("path").distinct().join(type_events.select("path").distinct(), "path", "left_anti")
    type_events = stored(type_events.unionByName(xml_events(typeless.select("path", F.lit(_TYPES).alias("part"), F.lit(_NO_TYPES).cast("binary").alias("bytes")))))
    types = stored(_said(type_events))
    defaults = types.filter(s("Extension").isNotNull()).select("path", s("Extension").alias("ext"), s("ContentType").alias("ct"))
    overrides = types.filter(s("PartName").isNotNull()).select("path", "node_id", F.col("part").alias("_types"), key(s("PartName")).alias("part"), s("ContentType").alias("ct"))
    stay = overrides.join(gone.withColumnRenamed("_key", "part"), ["path", "part"], "left_anti").select("path", "part", "ct")
    wanted = good.filter("bytes IS NOT NULL AND ct IS NOT NULL").select(*_PART, "ct")
    added = stored(ensure_overrides(defaults, stay, wanted).join(stay, ["path", "part", "ct"], "left_anti"))
    old_keys = gone.select("path", F.col("_key").alias("part")).unionByName(added.select("path", key(F.col("part")).alias("part")))
    old = stored(overrides.join(old_keys, ["path", "part"], "left_semi").select("path", F.col("_types").alias("part"), "node_id"))
    override = new_element(F.concat("prefix", F.lit("Override")), [("PartName", F.col("_part")), ("ContentType", F.col("ct"))])
    place = F.row_number().over(Window.partitionBy("path").orderBy("_part")).cast("long")  # edits of one package
    retyped = old.select("path").unionByName(added.select("path")).distinct()
    type_events = stored(type_events.join(retyped, "path", "left_semi"))
    more_types = _roots(type_events).join(added.withColumnRenamed("part", "_part"), "path").select(*_PART, "node_id", override.alias("xml"), place.alias("ord"))
    new_types = serialize(append_children(stored(remove_nodes(type_events, old)), stored(more_types)))

    every = good.select(*_PART, "bytes").unionByName(own.select(*_PART, F.lit(None).cast("binary").alias("bytes"))).unionByName(new_rels).unionByName(new_types)
    tell = lambda df, what, part, detail: df.filter("_error IS NOT NULL").select("path", F.lit(what).alias("what"), F.col(part).alias("part"), detail.alias("detail"), "_error")
    refused = tell(judged, "part", "part", F.lit(None).cast("string")).unionByName(tell(judged_links, "link", "owner", F.col("target"))).unionByName(tell(judged_unlinks, "unlink", "owner", F.col("id")))
    return save_packages(found, stored(every)), refused.select(_REFUSED)
