"""URL rules: host-suffix and path-prefix expressions, found by short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.llm.common import spread_join

#: Hex digits of the digest that the join compares first.
SHORT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge pages (page_id, url) by rules (host, path, verdict).

    A rule fits its host and all subdomains of it where the url's path starts with the rule's path. The longest rule
    (host and path together) wins; among equally long ones that with the longer host, then a block. Returns page_id,
    url, host, path, rule (host and path of the winner, or null) and verdict (the winner's, or default), one row per
    row of pages. Urls are judged once for each distinct host and path. A null url has an empty host and path.
    Whole urls count, however long, an empty table of pages gives an empty table, and without rules all have the default. Rules that hold a null are left out. Other columns of either table don't matter.
    """
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    digest = F.sha2(F.concat("host", "path").cast("binary"), 256)
    listed = rules.select(
        F.substring(digest, 1, SHORT).alias("short"), digest.alias("digest"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length")
    )
    # The lengths that occur in rules say which suffixes and prefixes to expand: as many as there are lengths.
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length")).distinct()
    labels = [r[0] for r in shapes.select("labels").distinct().collect()]
    lengths = [r[0] for r in shapes.select("path_length").distinct().collect()]

    urls = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    addresses = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels])) if labels else F.array().cast("array<string>")
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    expanded = addresses.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes)).withColumn("found", F.sha2(F.concat("suffix", "prefix").cast("binary"), 256))
    hits = expanded.join(listed, F.substring("found", 1, SHORT) == F.col("short")).filter(F.col("found") == F.col("digest"))
    order = F.struct(F.length("rule"), F.col("host_length"), F.col("verdict") == "block")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    # All urls without a host share a key, and so may those of one page.
    return spread_join(urls, best, ["host", "path"], "left").select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
