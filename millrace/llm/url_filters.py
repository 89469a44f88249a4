"""URL filtering by hash prefixes of host-suffix and path-prefix expressions.

A rule is a host and a path. Each distinct url is expanded into the expressions that a rule of the list could equal:
its host's suffixes of as many labels as some rule has, with its path's prefixes as long as that rule's path. The
expressions meet the rules in an equi-join on four bytes of their SHA-256; a hit counts if the whole digest agrees,
and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands after the first `://`, up to `/`, `?`, `#` or the end, with A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The verdict on each row of `pages`: `id_col`, host, path, rule (host and path, or null), verdict.

    `rules` holds (verdict, host, path). A rule fits its host and all subdomains if the url's path starts with its own;
    of several the one with the longest host and path wins, then the greatest as text. No rule: `default`. A null url
    or one without `://` has an empty host and path. Repeated rows are judged each; other columns are left out; with
    no rules all get `default`; an empty table gives an empty table.
    """
    rules = sorted(set(rules))
    spark = pages.sparkSession
    listed = spark.createDataFrame([(host + path, verdict, len(host.split(".")), len(path)) for verdict, host, path in rules], "rule string, verdict string, labels int, size int")
    digest = F.sha2(F.col("rule"), 256)
    hashed = listed.select("rule", "verdict", digest.alias("digest"), F.substring(digest, 1, PREFIX_HEX).alias("prefix"))
    shapes = sorted({(len(host.split(".")), len(path)) for _, host, path in rules}) or [(1, 1)]

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = rows.groupBy("id", "url").agg(F.count(F.lit(1)).alias("n")).select("id", "url", "n", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    expressions = [
        F.when((F.length("path") >= size) & (F.size(F.split("host", r"\.")) >= labels), F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, size)))
        for labels, size in shapes
    ]
    # An expression that the host or the path is too short for becomes the empty text, which is no rule, so that each
    # url keeps its rows.
    wide = urls.withColumn("expression", F.explode(F.array(*[F.coalesce(e, F.lit("")) for e in expressions])))
    probe = wide.withColumn("probe", F.sha2("expression", 256)).withColumn("prefix", F.substring("probe", 1, PREFIX_HEX))
    met = probe.join(hashed, "prefix", "left")
    hit = F.col("probe") == F.col("digest")
    best = met.groupBy("id", "url", "n", "host", "path").agg(F.max(F.when(hit, F.struct(F.length("rule").alias("size"), "rule", "verdict"))).alias("best"))
    return best.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"),
    ).drop("copy")
