"""URL allow and block lists by host suffix and path prefix.

Each distinct (host, path) expands into all its host suffixes, cut at dots, times the path prefixes of the lengths that
rules have. Expressions meet rules by an equi-join on the first four bytes of a SHA-256 digest; the whole digest then
confirms the match, and of the rules that match the longest decides. All of it is DataFrame functions.

Defined results: a null URL, or one without "://", has an empty host and path and gets the default verdict; rows repeat
as in the input; an empty rule table leaves the default for all; other columns may be kept by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of what stands after the first "://"."""
    has = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.when(has, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and what stands after each of its dots."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def digests(expression: Column) -> tuple[Column, Column]:
    """The short hash that is joined on and the whole digest that confirms."""
    whole = F.sha2(expression, 256)
    return F.conv(F.substring(whole, 1, 8), 16, 10).cast("long"), whole


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The columns `keep`, host, path, rule (host and path of the longest that fits, or null) and verdict.

    rules: host, path, verdict; a rule fits its host and all subdomains where the path starts with its own.
    """
    short, whole = digests(F.concat("host", "path"))
    listed = rules.select("host", "path", "verdict").distinct().select(
        short.alias("short"), whole.alias("whole"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"), F.length("path").alias("path_length")
    )
    lengths = listed.agg(F.coalesce(F.collect_set("path_length"), F.array().cast("array<int>")).alias("lengths"))
    host, path = split_url(F.col(url))
    split = pages.select(*keep, host.alias("host"), path.alias("path"))
    parts = split.filter("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("one")).crossJoin(F.broadcast(lengths))
    expanded = parts.select("host", "path", F.explode(suffixes(F.col("host"))).alias("suffix"), "lengths").select(
        "host", "path", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.concat("suffix", F.expr("path").substr(F.lit(1), n)))).alias("expression")
    )
    short, whole = digests(F.col("expression"))
    hit = expanded.withColumns({"short": short, "own": whole}).join(listed, "short").filter("own = whole")
    best = hit.groupBy("host", "path").agg(F.max(F.struct((F.col("host_length") + F.col("path_length")).alias("n"), "host_length", "rule", "verdict")).alias("best"))
    return split.join(best, ["host", "path"], "left").select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
