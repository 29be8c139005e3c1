"""URL filters: allow and block rules of a host and a path prefix, found through hashed expressions.

A rule fits the urls of its host and of all subdomains whose path starts with the rule's; of several the longest decides.
Each url is expanded into the pairs of host suffix and path prefix that some rule has the shape of, the pairs meet the rules by a
short prefix of their SHA-256, the full digest confirms, and the highest precedence is the verdict. The number of pairs of a url
depends on the rules' shapes alone, whatever the length of the url.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.common import checked_broadcast, numbered, saved, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits by which urls and rules meet; the other digits are compared afterwards.
SHORT = 8
#: Precedence is one number: length of the rule, length of its host, labels of its host, block before allow.
HOST_CHARS, HOST_LABELS = 1 << 12, 1 << 11
MOST_SHAPES = 4096
RULE_SCHEMA = "verdict string, host string, path string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first "://" up to "/", "?" or "#", and from there up to "?" or "#". Both are empty for null
    and where "://" is missing. A-Z of the host are lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (verdict, host, path); larger ones are read from files."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def expression(host: Column, path: Column) -> Column:
    """The text that is hashed. Hosts hold no "/", so the first one ends the host."""
    return F.concat(host, F.lit("//"), path)


def prepared(rules: DataFrame) -> DataFrame:
    """short, full (digest), precedence, labels, chars for each distinct rule. Rules without a host fit nothing and go, a null
    path is an empty one; where the same rule allows and blocks, it blocks."""
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce("path", F.lit(""))
    rows = rules.where("host <> '' and verdict in ('allow', 'block')").select("verdict", host.alias("host"), path.alias("path"))
    digest = F.sha2(expression(F.col("host"), F.col("path")), 256)
    labels, host_chars = F.size(F.split("host", "[.]")), F.length("host")
    length = (host_chars + F.length("path")).cast("long")
    block = (F.col("verdict") == "block").cast("int")
    order = ((length * HOST_CHARS + host_chars) * HOST_LABELS + labels) * 2 + block
    rows = rows.select(
        F.substring(digest, 1, SHORT).alias("short"), digest.alias("full"), order.alias("precedence"),
        labels.alias("labels"), F.length("path").alias("chars"), host_chars.alias("host_chars"),
    )
    return rows.groupBy("short", "full", "labels", "chars", "host_chars").agg(F.max("precedence").alias("precedence"))


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    """The distinct (labels of the host, characters of the path) of the prepared rules."""
    if not rules.where((F.col("host_chars") >= HOST_CHARS) | (F.col("labels") >= HOST_LABELS)).isEmpty():
        raise ValueError(f"a rule's host has {HOST_CHARS} characters or {HOST_LABELS} labels, or more")
    found = [tuple(r) for r in rules.select("labels", "chars").distinct().limit(MOST_SHAPES + 1).collect()]
    if len(found) > MOST_SHAPES:
        raise ValueError(f"the rules have more than {MOST_SHAPES} shapes of host and path")
    return sorted(found)


def expressions(host: str, path: str, shapes: list[tuple[int, int]]) -> Column:
    """The pairs of host suffix and path prefix of each shape that the url is long enough for."""
    shape = F.from_json(F.lit(json.dumps([{"labels": a, "chars": b} for a, b in shapes])), "array<struct<labels:int,chars:int>>")
    dots = F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit("")))
    fits = F.filter(shape, lambda s: (s["labels"] <= dots + 1) & (s["chars"] <= F.length(path)))
    return F.transform(fits, lambda s: expression(F.call_function("substring_index", F.col(host), F.lit("."), -s["labels"]), F.substring(F.col(path), F.lit(1), s["chars"])))


def url_verdicts(pages: DataFrame, rules: DataFrame, ids: tuple[str, ...] = ("page_id",), url: str = "url", default: str = "allow") -> DataFrame:
    """The id columns with host, path, rule (null if none fits) and verdict, for each row of pages; other columns are ignored.

    Null and empty urls, and those without "://", have an empty host and path: no rule fits them, `default` is their
    verdict. Repeated rows are judged one by one, tables without rows or rules give no rows or no rule.
    """
    host, path = url_parts(F.col(url))
    table = saved(prepared(rules), "url-rules")
    shapes = shapes_of(table)
    rows = saved(numbered(pages, *ids, host.alias("host"), path.alias("path")), "url-rows")
    each = rows.withColumn("expression", F.explode_outer(expressions("host", "path", shapes)))
    full = F.sha2("expression", 256)
    each = each.select(*rows.columns, F.substring(full, 1, SHORT).alias("short"), full.alias("own"))
    table = table.select("short", "full", "precedence")
    few = checked_broadcast(table)
    met = each.join(few, "short", "left") if few is not table else spread_join(each, table, ["short"], F.col("row"), how="left")
    confirmed = F.when(F.col("own") == F.col("full"), F.col("precedence"))
    best = met.groupBy(*rows.columns).agg(F.max(confirmed).alias("best"))
    length = F.expr(f"best div {2 * HOST_LABELS * HOST_CHARS}")
    host_chars = F.expr(f"best div {2 * HOST_LABELS} % {HOST_CHARS}")
    labels = F.expr(f"best div 2 % {HOST_LABELS}").cast("int")
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -labels)
    prefix = F.substring(F.col("path"), F.lit(1), (length - host_chars).cast("int"))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best") % 2 == 1, "block").otherwise("allow")
    return best.select(*ids, "host", "path", F.concat(suffix, prefix).alias("rule"), verdict.alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows of pages that are not blocked, with all columns. Each distinct url is judged once."""
    key = F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url_key")
    judged = url_verdicts(pages.select(key).distinct(), rules, ("url_key",), "url_key", default)
    blocked = saved(judged.where("verdict = 'block'").select("url_key"), "url-blocked")
    hashed = [F.col(f"`{f.name}`") for f in pages.schema if not {"map", "variant"} & set(re.findall("[a-z]+", f.dataType.simpleString()))]
    rows = pages.select(F.struct("*").alias("page"), F.xxhash64(*hashed).alias("spread"), key)
    return spread_join(rows, blocked, ["url_key"], F.col("spread"), how="left_anti").select("page.*")
