"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes, then confirmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import ascii_lower, small_side

PREFIX = 8  # hex digits of a digest that are joined on
DEFAULT = "allow"  # verdict of urls that no rule fits


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules`` has rule (a host and, from its first ``/`` on, a path) and verdict. A rule fits its host and every
    subdomain if the url's path starts with its path. The longest rule wins; of equal length the one with the longer
    host, then the smaller text, then the smaller verdict. Without a fitting rule the verdict is ``default``.

    Each url is expanded into its host suffixes times its path prefixes, but only with the label counts and path
    lengths that rules have. Expressions meet rules on the first digits of their digests, the whole digest confirms.
    A url's expressions stay in its task up to the join, and only one small row per page is shuffled. Null urls have
    an empty host and path and fit no rule with a host; repeated rows come back as often; null or empty rule texts
    are ignored; an empty rule table leaves the default; other columns are ignored.
    """
    parsed = rules.select(F.col("rule").cast("string").alias("rule"), F.col("verdict").cast("string").alias("verdict")).filter("rule is not null and rule != ''").distinct()
    cut = F.instr("rule", "/")
    parsed = parsed.select("rule", "verdict", ascii_lower(F.when(cut > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule"))).alias("host"), F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("path"))
    sized = parsed.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = sorted(sized["labels"]), sorted(sized["lengths"])  # as many as rules have host depths and path lengths
    keyed = parsed.select(
        F.substring(_digest(F.col("host"), F.col("path")), 1, PREFIX).alias("short"),
        _digest(F.col("host"), F.col("path")).alias("full"),
        F.struct((-F.length("rule")).alias("a"), (-F.length("host")).alias("b"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict")).alias("rank"),
    )
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.array_distinct(F.filter(F.transform(F.array(*[F.lit(n) for n in labels]) if labels else F.array().cast("array<int>"), lambda n: F.when(n <= F.size(parts), F.concat_ws(".", F.slice(parts, F.size(parts) - n + 1, n)))), lambda x: x.isNotNull()))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: F.when(n <= F.length("path"), F.substring(F.col("path"), F.lit(1), n))), lambda x: x.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    digests = F.concat(F.array(F.lit("")), pairs)  # the first stands for the row itself
    rows = rows.select("page_id", "url", "host", "path", F.explode(digests).alias("digest")).withColumn("key", F.substring("digest", 1, PREFIX))
    met = rows.join(small_side(keyed), rows["key"] == keyed["short"], "left")
    fits = F.when(F.col("digest") == F.col("full"), F.col("rank"))
    best = met.groupBy("page_id", "url", "host", "path").agg(F.min(fits).alias("best"), F.sum((F.col("digest") == "").cast("int")).alias("copies"))
    out = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_"))
    return out.drop("_")
