"""Counters over the store and the list: facets, headline numbers, freshness, list filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake import dims
from noticelake.functions.dates import days_until
from noticelake.functions.labels import effective_deadline
from noticelake.operators.views import current_copies


def store_counts(notices: DataFrame, analysis: DataFrame) -> DataFrame:
    """Stored notices and analyses, and notices whose group has / lacks a current analysis."""
    flagged = current_copies(notices, analysis).select("group_id").distinct().withColumn("ok", F.lit(True))
    groups = notices.groupBy("group_id").agg(F.count("*").alias("n")).join(flagged, "group_id", "left")
    zero = F.lit(0).cast("long")
    per_notice = groups.select("n", F.when(F.col("ok"), F.col("n")).otherwise(zero).alias("n_current"), zero.alias("n_analyses"))
    versions = analysis.agg(F.count("*").alias("n_analyses")).select(zero.alias("n"), zero.alias("n_current"), "n_analyses")
    return per_notice.unionByName(versions).agg(
        F.sum("n").alias("notices"),
        F.sum("n_analyses").alias("analyses"),
        F.sum("n_current").alias("analyzed_current"),
        (F.sum("n") - F.sum("n_current")).alias("pending_analysis"),
    )


def category_or_pending(category: Column) -> Column:
    return F.coalesce(category, F.lit(dims.PENDING_CATEGORY))


def filter_category(items: DataFrame, value: str) -> DataFrame:
    return items if value == "all" else items.filter(category_or_pending(F.col("category")) == value)


def category_facets(items: DataFrame, categories: list[str]) -> DataFrame:
    """(ord, value, n): all, then categories in fixed order, then pending; empty ones are left out."""
    order = {c: i + 1 for i, c in enumerate([*categories, dims.PENDING_CATEGORY])}
    ord_of = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("value"))
    counted = items.groupBy(category_or_pending(F.col("category")).alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("all").alias("value"), "n")
    known = counted.filter(F.col("value").isin(list(order))).select(ord_of.alias("ord"), "value", "n")
    return total.select(F.lit(0).alias("ord"), "value", "n").unionByName(known)


def source_facets(copies: DataFrame, n_items: int | None, boards: DataFrame, profile: dict | None = None) -> DataFrame:
    """(ord, value, n): all, own department (if collected), own college, then every board, also at 0.

    ``copies``: one row per (group_id, source) copy. A cross-posted item counts once per board.
    """
    per_board = copies.select("group_id", "source").distinct().groupBy("source").agg(F.count("*").alias("n"))
    board_rows = boards.join(per_board, "source", "left").select(
        (F.col("ord") + 10).alias("ord"), F.col("source").alias("value"), F.coalesce("n", F.lit(0)).alias("n"),
        "kind", "college", "major",
    )
    total = copies.agg(F.countDistinct("group_id").alias("n")) if n_items is None else None
    head = (
        total.select(F.lit(0).alias("ord"), F.lit("all").alias("value"), "n")
        if total is not None
        else boards.sparkSession.createDataFrame([(0, "all", n_items)], "ord int, value string, n bigint")
    )
    out = head
    if profile:
        mine = board_rows.filter((F.col("kind") == "department") & (F.col("major") == profile["major"]))
        college = board_rows.filter((F.col("kind") == "college") & (F.col("college") == profile["college"]))
        first = mine.agg(F.min_by("n", "ord").alias("n")).filter("n is not null")
        own = college.agg(F.min_by("n", "ord").alias("n"))
        out = out.unionByName(first.select(F.lit(1).alias("ord"), F.lit("my-major").alias("value"), "n"))
        out = out.unionByName(own.select(F.lit(2).alias("ord"), F.lit("my-college").alias("value"), F.coalesce("n", F.lit(0)).alias("n")))
    return out.unionByName(board_rows.select("ord", "value", "n"))


def resolve_source(boards: DataFrame, value: str | None, profile: dict | None = None) -> DataFrame | None:
    """Boards a filter value selects (column ``source``); None means no filter.

    A board id, a kind (every board of the kind) or ``my-major`` / ``my-college``. If the profile's own
    board is not collected the selection is empty, never other boards. Unknown values select everything.
    """
    if not value or value == "all":
        return None
    if value in ("my-major", "my-college"):
        if not profile:
            return None
        kind, field = ("department", "major") if value == "my-major" else ("college", "college")
        mine = boards.filter((F.col("kind") == kind) & (F.col(field) == profile[field]))
        return mine.orderBy("ord").limit(1).select("source")
    one = boards.filter(F.col("source") == value).select("source")
    if not one.isEmpty():
        return one
    if value in dims.SOURCE_KINDS:
        return boards.filter(F.col("kind") == value).select("source")
    return None


def filter_source(items: DataFrame, copies: DataFrame, selected: DataFrame | None) -> DataFrame:
    """Items posted on any selected board. ``copies``: (group_id, source)."""
    if selected is None:
        return items
    return items.join(copies.join(selected, "source", "left_semi").select("group_id"), "group_id", "left_semi")


def canonical_source_param(values: DataFrame, boards: DataFrame) -> DataFrame:
    """``canonical`` for each filter value: a kind with one board becomes that board, unknown becomes all."""
    kinds = boards.groupBy("kind").agg(F.count("*").alias("n"), F.min("source").alias("only"))
    kinds = kinds.select(F.col("kind").alias("value"), F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("kind")).alias("of_kind"))
    ids = boards.select(F.col("source").alias("value"), F.lit(True).alias("is_board"))
    keep = F.col("value").isin("all", "my-major", "my-college") | F.col("is_board").isNotNull()
    empty_kind = F.when(F.col("value").isin(dims.SOURCE_KINDS), F.col("value"))
    canonical = F.when(keep, F.col("value")).otherwise(F.coalesce("of_kind", empty_kind, F.lit("all")))
    return values.join(ids, "value", "left").join(kinds, "value", "left").select("value", canonical.alias("canonical"))


def filter_saved(items: DataFrame, saved: DataFrame, key: str = "id") -> DataFrame:
    """Items whose id is in the saved list; entries that are not integers are ignored."""
    ids = saved.select(F.expr("try_cast(saved_id as bigint)").alias(key)).filter(F.col(key).isNotNull())
    return items.join(ids, key, "left_semi")


def headline_counts(items: DataFrame, today: date) -> DataFrame:
    """One row: total, analysed, pending and closing within a week."""
    days = days_until(effective_deadline(F.col("deadline"), F.col("application_end")), today)
    return items.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") != "pending").alias("analyzed"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(days.between(0, dims.CLOSING_SOON_DAYS)).alias("closing_soon"),
    )


def freshness(checks: DataFrame, boards: DataFrame, notices: DataFrame) -> DataFrame:
    """One row: the oldest last check over known boards, else the newest crawl time."""
    known = checks.join(boards.select("source"), "source", "left_semi")
    both = known.select("checked_at", F.lit(None).cast("timestamp").alias("crawled_at")).unionByName(
        notices.select(F.lit(None).cast("timestamp").alias("checked_at"), "crawled_at")
    )
    return both.agg(F.coalesce(F.min("checked_at"), F.max("crawled_at")).alias("last_checked_at"))


def board_checks(checks: DataFrame, boards: DataFrame) -> DataFrame:
    """One row per known board, ``ord`` giving the registry's order: source, ord, checked_at (null before its first check)."""
    return boards.select("source", "ord").join(checks.select("source", "checked_at"), "source", "left")
