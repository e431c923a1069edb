"""Board lists: first-wins dedup, limits that pinned rows do not consume, and the re-check rule."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticelake.dims import RECHECK_DAYS


def unique_listed(listed: DataFrame) -> DataFrame:
    """One row per (source, id) in first-seen order; pinned only if every occurrence is pinned."""
    payload = [c for c in listed.columns if c not in ("source", "source_notice_id", "pinned", "pos")]
    aggs = [F.min("pos").alias("pos"), F.every(F.col("pinned")).alias("pinned")]
    aggs += [F.min_by(c, "pos").alias(c) for c in payload]
    return listed.groupBy("source", "source_notice_id").agg(*aggs)


def limit_regular(listed: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` regular rows of each board; pinned rows ride free.

    The constant rank filter lets Spark keep at most ``limit`` rows per board and task before the shuffle.
    """
    w = Window.partitionBy("source").orderBy("pos")
    regular = listed.filter(~F.col("pinned")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    return listed.filter("pinned").unionByName(regular.drop("_n"))


def limit_per_source(listed: DataFrame, limits: dict[str, int | None], override: int | None = None) -> DataFrame:
    """As ``limit_regular`` with one limit per board; boards without one keep every row.

    ``limits`` is the registry (one entry per board); ``override`` is the caller's limit for all boards.
    """
    if override is not None:
        return limit_regular(listed, override)
    capped = {s: n for s, n in limits.items() if n is not None}
    if not capped:
        return listed
    is_capped = F.col("source").isin(list(capped))
    of_board = F.element_at(F.create_map(*[F.lit(x) for kv in capped.items() for x in kv]), F.col("source"))
    w = Window.partitionBy("source").orderBy("pos")
    regular = (
        listed.filter(is_capped & ~F.col("pinned"))
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= max(capped.values()))
        .filter(F.col("_n") <= of_board)
        .drop("_n")
    )
    return listed.filter(~is_capped | F.col("pinned")).unionByName(regular)


def fetch_reason(listed: DataFrame, stored: DataFrame, today: date, full: bool = False) -> DataFrame:
    """Adds ``reason``: new, full, recent, upcoming or null (the stored copy is good enough).

    ``listed``: source_url and listed_date. ``stored``: one row per source_url with stored_id,
    published_at and ``dates`` (array of date strings), see views.stored_state.
    """
    known = F.col("stored_id").isNotNull()
    age = F.abs(F.datediff(F.coalesce("published_at", "listed_date"), F.lit(today)))
    upcoming = F.exists("dates", lambda d: F.substring(d, 1, 10) >= F.lit(today.isoformat()))
    reason = (
        F.when(~known, "new")
        .when(F.lit(full), "full")
        .when(age <= RECHECK_DAYS, "recent")
        .when(upcoming, "upcoming")
    )
    return listed.join(stored, "source_url", "left").withColumn("reason", reason)


def select_sources(rows: DataFrame, boards: DataFrame, spec: str | None) -> DataFrame:
    """Rows of the boards named (by id or alias) in a comma-separated list, with the registry order."""
    dim = boards.select("source", "alias", "ord")
    if spec:
        names = [n.strip() for n in spec.split(",") if n.strip()]
        known = dim.filter(F.col("source").isin(names) | F.col("alias").isin(names))
        found = known.select("source", "alias").toPandas()  # at most one row per requested name
        unknown = [n for n in names if n not in set(found["source"]) | set(found["alias"])]
        if unknown:
            raise ValueError(f"unknown source {unknown[0]!r}")
        dim = known
    return rows.join(dim.select("source", "ord"), "source")
