"""Read views: latest analysis and its status, the canonical list, details and group lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake import schemas
from noticelake.operators import resolve
from noticelake.operators.skew import HOT_ROWS, hot_lookup_join, wide_lookup_join

FAR_PAST = 1 << 30
CHOICE = ["id", "group_id", "source", "published_at", "status", "analysis_id"]


def newest(published_at: str = "published_at", row_id: str = "id") -> list[Column]:
    """Sort keys of the default list order: newest day first, undated last, then highest id."""
    return [F.coalesce(-F.unix_date(F.col(published_at)), F.lit(FAR_PAST)), -F.col(row_id)]


def latest_version(analysis: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """The newest version per key; the aggregate is combined before the shuffle."""
    packed = F.max(F.struct(order.alias("_order"), *columns)).alias("v")
    return analysis.groupBy(key).agg(packed).select(key, *[F.col(f"v.{c}").alias(c) for c in columns])


def with_latest_analysis(notices: DataFrame, analysis: DataFrame, columns: list[str]) -> DataFrame:
    """Notices plus their newest analysis and ``status``: pending, ready, or stale (text changed since)."""
    cols = ["analysis_id", "content_hash", *columns]
    last = latest_version(analysis, "notice_id", F.col("analysis_id"), cols).withColumnsRenamed(
        {"notice_id": "id", "content_hash": "analyzed_hash"}
    )
    joined = notices.join(last, "id", "left")
    status = (
        F.when(F.col("analysis_id").isNull(), "pending")
        .when(F.col("analyzed_hash").eqNullSafe(F.col("content_hash")), "ready")
        .otherwise("stale")
    )
    return joined.withColumn("status", status)


def _ladder(tie: list[Column]) -> Column:
    """Which copy's analysis a group shows: the canonical's if current, any current, then stale ones."""
    own = F.col("id") == F.col("group_id")
    rank = (
        F.when(own & (F.col("status") == "ready"), 0)
        .when(F.col("status") == "ready", 1)
        .when(own & (F.col("status") == "stale"), 2)
        .when(F.col("status") == "stale", 3)
        .when(own, 4)
        .otherwise(5)
    )
    return F.struct(rank.alias("rank"), *[t.alias(f"t{i}") for i, t in enumerate(tie)])


def pick_analysis(rows: DataFrame, tie: list[Column]) -> DataFrame:
    """Per group: the copy whose analysis is shown and its status, number of copies and boards.

    ``rows``: id, group_id, source, published_at, status. Only scalars and the distinct board names
    (bounded by the board dimension) are aggregated, so a group may have any number of copies.
    """
    return rows.groupBy("group_id").agg(
        F.min(F.struct(_ladder(tie).alias("k"), "id", "status")).alias("best"),
        F.count("*").alias("n_copies"),
        F.array_sort(F.collect_set("source")).alias("boards"),
    ).select("group_id", F.col("best.id").alias("shown_id"), F.col("best.status").alias("status"), "n_copies", "boards")


def canonical_list(rows: DataFrame, analysis_columns: list[str], detail: bool = False, heads: DataFrame | None = None) -> DataFrame:
    """One row per group: the canonical row, its boards and the chosen analysis.

    ``rows``: with_latest_analysis over grouped notices. Ties between copies: newest first in lists,
    lowest id in details. The full list of copies is ``group_sources``. ``heads``: the canonical rows with their own
    columns, if ``rows`` holds only the columns that the choice needs (``CHOICE`` and the analysis).
    """
    tie = [F.col("id")] if detail else newest()
    chosen = pick_analysis(rows, tie)
    head = heads
    if head is None:
        head = rows.filter(F.col("id") == F.col("group_id")).drop("status", "analysis_id", "analyzed_hash", *analysis_columns)
    shown = rows.filter(F.col("analysis_id").isNotNull()).select(F.col("id").alias("shown_id"), "analysis_id", *analysis_columns)
    picked = chosen.join(shown, "shown_id", "left")  # narrow; texts stay where the join by id has put them
    own = [c for c in head.columns if c != "group_id"]
    out = head.join(picked.withColumnRenamed("group_id", "_group"), F.col("id") == F.col("_group"))
    return out.select("shown_id", "group_id", *own, "status", "n_copies", "boards", "analysis_id", *analysis_columns)


def group_sources(rows: DataFrame, boards: DataFrame) -> DataFrame:
    """Every copy of every group with its board's kind and order (unknown boards: main, last)."""
    dim = boards.select("source", F.col("kind").alias("k"), "ord")
    last = boards.count()
    out = rows.join(F.broadcast(dim), "source", "left") if last <= 100_000 else rows.join(dim, "source", "left")
    return out.select(
        "group_id", F.coalesce("ord", F.lit(last)).alias("source_ord"), "id", "source",
        F.coalesce("k", F.lit("main")).alias("kind"), "source_url", "published_at",
    )


def detail_by_copy(
    rows: DataFrame, asked: DataFrame, analysis_columns: list[str], notices: DataFrame | None = None, assigned: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The canonical notice for any copy's id. ``asked``: one column ``id``.

    With ``notices`` (own columns of all rows) and ``assigned`` (their id and dup_of), ``rows`` holds only the columns that
    the choice needs: copies find their canonical id and analysis first, and texts are shuffled once, to the copies.
    """
    heads = None
    if notices is not None:
        heads = assigned.filter("dup_of IS NULL").withColumn("group_id", F.col("id"))
    details = canonical_list(rows, analysis_columns, detail=True, heads=heads)
    details = details.withColumnRenamed("id", "canonical_id")
    want = rows.select("id", "group_id").join(asked, "id", "left_semi").withColumnRenamed("id", "asked_id")
    sizes = details.withColumnRenamed("n_copies", "_n").withColumn("n_copies", F.col("_n"))
    out = hot_lookup_join(want, sizes, ["group_id"], "asked_id", "_n", hot_rows)
    if notices is None:
        return out
    hot = details.filter(F.col("n_copies") > hot_rows).select("canonical_id").distinct()
    own = [c for c in notices.columns if c != "id"]
    whole = wide_lookup_join(out, notices.withColumnRenamed("id", "canonical_id"), ["canonical_id"], "asked_id", hot)
    first = ["group_id", "asked_id", "shown_id", "canonical_id"]
    return whole.select(*first, *own, *[c for c in out.columns if c not in first])


def current_copies(notices: DataFrame, analysis: DataFrame, prompt_version: str | None = None) -> DataFrame:
    """Ids whose present text has an analysis (any version, or one of the given prompt version)."""
    a = analysis if prompt_version is None else analysis.filter(F.col("prompt_version") == prompt_version)
    pairs = a.select(F.col("notice_id").alias("id"), "content_hash")
    return notices.join(pairs, ["id", "content_hash"], "left_semi")


def group_current(notices: DataFrame, analysis: DataFrame, prompt_version: str | None = None) -> DataFrame:
    """Per group with a current analysis: the copy that has it (canonical first, then lowest id)."""
    rows = current_copies(notices, analysis, prompt_version)
    first = F.min(F.struct((F.col("id") != F.col("group_id")).alias("is_copy"), "id"))
    return rows.groupBy("group_id").agg(first.alias("f")).select("group_id", F.col("f.id").alias("current_id"))


def stored_state(notices: DataFrame, analysis: DataFrame) -> DataFrame:
    """Per article URL: id, day and the dates of the newest analysis of any copy in the group."""
    owner = notices.select(F.col("id").alias("notice_id"), "group_id")
    dates = F.array_compact(F.array("deadline", "application_end", "event_date"))
    packed = analysis.select("notice_id", "analysis_id", dates.alias("dates")).join(owner, "notice_id")
    newest_of_group = latest_version(packed, "group_id", F.col("analysis_id"), ["dates"])
    sizes = notices.groupBy("group_id").agg(F.count("*").alias("n")).join(newest_of_group, "group_id", "left")
    rows = notices.select("id", "source_url", "published_at", "group_id")
    out = hot_lookup_join(rows, sizes, ["group_id"], "id", "n")
    return out.select(
        "source_url", F.col("id").alias("stored_id"), "published_at",
        F.coalesce("dates", F.array().cast("array<string>")).alias("dates"),
    )


def board_facts(rows: DataFrame, boards: DataFrame) -> DataFrame:
    """Adds kind, college, major and order of the row's board; unknown boards read as main, last."""
    n = boards.count()
    dim = boards.select("source", "kind", "college", "major", "ord")
    out = rows.join(F.broadcast(dim) if n <= 100_000 else dim, "source", "left")
    return out.withColumns({"kind": F.coalesce("kind", F.lit("main")), "ord": F.coalesce("ord", F.lit(n))})


def stored_record(rows: DataFrame) -> DataFrame:
    """A stored row back in the shape the crawler delivers."""
    return rows.select(
        "source", "source_notice_id", "source_url", "title", "original_content", "published_at", "board_category", "crawled_at"
    )


def stored_list(rows: DataFrame, boards: DataFrame, analysis_columns: list[str]) -> DataFrame:
    """The list over stored groups: a copy whose canonical row is gone is listed on its own; boards are in registry order.

    ``rows``: with_latest_analysis over stored notices with ``dup_of``. Boards that the registry lacks come last, by name.
    """
    own = resolve.orphan_groups(rows.drop("group_id"))
    n = boards.count()
    dim = boards.select("source", "ord")
    placed = own.select("group_id", "source").join(F.broadcast(dim) if n <= 100_000 else dim, "source", "left")
    order = F.array_sort(F.collect_set(F.struct(F.coalesce("ord", F.lit(n)).alias("ord"), "source")))
    placed = placed.groupBy("group_id").agg(F.transform(order, lambda x: x["source"]).alias("boards"))
    return canonical_list(own, analysis_columns).drop("boards").join(placed, "group_id")


def stored_detail(rows: DataFrame, asked: DataFrame, analysis_columns: list[str]) -> DataFrame:
    """``detail_by_copy`` over stored groups, with ``attachments`` decoded from ``attachments_json`` (none: empty).

    Of a group whose canonical row is gone, the remaining copy with the lowest id stands for all of them.
    """
    root = F.coalesce("dup_of", "id")
    heads = rows.groupBy(root.alias("_root")).agg(F.min(F.struct(F.col("dup_of").isNotNull().alias("copy"), "id")).alias("f"), F.count("*").alias("_n"))
    heads = heads.select("_root", F.col("f.id").alias("group_id"), "_n")
    own = hot_lookup_join(rows.drop("group_id").withColumn("_root", root), heads, ["_root"], "id", "_n").drop("_root")
    files = F.coalesce(F.from_json("attachments_json", schemas.ATTACHMENTS), F.array().cast(schemas.ATTACHMENTS))
    return detail_by_copy(own, asked, analysis_columns).withColumn("attachments", files).drop("attachments_json")
