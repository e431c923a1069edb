"""Decisions and bookkeeping of a crawl run: analysis work list, budget, statistics, stop policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.dims import MAX_CONSECUTIVE_OVERLOADS
from noticelake.operators.skew import hot_lookup_join


def work_decision(
    processed: DataFrame, current: DataFrame, current_version: DataFrame, order: list[str],
    upgrade: bool = False, analyser_available: bool = True,
) -> DataFrame:
    """Adds ``decision`` and ``reason`` to every processed row.

    ``processed``: id, group_id, status (new, updated, unchanged, known) and the order columns.
    ``current`` / ``current_version``: views.group_current for any and for the present prompt version.
    One copy per group is analysed per run: the first one in processing order; a failed group is tried
    again in the next run.
    """
    per_group = (
        processed.groupBy("group_id")
        .agg(F.count("*").alias("n"), F.min(F.struct(*order, "id")).alias("first"))
        .join(current, "group_id", "left")
        .join(current_version.select("group_id", F.lit(True).alias("is_latest")), "group_id", "left")
        .select("group_id", "n", "current_id", "is_latest", F.col("first.id").alias("first_id"))
    )
    rows = hot_lookup_join(processed, per_group, ["group_id"], "id", "n")
    has = F.col("current_id").isNotNull()
    up = has & F.lit(upgrade) & F.col("is_latest").isNull()
    skip = has & ~up
    own = F.col("current_id") == F.col("id")
    decision = (
        F.when(skip & (F.col("status") == "known"), "known-skip")
        .when(skip & ~own, "duplicate-skip")
        .when(skip, "current-skip")
        .when(F.lit(not analyser_available), "deferred")
        .when(F.col("first_id") != F.col("id"), "duplicate-skip")
        .otherwise("analyse")
    )
    reason = (
        F.when(F.col("decision").isin("known-skip", "current-skip"), "analysis is current")
        .when(F.col("decision") == "duplicate-skip", "same notice is analysed once")
        .when(up, "upgrade")
        .when(F.col("status").isin("unchanged", "known"), "pending")
        .otherwise(F.col("status"))
    )
    out = rows.withColumn("decision", decision).withColumn("reason", reason)
    counts_as_copy = F.col("decision").isin("known-skip", "duplicate-skip") & ~F.coalesce(own, F.lit(False))
    return out.withColumn("is_duplicate", counts_as_copy).drop("is_latest", "first_id")


def cut_budget(decided: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """At most ``budget`` rows stay ``analyse`` over all boards in processing order; the rest is deferred.

    The other copies of a deferred row's group find no current analysis and no budget either: they are deferred too.
    """
    if budget < 0:
        raise ValueError("budget must be zero or more")
    if budget == 0:
        return _defer_copies(decided.withColumn("decision", F.when(F.col("decision") == "analyse", "deferred").otherwise(F.col("decision"))))
    todo = decided.filter(F.col("decision") == "analyse")
    chosen = todo.orderBy(*order, "id").limit(budget).select("id", F.lit(True).alias("in_budget"))
    over = (F.col("decision") == "analyse") & F.col("in_budget").isNull()
    return _defer_copies(decided.join(chosen, "id", "left").withColumn("decision", F.when(over, "deferred").otherwise(F.col("decision"))).drop("in_budget"))


def _defer_copies(cut: DataFrame) -> DataFrame:
    late = cut.filter(F.col("decision") == "deferred").select("group_id", F.lit(True).alias("_late")).distinct()
    copy = (F.col("decision") == "duplicate-skip") & F.coalesce("_late", F.lit(False))
    out = cut.join(late, "group_id", "left").withColumn("_copy", copy)
    out = out.withColumn("decision", F.when(F.col("_copy"), "deferred").otherwise(F.col("decision")))
    return out.withColumn("is_duplicate", F.col("is_duplicate") & ~F.col("_copy")).select(*cut.columns)


def run_stats(results: DataFrame) -> DataFrame:
    """Counters per board: results has source, pinned, status, decision, is_duplicate and outcome."""

    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond).alias(name)

    status, decision, outcome = F.col("status"), F.col("decision"), F.col("outcome")
    return results.groupBy("source").agg(
        F.count("*").alias("found"),
        n(F.col("pinned"), "pinned"),
        n(status != "known", "fetched"),
        n(status == "known", "known"),
        n(status == "new", "new"),
        n(status == "updated", "updated"),
        n(status == "unchanged", "unchanged"),
        n(status == "crawl_failed", "crawl_failed"),
        n((decision == "analyse") & (outcome == "success"), "analyzed"),
        n((decision == "analyse") & (outcome == "failed"), "analysis_failed"),
        n((decision == "deferred") | (outcome == "deferred"), "analysis_deferred"),
        n(decision.isin("known-skip", "duplicate-skip", "current-skip"), "analysis_skipped"),
        n(F.col("is_duplicate"), "duplicates"),
    )


# Outcomes that end a run at once, and those the overload counter ignores.
HARD_STOPS = ["no_request", "http_429", "http_400", "http_401", "http_403", "http_404"]
NOT_COUNTED = ["json_error"]


def stop_policy(log: DataFrame, max_overloads: int = MAX_CONSECUTIVE_OVERLOADS, chunk: int = 65_536) -> DataFrame:
    """Which attempts of each run happened before the stop: adds ``stopped_at`` and ``result``.

    ``log``: run, pos (processing order), outcome. A hard stop or the third overload in a row (a JSON
    error neither counts nor resets, a success resets) stops the run; everything after it is deferred.

    A run may be long, so streaks are found inside chunks of positions, and across chunk borders from
    the few counted rows at the ends of each chunk.
    """
    k = max_overloads
    counted = log.filter(~F.col("outcome").isin(NOT_COUNTED) & ~F.col("outcome").isin(HARD_STOPS)).select(
        "run", "pos", (F.col("outcome") == "overload").alias("bad"), F.floor(F.col("pos") / chunk).alias("c")
    )
    inside = Window.partitionBy("run", "c").orderBy("pos")
    streak = F.count_if("bad").over(inside.rowsBetween(-(k - 1), 0))
    numbered = counted.select("*", streak.alias("s"), F.row_number().over(inside).alias("r"),
                              F.count("*").over(Window.partitionBy("run", "c")).alias("size"))
    in_chunk = numbered.filter(F.col("s") >= k).groupBy("run").agg(F.min("pos").alias("stop"))
    ends = numbered.filter((F.col("r") < k) | (F.col("r") > F.col("size") - (k - 1)))
    over_run = Window.partitionBy("run").orderBy("pos")
    follows = (F.lag("c").over(over_run) != F.col("c")) | (F.lag("r").over(over_run) == F.col("r") - 1)
    linked = ends.select("run", "pos", "bad", F.coalesce(follows, F.lit(False)).alias("follows"))
    span = over_run.rowsBetween(-(k - 1), 0)
    links = over_run.rowsBetween(-(k - 2), 0)
    across = (
        linked.select("run", "pos", F.count_if("bad").over(span).alias("s"), F.count_if("follows").over(links).alias("l"))
        .filter((F.col("s") >= k) & (F.col("l") >= k - 1))
        .groupBy("run")
        .agg(F.min("pos").alias("stop"))
    )
    hard = log.filter(F.col("outcome").isin(HARD_STOPS)).groupBy("run").agg(F.min("pos").alias("stop"))
    stops = in_chunk.unionByName(across).unionByName(hard).groupBy("run").agg(F.min("stop").alias("stopped_at"))
    sizes = log.groupBy("run").agg(F.count("*").alias("n")).join(stops, "run", "left")
    rows = hot_lookup_join(log, sizes, ["run"], "pos", "n")
    result = (
        F.when(F.col("pos") > F.col("stopped_at"), "deferred")
        .when(F.col("outcome") == "success", "success")
        .when(F.col("outcome") == "no_request", "deferred")
        .otherwise("failed")
    )
    return rows.withColumn("result", result)
