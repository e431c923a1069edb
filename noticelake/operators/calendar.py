"""Calendar: events out of analyses, days, chips, month grids and imported events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake import dims
from noticelake.functions.dates import day_text, days_until
from noticelake.operators.skew import rank_in_group, with_global_index
from noticelake.operators.views import newest

KIND_ORD = {"deadline": 0, "event": 1}


def unpivot_events(items: DataFrame) -> DataFrame:
    """One row per dated fact: the effective deadline (``due``) and the event. Pending items have none."""

    def fact(kind: str, when: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(KIND_ORD[kind]).alias("kind_ord"), F.col(when).alias("date"))

    facts = F.filter(F.array(fact("deadline", "due"), fact("event", "event_date")), lambda x: x["date"].isNotNull())
    rest = [c for c in items.columns if c not in ("due", "deadline", "application_end", "event_date")]
    return items.select(*rest, F.inline(facts)).withColumn("day", day_text(F.col("date")))


def day_order() -> list[Column]:
    """Within a day: deadlines first, then by time, then the list order of the notices."""
    return [F.col("kind_ord").asc(), F.col("date").asc(), *[c.asc() for c in newest()]]


def events_by_day(events: DataFrame) -> DataFrame:
    """Events with ``pos``, their position inside the day; a day may hold any number of events."""
    return rank_in_group(events, ["day"], day_order(), "id")


def next_event(events: DataFrame, start: date) -> DataFrame:
    """The first event on or after a day."""
    soonest = events.filter(F.col("day") >= start.isoformat())
    return soonest.orderBy("date", *newest(), "kind_ord").limit(1)


def landing_day(items: DataFrame, today: date) -> DataFrame:
    """The day a notice opens on: the earliest upcoming, else the latest past one; and its link."""
    days = F.array_compact(F.array(day_text(F.col("due")), day_text(F.col("event_date"))))
    coming = F.array_min(F.filter(days, lambda d: d >= today.isoformat()))
    landing = F.coalesce(coming, F.array_max(days))
    link = F.concat(
        F.lit("/calendar?month="), F.substring("landing_day", 1, 7), F.lit("&date="), F.col("landing_day"),
        F.lit("&notice="), F.col("id").cast("string"),
    )
    return items.withColumn("landing_day", landing).withColumn("href", link)


def upsert_imported(imports: DataFrame) -> DataFrame:
    """One row per uid: the latest import wins, the place of the first one is kept (``first_seq``)."""
    return imports.groupBy("uid").agg(
        F.max_by(F.struct("title", "date", "all_day"), "seq").alias("v"), F.min("seq").alias("first_seq")
    ).select("uid", "v.title", "v.date", "v.all_day", "first_seq")


def new_uids(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Uids an import adds."""
    return incoming.select("uid").distinct().join(existing.select("uid"), "uid", "left_anti")


def union_days(events: DataFrame, imported: DataFrame) -> DataFrame:
    """Notice events and imported events of every day; notice events come first."""
    ours = events.select(
        "day", F.lit(0).alias("origin"), F.col("kind_ord"), "kind", "date", newest()[0].cast("long").alias("t1"),
        newest()[1].alias("t2"), F.col("id").cast("string").alias("entry"), "title",
    )
    theirs = imported.select(
        day_text(F.col("date")).alias("day"), F.lit(1).alias("origin"), F.lit(0).alias("kind_ord"),
        F.lit("imported").alias("kind"), "date", F.col("first_seq").alias("t1"), F.lit(0).cast("long").alias("t2"),
        F.col("uid").alias("entry"), "title",
    )
    return ours.unionByName(theirs)


UNION_ORDER = ["origin", "kind_ord", "date", "t1", "t2"]


def rank_union(entries: DataFrame) -> DataFrame:
    return rank_in_group(entries, ["day"], [F.col(c).asc() for c in UNION_ORDER], "entry")


def day_chips(entries: DataFrame, chips: int = dims.MAX_CHIPS) -> DataFrame:
    """The first ``chips`` entries of every day and how many more there are."""
    w = Window.partitionBy("day").orderBy(*UNION_ORDER)
    top = entries.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= chips)
    sizes = entries.groupBy("day").agg(F.greatest(F.count("*") - chips, F.lit(0)).alias("more"))
    return top.join(sizes, "day")


def month_agenda(entries: DataFrame, year: int, month: int) -> DataFrame:
    """Entries of the days inside the month, in order."""
    inside = entries.filter(F.substring("day", 1, 7) == f"{year:04d}-{month:02d}")
    return with_global_index(inside, [F.col(c).asc() for c in ["day", *UNION_ORDER]], "pos")


def month_cells(spark: SparkSession, year: int, month: int) -> DataFrame:
    """Whole Sunday-first weeks covering the month: date, day and in_month."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    start = F.date_sub(first, F.dayofweek(first) - 1)
    end = F.date_add(F.last_day(first), F.lit(7) - F.dayofweek(F.last_day(first)))
    cells = spark.range(1).select(F.explode(F.sequence(start, end)).alias("date"))
    return cells.select("date", F.dayofmonth("date").alias("dom"), (F.month("date") == month).alias("in_month"))


def shift_month(month: Column, delta: int) -> Column:
    """``2026-12`` plus months."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), delta), "yyyy-MM")


def month_grid(entries: DataFrame, year: int, month: int) -> DataFrame:
    """The grid with the number of entries on every day, empty days included."""
    sizes = entries.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "deadline").alias("n_deadlines"))
    cells = month_cells(entries.sparkSession, year, month).withColumn("day", F.date_format("date", "yyyy-MM-dd"))
    out = F.broadcast(cells).join(sizes, "day", "left")  # at most 42 cells
    return out.select("day", "dom", "in_month", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_deadlines", F.lit(0)).alias("n_deadlines"))


def deadline_rank(items: DataFrame, today: date) -> DataFrame:
    """Adds ``rank`` and ``rank_days``: open soonest first, then undated, then closed, latest closed first."""
    days = days_until(F.col("due"), today)
    rank = F.when(days.isNull(), 1).when(days >= 0, 0).otherwise(2)
    return items.withColumn("rank", rank).withColumn("rank_days", F.coalesce(F.abs(days), F.lit(0)))


def sort_by_deadline(items: DataFrame, today: date) -> DataFrame:
    ranked = deadline_rank(items, today)
    return with_global_index(ranked, [F.col("rank").asc(), F.col("rank_days").asc(), *[c.asc() for c in newest()]], "pos")


def sort_latest(items: DataFrame) -> DataFrame:
    return with_global_index(items, [c.asc() for c in newest()], "pos")
