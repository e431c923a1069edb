"""Queries over deadlines, events and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import dates
from noticelake.operators import calendar as cal
from noticelake.plans import adapters as ad
from noticelake.plans.adapters import ctes
from noticelake.plans.registry import query
from noticelake.sources import calendar_files as files

ITEMS = (ad.NOTICE_ORDERS, ad.ANALYSIS_ORDERS, ad.ORDER_ITEMS)
EVENTS = """evs AS (
  SELECT id, source_notice_id, source_url, title, published_at, 'deadline' AS kind, 0 AS kind_ord, due AS date, substr(due, 1, 10) AS day
  FROM order_items WHERE due IS NOT NULL
  UNION ALL
  SELECT id, source_notice_id, source_url, title, published_at, 'event', 1, event_date, substr(event_date, 1, 10)
  FROM order_items WHERE event_date IS NOT NULL)"""
WITH_EVENTS = (*ITEMS, EVENTS)
UPSERTED = """kept_imports AS (
  SELECT uid, arg_max(title, seq) AS title, arg_max(date, seq) AS date, arg_max(all_day, seq) AS all_day, min(seq) AS first_seq
  FROM imported GROUP BY uid)"""
# imported events live in 2024; they are moved to the month the notices are in
ENTRIES = """entries AS (
  SELECT day, 0 AS origin, kind_ord, kind, date, datediff('day', published_at, DATE '1970-01-01') AS t1, -id AS t2,
         CAST(id AS VARCHAR) AS entry, title FROM evs
  UNION ALL
  SELECT substr(d, 1, 10), 1, 0, 'imported', d, first_seq, 0, uid, title
  FROM (SELECT *, '2001-06' || substr(date, 8) AS d FROM kept_imports)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY origin, kind_ord, date, t1, t2) AS pos,
                  count(*) OVER (PARTITION BY day) AS n FROM entries)"""
WITH_ENTRIES = (*WITH_EVENTS, ad.IMPORTED, UPSERTED, ENTRIES)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return cal.unpivot_events(ad.order_items(spark, sf))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    imports = cal.upsert_imported(ad.imported_events(spark, sf))
    moved = imports.withColumn("date", F.concat(F.lit("2001-06"), F.expr("substring(date, 8)")))
    return cal.union_days(events(spark, sf), moved)


@query("event_unpivot", ctes(*WITH_EVENTS) + "SELECT id, kind, date, day FROM evs")
def _(spark, sf):
    return events(spark, sf).select("id", "kind", "date", "day")


@query(
    "effective_deadline",
    ctes(*ITEMS) + "SELECT id, coalesce(due, '-') AS due, has_analysis FROM order_items",
)
def _(spark, sf):
    return ad.order_items(spark, sf).select("id", F.coalesce("due", F.lit("-")).alias("due"), "has_analysis")


@query(
    "events_by_day",
    ctes(*WITH_EVENTS)
    + """SELECT day, id, kind, date, row_number() OVER (PARTITION BY day ORDER BY kind_ord, date, published_at DESC, id DESC) AS pos FROM evs""",
)
def _(spark, sf):
    return cal.events_by_day(events(spark, sf)).select("day", "id", "kind", "date", "pos")


@query(
    "next_event",
    ctes(*WITH_EVENTS) + "SELECT id, kind, date FROM evs WHERE day >= '2001-06-15' ORDER BY date, published_at DESC, id DESC, kind_ord LIMIT 1",
)
def _(spark, sf):
    return cal.next_event(events(spark, sf), ad.TODAY_ORDERS).select("id", "kind", "date")


@query(
    "landing_day",
    ctes(*WITH_EVENTS)
    + """SELECT i.id, coalesce(min(e.day) FILTER (e.day >= '2001-06-15'), max(e.day), '-') AS landing_day,
  coalesce('/calendar?month=' || substr(coalesce(min(e.day) FILTER (e.day >= '2001-06-15'), max(e.day)), 1, 7) || '&date='
    || coalesce(min(e.day) FILTER (e.day >= '2001-06-15'), max(e.day)) || '&notice=' || i.id, '-') AS href
FROM order_items i LEFT JOIN evs e USING (id) GROUP BY i.id""",
)
def _(spark, sf):
    out = cal.landing_day(ad.order_items(spark, sf), ad.TODAY_ORDERS)
    return out.select("id", F.coalesce("landing_day", F.lit("-")).alias("landing_day"), F.coalesce("href", F.lit("-")).alias("href"))


@query("day_union", ctes(*WITH_ENTRIES) + "SELECT day, kind, entry, date, pos FROM ranked")
def _(spark, sf):
    return cal.rank_union(entries(spark, sf)).select("day", "kind", "entry", "date", "pos")


@query("day_topk", ctes(*WITH_ENTRIES) + "SELECT day, kind, entry, pos, greatest(n - 3, 0) AS more FROM ranked WHERE pos <= 3")
def _(spark, sf):
    return cal.day_chips(entries(spark, sf)).select("day", "kind", "entry", "pos", "more")


@query(
    "month_agenda",
    ctes(*WITH_ENTRIES)
    + """SELECT day, kind, entry, row_number() OVER (ORDER BY day, origin, kind_ord, date, t1, t2) - 1 AS pos FROM ranked WHERE substr(day, 1, 7) = '2001-06'""",
)
def _(spark, sf):
    return cal.month_agenda(entries(spark, sf), 2001, 6).select("day", "kind", "entry", "pos")


@query(
    "month_grid",
    ctes(*WITH_ENTRIES, """cells AS (
  SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '2001-05-27', DATE '2001-06-30', INTERVAL 1 DAY) t(d))""")
    + """SELECT strftime(c.d, '%Y-%m-%d') AS day, day(c.d) AS dom, month(c.d) = 6 AS in_month, count(e.day) AS n,
  count(e.day) FILTER (e.kind = 'deadline') AS n_deadlines
FROM cells c LEFT JOIN entries e ON e.day = strftime(c.d, '%Y-%m-%d') GROUP BY c.d""",
)
def _(spark, sf):
    return cal.month_grid(entries(spark, sf), 2001, 6)


@query(
    "imported_upsert",
    ctes(ad.IMPORTED, UPSERTED)
    + """SELECT uid, title, date, all_day, first_seq, NOT EXISTS (SELECT 1 FROM imported i WHERE i.uid = k.uid AND i.date < '2024-01-20') AS is_new
FROM kept_imports k""",
)
def _(spark, sf):
    """All imports so far; ``is_new`` marks uids the imports since 2024-01-20 added."""
    rows = ad.imported_events(spark, sf)
    early, late = rows.filter(F.col("date") < "2024-01-20"), rows.filter(F.col("date") >= "2024-01-20")
    added = cal.new_uids(late, early).withColumn("added", F.lit(True))
    out = cal.upsert_imported(rows).join(added, "uid", "left")
    return out.select("uid", "title", "date", "all_day", "first_seq", F.col("added").isNotNull().alias("is_new"))


@query(
    "sort_deadline",
    ctes(*ITEMS)
    + """, r AS (SELECT id, published_at, CAST(substr(due, 1, 10) AS DATE) - DATE '2001-06-15' AS days FROM order_items)
SELECT id, CASE WHEN days IS NULL THEN 1 WHEN days >= 0 THEN 0 ELSE 2 END AS rank, coalesce(abs(days), 0) AS rank_days,
  row_number() OVER (ORDER BY CASE WHEN days IS NULL THEN 1 WHEN days >= 0 THEN 0 ELSE 2 END, coalesce(abs(days), 0), published_at DESC, id DESC) - 1 AS pos FROM r""",
)
def _(spark, sf):
    return cal.sort_by_deadline(ad.order_items(spark, sf), ad.TODAY_ORDERS).select("id", "rank", "rank_days", "pos")


@query(
    "sort_latest",
    ctes(ad.NOTICE_ORDERS) + "SELECT id, row_number() OVER (ORDER BY published_at DESC, id DESC) - 1 AS pos FROM notice_orders",
)
def _(spark, sf):
    return cal.sort_latest(ad.notice_orders(spark, sf)).select("id", "pos")


CSV_SQL = """SELECT '[' || CASE WHEN kind = 'deadline' THEN '신청 마감' ELSE '행사 일정' END || '] ' || title AS "Subject",
  d AS "Start Date", t AS "Start Time", d AS "End Date", t AS "End Time", CASE WHEN length(date) > 10 THEN 'False' ELSE 'True' END AS "All Day Event",
  'AI가 공지에서 추출한 날짜예요. 반드시 원문에서 확인하세요. 원문: ' || source_url AS "Description", '' AS "Location", 'False' AS "Private"
FROM (SELECT *, strftime(CAST(day AS DATE), '%-m/%-d/%Y') AS d,
        CASE WHEN length(date) > 10 THEN strftime(CAST(date AS TIMESTAMP), '%-I:%M %p') ELSE '' END AS t FROM evs)"""


@query("export_csv_rows", ctes(*WITH_EVENTS) + CSV_SQL)
def _(spark, sf):
    return files.csv_rows(events(spark, sf))


STAMP = "20010615T000000Z"
UID_DOMAIN = "notices.example.org"
ICS_SQL = """ics AS (
  SELECT id, kind, date, 'notice-' || source_notice_id || '-' || kind || '@notices.example.org' AS uid,
   '[' || CASE WHEN kind = 'deadline' THEN '신청 마감' ELSE '행사 일정' END || '] ' || title AS subject, source_url,
   CASE WHEN length(date) > 10 THEN
     'DTSTART:' || strftime(CAST(date AS TIMESTAMP) - INTERVAL 9 HOUR, '%Y%m%dT%H%M%SZ') || chr(13) || chr(10) ||
     'DTEND:' || strftime(CAST(date AS TIMESTAMP) - INTERVAL 8 HOUR, '%Y%m%dT%H%M%SZ')
   ELSE 'DTSTART;VALUE=DATE:' || strftime(CAST(day AS DATE), '%Y%m%d') || chr(13) || chr(10) ||
     'DTEND;VALUE=DATE:' || strftime(CAST(day AS DATE) + INTERVAL 1 DAY, '%Y%m%d') END AS span FROM evs)"""


BLOCK_SQL = r"""SELECT id, kind, replace('BEGIN:VEVENT|UID:' || uid || '|DTSTAMP:20010615T000000Z|' || span || '|SUMMARY:' || subject
  || '|DESCRIPTION:AI가 공지에서 추출한 날짜예요. 반드시 원문에서 확인하세요.\n원문: ' || source_url || '|URL:' || source_url || '|END:VEVENT', '|', chr(13) || chr(10)) AS block FROM ics"""


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return files.ics_blocks(events(spark, sf), STAMP, "notice", UID_DOMAIN)


@query(
    "export_ics_blocks",
    ctes(*WITH_EVENTS, ICS_SQL) + BLOCK_SQL,
)
def _(spark, sf):
    return blocks(spark, sf).select("id", "kind", "block")


# characters are added one by one: a line has 75 octets at most, the blank of a folded one included
FOLDED_SQL = r"""SELECT id, kind, array_to_string(list_transform(string_split(block, chr(13) || chr(10)), lambda line:
  list_reduce(list_transform(string_split(line, ''), lambda c: {'o': c, 'u': strlen(c)}), lambda acc, x:
    {'o': acc.o || CASE WHEN acc.u + x.u > 75 THEN chr(13) || chr(10) || ' ' ELSE '' END || x.o, 'u': CASE WHEN acc.u + x.u > 75 THEN 1 + x.u ELSE acc.u + x.u END}).o), chr(13) || chr(10)) AS block
FROM (""" + BLOCK_SQL + ")"


@query("export_ics_folded", ctes(*WITH_EVENTS, ICS_SQL) + FOLDED_SQL)
def _(spark, sf):
    return blocks(spark, sf).select("id", "kind", files.ics_fold(F.col("block")).alias("block"))


@query(
    "ics_import",
    ctes(*WITH_EVENTS, ICS_SQL) + "SELECT id, uid, subject AS title, date, length(date) = 10 AS all_day FROM ics",
)
def _(spark, sf):
    """Round trip: every event is written as a folded calendar and read back."""
    text = files.calendar_text(files.ics_fold(F.col("block")), "-//Notices//KO")
    out = files.parse_ics(blocks(spark, sf).select("id", text.alias("text")))
    return out.select("id", "uid", "title", "date", "all_day")


# --- scalar date functions over the event dates -------------------------------------------------------------

@query(
    "fn_parse_date",
    r"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def _(spark, sf):
    written = F.when(F.col("o_orderkey") % 7 == 0, "미정").otherwise(F.date_format("o_orderdate", "'작성일 'yyyy.M. d."))
    rows = ad.table(spark, sf, "orders").select("o_orderkey", written.alias("written"))
    return rows.select("o_orderkey", F.coalesce(dates.dotted_date(F.col("written")), F.lit("-")).alias("day"))


@query(
    "fn_kst_day",
    "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day FROM events",
)
def _(spark, sf):
    rows = ad.table(spark, sf, "events")
    return rows.select("event_id", F.date_format(dates.seoul_day(F.col("ts").cast("timestamp")), "yyyy-MM-dd").alias("day"))


@query(
    "fn_days",
    ctes(*ITEMS)
    + """SELECT id, CAST(substr(due, 1, 10) AS DATE) - DATE '2001-06-15' AS days_left, abs(CAST(substr(due, 1, 10) AS DATE) - published_at) AS apart
FROM order_items WHERE due IS NOT NULL""",
)
def _(spark, sf):
    rows = ad.order_items(spark, sf).filter("due is not null")
    return rows.select(
        "id", dates.days_until(F.col("due"), ad.TODAY_ORDERS).alias("days_left"),
        dates.days_apart(dates.day(F.col("due")), F.col("published_at")).alias("apart"),
    )


@query(
    "fn_dday",
    ctes(*WITH_EVENTS)
    + """, d AS (SELECT id, kind, CAST(day AS DATE) - DATE '2001-06-15' AS n FROM evs)
SELECT id, kind, CASE WHEN n < 0 THEN '마감' WHEN n = 0 THEN 'D-DAY' ELSE 'D-' || n END AS label,
  CASE WHEN n < 0 THEN 'Closed' WHEN n = 0 THEN 'D-DAY' ELSE 'D-' || n END AS label_en,
  CASE WHEN n < 0 THEN 'closed' WHEN n <= 2 THEN 'urgent' WHEN n <= 7 THEN 'soon' ELSE 'open' END AS tone FROM d""",
)
def _(spark, sf):
    when = F.col("date")
    return events(spark, sf).select(
        "id", "kind", dates.dday_label(when, ad.TODAY_ORDERS).alias("label"),
        dates.dday_label(when, ad.TODAY_ORDERS, "en").alias("label_en"), dates.dday_tone(when, ad.TODAY_ORDERS).alias("tone"),
    )


SHORT_SQL = """lab AS (
  SELECT id, kind, day, strftime(CAST(day AS DATE), '%m.%d') || '(' || ['일','월','화','수','목','금','토'][dayofweek(CAST(day AS DATE)) + 1] || ')' || c AS ko,
    strftime(CAST(day AS DATE), '%b %-d (%a)') || c AS en
  FROM (SELECT *, CASE WHEN length(date) > 10 THEN ' ' || substr(date, 12, 5) ELSE '' END AS c FROM evs)),
both_dates AS (
  SELECT i.id, d.ko AS dko, d.en AS den, e.ko AS eko, e.en AS een, d.day FROM order_items i
  LEFT JOIN lab d ON d.id = i.id AND d.kind = 'deadline' LEFT JOIN lab e ON e.id = i.id AND e.kind = 'event')"""


@query(
    "fn_date_labels",
    ctes(*WITH_EVENTS, SHORT_SQL)
    + """SELECT id, coalesce(dko, '-') AS short_ko, coalesce(den, '-') AS short_en,
  coalesce(strftime(CAST(day AS DATE), '%Y년 %-m월 %-d일'), '-') AS full_ko, coalesce(strftime(CAST(day AS DATE), '%B %-d, %Y'), '-') AS full_en,
  CASE WHEN dko IS NOT NULL AND eko IS NOT NULL THEN dko || ' – ' || eko WHEN eko IS NOT NULL THEN '~ ' || eko WHEN dko IS NOT NULL THEN dko || ' ~' ELSE '-' END AS period_ko,
  CASE WHEN den IS NOT NULL AND een IS NOT NULL THEN den || ' – ' || een WHEN een IS NOT NULL THEN '~ ' || een WHEN den IS NOT NULL THEN den || ' ~' ELSE '-' END AS period_en
FROM both_dates""",
)
def _(spark, sf):
    due, ev, none = F.col("due"), F.col("event_date"), F.lit("-")
    return ad.order_items(spark, sf).select(
        "id",
        *[F.coalesce(dates.short_date(due, lang), none).alias(f"short_{lang}") for lang in ("ko", "en")],
        *[F.coalesce(dates.full_date(due, lang), none).alias(f"full_{lang}") for lang in ("ko", "en")],
        *[F.coalesce(dates.period(due, ev, lang), none).alias(f"period_{lang}") for lang in ("ko", "en")],
    )


@query(
    "fn_csv_dates",
    r"""SELECT event_id, strftime(ts, '%-m/%-d/%Y') AS day, strftime(ts, '%-I:%M %p') AS clock, '"' || replace(props, '"', '""') || '"' AS field FROM events""",
)
def _(spark, sf):
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    return ad.table(spark, sf, "events").select(
        "event_id", dates.csv_day(when).alias("day"), dates.csv_clock(when).alias("clock"), files.csv_field(F.col("props")).alias("field")
    )


@query(
    "fn_ics_dates",
    ctes(*WITH_EVENTS)
    + """SELECT id, kind, strftime(CAST(day AS DATE), '%Y%m%d') AS day, strftime(CAST(day AS DATE) + INTERVAL 1 DAY, '%Y%m%d') AS next_day,
  CASE WHEN length(date) > 10 THEN strftime(CAST(date AS TIMESTAMP) - INTERVAL 9 HOUR, '%Y%m%dT%H%M%SZ') ELSE '-' END AS utc,
  CASE WHEN length(date) > 10 THEN strftime(CAST(date AS TIMESTAMP) - INTERVAL 8 HOUR, '%Y%m%dT%H%M%SZ') ELSE '-' END AS utc_end FROM evs""",
)
def _(spark, sf):
    when, none = F.col("date"), F.lit("-")
    return events(spark, sf).select(
        "id", "kind", dates.ics_day(when).alias("day"), dates.ics_day(when, 1).alias("next_day"),
        F.coalesce(dates.ics_utc(when), none).alias("utc"), F.coalesce(dates.ics_utc(when, 1), none).alias("utc_end"),
    )


@query(
    "fn_entrance_year",
    ctes(ad.PROFILES) + "SELECT profile_id, 2001 - year + 1 AS entrance_year FROM profiles",
)
def _(spark, sf):
    rows = ad.profile_customers(spark, sf)
    return rows.select("profile_id", dates.entrance_year(F.col("year"), ad.TODAY_ORDERS).alias("entrance_year"))
