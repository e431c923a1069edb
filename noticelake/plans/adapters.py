"""Views that give the TPC-H-like test tables the shape of notices, analyses, profiles and events.

Each view exists twice: as a DataFrame and as the SQL text of a CTE with the same columns.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import text

TODAY_DOCS = date(2026, 9, 8)
TODAY_ORDERS = date(2001, 6, 15)
TODAY_EVENTS = date(2024, 1, 20)
KST = "INTERVAL 9 HOURS"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# --- notices from documents ---------------------------------------------------------------------

def notice_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        "source",
        F.col("doc_id").cast("string").alias("source_notice_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("source_url"),
        text.first_line(F.col("text")).alias("title"),
        F.col("text").alias("original_content"),
        text.content_hash(F.col("text")).alias("content_hash"),
        F.date_add(F.lit(date(2026, 9, 1)), (F.col("doc_id") % 7).cast("int")).alias("published_at"),
        F.col("lang").alias("board_category"),
        F.lit("2026-09-08 00:00:00").cast("timestamp").alias("crawled_at"),
    )


NOTICE_DOCS = """notice_docs AS (
  SELECT doc_id AS id, source, CAST(doc_id AS VARCHAR) AS source_notice_id,
         'https://' || source || '.example.org/' || doc_id AS source_url,
         split_part(text, chr(10), 1) AS title, text AS original_content, sha256(text) AS content_hash,
         CAST(DATE '2026-09-01' + CAST(doc_id % 7 AS INTEGER) AS DATE) AS published_at, lang AS board_category
  FROM documents)"""

DOC_KEYS = r"""keyed AS (
  SELECT id, source, published_at,
         CASE WHEN length(core) >= 6 THEN CASE WHEN grad THEN 'grad:' || core ELSE core END END AS dedup_key
  FROM (SELECT *, regexp_replace(lower(substr(title, length(tags) + 1)), '[^\p{L}\p{N}]', '', 'g') AS core,
               len(list_filter(regexp_extract_all(tags, '(\[[^\]]*\]|\([^)]*\)|【[^】]*】|<[^>]*>|★+|☆+)', 1),
                               lambda t: contains(t, '대학원') AND NOT contains(t, '학부'))) > 0 AS grad
        FROM (SELECT *, regexp_extract(title, '^(\s*(\[[^\]]*\]|\([^)]*\)|【[^】]*】|<[^>]*>|★+|☆+)\s*)+', 0) AS tags
              FROM notice_docs)))"""

DOC_GROUPS = """pairs AS (
  SELECT a.id, b.id AS other FROM keyed a JOIN keyed b
    ON a.dedup_key = b.dedup_key AND a.source <> b.source AND abs(a.published_at - b.published_at) <= 3),
parents AS (SELECT id, min(other) AS parent FROM pairs WHERE other < id GROUP BY id),
climb AS (
  SELECT id, parent AS root FROM parents
  UNION ALL
  SELECT climb.id, parents.parent FROM climb JOIN parents ON climb.root = parents.id),
roots AS (SELECT id, min(root) AS dup_of FROM climb GROUP BY id),
grouped AS (
  SELECT n.*, k.dedup_key, r.dup_of, coalesce(r.dup_of, n.id) AS group_id
  FROM notice_docs n JOIN keyed k USING (id) LEFT JOIN roots r USING (id))"""


def keyed_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = notice_docs(spark, sf)
    return docs.withColumn("dedup_key", text.dedup_key(F.col("title")))


def grouped_docs(spark: SparkSession, sf: str, assigned: DataFrame | None = None) -> DataFrame:
    from noticelake.operators.resolve import with_groups

    return with_groups(keyed_docs(spark, sf), assigned)


# --- the stored state before the crawl ------------------------------------------------------------

PREV_DAY = date(2026, 9, 7)


def notice_prev(spark: SparkSession, sf: str) -> DataFrame:
    """What an earlier crawl stored: notices of earlier days, some with another title or body."""
    docs = notice_docs(spark, sf).filter(F.col("published_at") < F.lit(PREV_DAY))
    body = F.when(F.col("id") % 5 == 3, F.concat("original_content", F.lit(" old"))).otherwise(F.col("original_content"))
    docs = docs.withColumns({
        "title": F.when(F.col("id") % 11 == 4, F.concat(F.lit("old "), "title")).otherwise(F.col("title")),
        "original_content": body,
        "content_hash": text.content_hash(body),
        "crawled_at": F.lit("2026-09-07 00:00:00").cast("timestamp"),
    })
    return docs.withColumns({
        "content_updated_at": F.lit(None).cast("timestamp"),
        "dup_of": F.lit(None).cast("long"),
    })


NOTICE_PREV = """notice_prev AS (
  SELECT id, source, source_notice_id, source_url, published_at, board_category,
         CASE WHEN id % 11 = 4 THEN 'old ' || title ELSE title END AS title,
         CASE WHEN id % 5 = 3 THEN original_content || ' old' ELSE original_content END AS original_content,
         sha256(CASE WHEN id % 5 = 3 THEN original_content || ' old' ELSE original_content END) AS content_hash
  FROM notice_docs WHERE published_at < DATE '2026-09-07')"""


# --- analyses of documents -------------------------------------------------------------------------

def analysis_docs(spark: SparkSession, sf: str) -> DataFrame:
    second = F.col("doc_id") % 3 == 0
    # hashed before the join, so that no text is shuffled; only versions of stale rows have the other hash
    edited = F.when((F.col("doc_id") % 5 == 0) | (second & ((F.col("doc_id") + 1) % 5 == 0)), F.sha2(F.concat("text", F.lit(" (edited)")), 256))
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("_hash"), edited.alias("_edited"))
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    versions = F.when(second, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("v", F.explode(versions))
    stale = (F.col("doc_id") + F.col("v")) % 5 == 0
    return rows.select(
        (F.col("doc_id") * 10 + F.col("v")).alias("analysis_id"),
        F.col("doc_id").alias("notice_id"),
        F.when((F.col("doc_id") + F.col("v")) % 4 == 0, "v2").otherwise("v3").alias("prompt_version"),
        F.when(F.col("toxic") == 1, "other").when(F.col("quality") == 1, "academic").otherwise("recruitment").alias("category"),
        F.when(stale, F.col("_edited")).otherwise(F.col("_hash")).alias("content_hash"),
        F.when(F.col("doc_id") % 4 != 1, _day_text((F.col("doc_id") * 7 + F.col("v")) % 30)).alias("deadline"),
        F.when(F.col("doc_id") % 5 != 2, _day_text(F.col("doc_id") % 25)).alias("application_end"),
        F.when(F.col("doc_id") % 3 == 1, _day_text(F.col("doc_id") % 20 + 4)).alias("event_date"),
    )


def _day_text(offset: Column) -> Column:
    return F.date_format(F.date_add(F.lit(date(2026, 9, 1)), offset.cast("int")), "yyyy-MM-dd")


ANALYSIS_DOCS = """analysis_docs AS (
  SELECT doc_id * 10 + v AS analysis_id, doc_id AS notice_id,
         CASE WHEN (doc_id + v) % 4 = 0 THEN 'v2' ELSE 'v3' END AS prompt_version,
         CASE WHEN toxic = 1 THEN 'other' WHEN quality = 1 THEN 'academic' ELSE 'recruitment' END AS category,
         sha256(CASE WHEN (doc_id + v) % 5 = 0 THEN text || ' (edited)' ELSE text END) AS content_hash,
         CASE WHEN doc_id % 4 <> 1 THEN strftime(DATE '2026-09-01' + CAST((doc_id * 7 + v) % 30 AS INTEGER), '%Y-%m-%d') END AS deadline,
         CASE WHEN doc_id % 5 <> 2 THEN strftime(DATE '2026-09-01' + CAST(doc_id % 25 AS INTEGER), '%Y-%m-%d') END AS application_end,
         CASE WHEN doc_id % 3 = 1 THEN strftime(DATE '2026-09-05' + CAST(doc_id % 20 AS INTEGER), '%Y-%m-%d') END AS event_date
  FROM labels JOIN documents USING (doc_id)
  JOIN (VALUES (0), (1)) t(v) ON v = 0 OR doc_id % 3 = 0)"""

DOC_CATEGORIES = ["academic", "recruitment", "event", "other"]

DOC_LATEST = """latest AS (
  SELECT n.*, a.analysis_id, a.category, a.prompt_version, a.deadline, a.application_end, a.event_date,
         CASE WHEN a.analysis_id IS NULL THEN 'pending'
              WHEN a.content_hash IS NOT DISTINCT FROM n.content_hash THEN 'ready' ELSE 'stale' END AS status
  FROM grouped n LEFT JOIN analysis_docs a
    ON a.analysis_id = (SELECT max(x.analysis_id) FROM analysis_docs x WHERE x.notice_id = n.id))"""


# --- boards ------------------------------------------------------------------------------------------

def board_dim(spark: SparkSession, sf: str) -> DataFrame:
    boards = table(spark, sf, "documents").select("source").distinct()
    ord_ = F.substring("source", 4, 9).cast("int")
    region = table(spark, sf, "region").select(F.col("r_regionkey"), F.col("r_name"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey"), F.col("n_name"))
    boards = boards.withColumn("ord", ord_)
    out = boards.join(F.broadcast(region), F.col("r_regionkey") == F.col("ord") % 5, "left")
    out = out.join(F.broadcast(nation), F.col("n_nationkey") == F.col("ord"), "left")
    return out.select(
        "source",
        F.concat(F.lit("b"), F.col("ord").cast("string")).alias("alias"),
        "ord",
        F.when(F.col("ord") == 0, "main").when(F.col("ord") <= 5, "college").otherwise("department").alias("kind"),
        F.when(F.col("ord") > 0, F.col("r_name")).alias("college"),
        F.when(F.col("ord") > 5, F.col("n_name")).alias("major"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/")).alias("url_prefix"),
        F.when(F.col("ord") > 0, 10).alias("default_limit"),
    )


BOARD_DIM = """board_dim AS (
  SELECT source, 'b' || ord AS alias, ord,
         CASE WHEN ord = 0 THEN 'main' WHEN ord <= 5 THEN 'college' ELSE 'department' END AS kind,
         CASE WHEN ord > 0 THEN r_name END AS college, CASE WHEN ord > 5 THEN n_name END AS major,
         'https://' || source || '.example.org/' AS url_prefix
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS ord FROM documents) s
  LEFT JOIN region ON r_regionkey = ord % 5 LEFT JOIN nation ON n_nationkey = ord)"""


# --- notices, analyses and profiles from orders -----------------------------------------------------

ORDER_CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# interest -> (categories, title keyword pattern)
ORDER_INTERESTS = {
    "AUTOMOBILE": (["1-URGENT"], "9 \\["),
    "BUILDING": (["2-HIGH"], "0 \\["),
    "FURNITURE": ([], "5 \\["),
    "HOUSEHOLD": (["3-MEDIUM", "5-LOW"], "4 \\["),
    "MACHINERY": ([], "(3|7) \\["),
}


def order_target(n_name: Column, r_name: Column, key: Column, cust: Column) -> Column:
    year = (cust % 4 + 1).cast("string")
    pick = key % 12
    return (
        F.when(pick == 0, F.concat(n_name, F.lit(" "), year, F.lit("학년 이상 재학생")))
        .when(pick == 1, F.concat(n_name, F.lit(", NATION_1 학생")))
        .when(pick == 2, F.concat(r_name, F.lit(" 소속 학생")))
        .when(pick == 3, F.lit("학부 재학생 전체"))
        .when(pick == 4, F.lit("대학원생"))
        .when(pick == 5, F.concat(((cust % 6) + 1).cast("string"), F.lit("학기 이상 이수한 재학생")))
        .when(pick == 6, F.concat(F.lit("학부생 ("), year, F.lit("학년 불가)")))
        .when(pick == 7, F.concat(F.lit("1, "), year, F.lit("학년 제외한 재학생")))
        .when(pick == 8, F.concat(F.lit("1~"), year, F.lit("학년 및 졸업 예정자")))
        .when(pick == 9, F.concat(F.lit("0"), (cust % 3).cast("string"), F.lit("학번 재학생")))
        .when(pick == 10, F.concat(r_name, F.lit(" "), year, F.lit("학년")))
        .otherwise(F.lit("참가 희망자"))
    )


ORDER_TARGET = """CASE o_orderkey % 12
  WHEN 0 THEN n_name || ' ' || (o_custkey % 4 + 1) || '학년 이상 재학생'
  WHEN 1 THEN n_name || ', NATION_1 학생'
  WHEN 2 THEN r_name || ' 소속 학생'
  WHEN 3 THEN '학부 재학생 전체'
  WHEN 4 THEN '대학원생'
  WHEN 5 THEN (o_custkey % 6 + 1) || '학기 이상 이수한 재학생'
  WHEN 6 THEN '학부생 (' || (o_custkey % 4 + 1) || '학년 불가)'
  WHEN 7 THEN '1, ' || (o_custkey % 4 + 1) || '학년 제외한 재학생'
  WHEN 8 THEN '1~' || (o_custkey % 4 + 1) || '학년 및 졸업 예정자'
  WHEN 9 THEN '0' || (o_custkey % 3) || '학번 재학생'
  WHEN 10 THEN r_name || ' ' || (o_custkey % 4 + 1) || '학년'
  ELSE '참가 희망자' END"""


def customer_units(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    units = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return customer.join(F.broadcast(units), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_mktsegment", "n_name", "r_name"
    )


def notice_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    units = customer_units(spark, sf).select("c_custkey", "n_name", "r_name")
    rows = orders.join(units, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("board"), (F.col("o_custkey") % 7).cast("string")).alias("source"),
        F.col("o_orderkey").cast("string").alias("source_notice_id"),
        F.concat(F.lit("https://board.example.org/"), F.col("o_orderkey").cast("string")).alias("source_url"),
        F.concat(F.lit("Notice "), F.col("o_orderkey").cast("string"), F.lit(" ["), "n_name", F.lit("]")).alias("title"),
        F.to_date("o_orderdate").alias("published_at"),
        F.col("o_orderpriority").alias("category"),
        order_target(F.col("n_name"), F.col("r_name"), F.col("o_orderkey"), F.col("o_custkey")).alias("target"),
    )


NOTICE_ORDERS = f"""notice_orders AS (
  SELECT o_orderkey AS id, 'board' || (o_custkey % 7) AS source, CAST(o_orderkey AS VARCHAR) AS source_notice_id,
         'https://board.example.org/' || o_orderkey AS source_url,
         'Notice ' || o_orderkey || ' [' || n_name || ']' AS title, CAST(o_orderdate AS DATE) AS published_at,
         o_orderpriority AS category, {ORDER_TARGET} AS target
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def order_boards(spark: SparkSession, sf: str) -> DataFrame:
    """Seven boards: one main, one per even region, department boards of nations 3, 4 and 5."""
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    units = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    ord_ = F.col("n_nationkey").cast("int")
    return units.filter(F.col("n_nationkey") < 7).select(
        F.concat(F.lit("board"), ord_.cast("string")).alias("source"),
        F.concat(F.lit("b"), ord_.cast("string")).alias("alias"),
        ord_.alias("ord"),
        F.when(ord_ == 0, "main").when(ord_ <= 2, "college").otherwise("department").alias("kind"),
        F.when(ord_ > 0, F.col("r_name")).alias("college"),
        F.when(ord_ > 2, F.col("n_name")).alias("major"),
    )


ORDER_BOARDS = """order_boards AS (
  SELECT 'board' || n_nationkey AS source, n_nationkey AS ord,
         CASE WHEN n_nationkey = 0 THEN 'main' WHEN n_nationkey <= 2 THEN 'college' ELSE 'department' END AS kind,
         CASE WHEN n_nationkey > 0 THEN r_name END AS college, CASE WHEN n_nationkey > 2 THEN n_name END AS major
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 7)"""


VERSION = ["l_linenumber", "l_partkey", "l_suppkey"]


def analysis_dates(lines: DataFrame) -> dict[str, Column]:
    """The dates an analysis (a line item) states."""
    clock = F.when(
        F.col("l_partkey") % 3 == 0, F.concat(F.lit("T"), F.lpad((F.col("l_linenumber") + 8).cast("string"), 2, "0"), F.lit(":00"))
    ).otherwise("")

    def when(days: int) -> Column:
        return F.concat(F.date_format(F.date_add(F.to_date("l_shipdate"), days), "yyyy-MM-dd"), clock)

    return {
        "deadline": F.when(F.col("l_returnflag") == "N", when(0)),
        "application_end": F.when(F.col("l_returnflag") != "R", when(0)),
        "event_date": F.when(F.col("l_linestatus") == "O", when(7)),
    }


ANALYSIS_ORDERS = """analysis_orders AS (
  SELECT l_orderkey AS notice_id, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_returnflag = 'N' THEN strftime(l_shipdate, '%Y-%m-%d') || clock END AS deadline,
         CASE WHEN l_returnflag <> 'R' THEN strftime(l_shipdate, '%Y-%m-%d') || clock END AS application_end,
         CASE WHEN l_linestatus = 'O' THEN strftime(l_shipdate + INTERVAL 7 DAY, '%Y-%m-%d') || clock END AS event_date
  FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN 'T' || lpad(CAST(l_linenumber + 8 AS VARCHAR), 2, '0') || ':00' ELSE '' END AS clock
        FROM lineitem))"""

ORDER_ITEMS = """order_latest AS (
  SELECT notice_id, deadline, application_end, event_date FROM (
    SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn
    FROM analysis_orders) WHERE rn = 1),
order_items AS (
  SELECT n.id, n.source, n.source_notice_id, n.source_url, n.title, n.published_at,
         CASE WHEN a.notice_id IS NOT NULL THEN n.category END AS category,
         CASE WHEN a.notice_id IS NOT NULL THEN n.target END AS target,
         a.deadline, a.application_end, a.event_date, coalesce(a.deadline, a.application_end) AS due,
         a.notice_id IS NOT NULL AS has_analysis
  FROM notice_orders n LEFT JOIN order_latest a ON a.notice_id = n.id)"""


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    """List items: every order-notice with its newest analysis; notices without one are pending."""
    from noticelake.operators.views import latest_version

    lines = table(spark, sf, "lineitem").select("l_orderkey", *VERSION, "l_returnflag", "l_linestatus", "l_shipdate")
    # the newest version is found on raw columns; dates are rendered for the survivors only
    last = latest_version(lines, "l_orderkey", F.struct(*VERSION), [*VERSION, "l_returnflag", "l_linestatus", "l_shipdate"])
    last = last.select(
        F.col("l_orderkey").alias("id"), F.lit(True).alias("_has"), *[c.alias(n) for n, c in analysis_dates(last).items()]
    )
    rows = notice_orders(spark, sf).join(last, "id", "left")
    has = F.col("_has").isNotNull()
    return rows.withColumns({
        "has_analysis": has,
        "category": F.when(has, F.col("category")),
        "target": F.when(has, F.col("target")),
        "due": F.coalesce("deadline", "application_end"),
    }).drop("_has")


def profile_customers(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    second = F.when(c % 3 == 0, F.array(F.lit("BUILDING"))).otherwise(F.array().cast("array<string>"))
    return customer_units(spark, sf).select(
        c.cast("string").alias("profile_id"),
        F.col("r_name").alias("college"),
        F.col("n_name").alias("major"),
        (c % 4 + 1).cast("int").alias("year"),
        (F.lit(2001) - c % 4).cast("int").alias("entrance_year"),
        F.array_distinct(F.concat(F.array("c_mktsegment"), second)).alias("interests"),
    )


PROFILES = """profiles AS (
  SELECT CAST(c_custkey AS VARCHAR) AS profile_id, r_name AS college, n_name AS major,
         CAST(c_custkey % 4 + 1 AS INTEGER) AS year, CAST(2001 - c_custkey % 4 AS INTEGER) AS entrance_year,
         CASE WHEN c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING' THEN [c_mktsegment, 'BUILDING'] ELSE [c_mktsegment] END AS interests
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# --- events ------------------------------------------------------------------------------------------

def imported_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    stamp = F.date_format(F.expr(f"ts + {KST}"), "yyyy-MM-dd'T'HH:mm")
    all_day = F.col("event_id") % 4 == 0
    return events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("uid"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("title"),
        F.when(all_day, F.substring(stamp, 1, 10)).otherwise(stamp).alias("date"),
        all_day.alias("all_day"),
    )


IMPORTED = """imported AS (
  SELECT user_id || '-' || event_type AS uid, event_id AS seq, event_type AS title,
         CASE WHEN event_id % 4 = 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d')
              ELSE strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M') END AS date,
         event_id % 4 = 0 AS all_day
  FROM events)"""


def listed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"),
        (F.col("event_id") % 200).cast("string").alias("source_notice_id"),
        F.col("event_id").alias("pos"),
        (F.col("event_type") == "signup").alias("pinned"),
        F.to_date("ts").alias("listed_date"),
    )


LISTED = """listed AS (
  SELECT 'src' || (user_id % 20) AS source, CAST(event_id % 200 AS VARCHAR) AS source_notice_id, event_id AS pos,
         event_type = 'signup' AS pinned, CAST(ts AS DATE) AS listed_date
  FROM events)"""
