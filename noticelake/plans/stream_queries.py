"""Streaming jobs over the landed tables, run until everything available is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import text
from noticelake.plans import adapters as ad
from noticelake.plans import store_queries as store
from noticelake.plans.adapters import ctes
from noticelake.plans.registry import query
from noticelake.session import scratch_dir
from noticelake.streaming import jobs


def landed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder of them: both match the pattern."""
    schema = ad.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _crawl(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"),
        (F.col("event_id") % 200).cast("string").alias("source_notice_id"),
        F.col("event_type").alias("title"), F.sha2(F.col("props"), 256).alias("content_hash"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("ts").cast("timestamp").alias("crawled_at"), F.col("event_id").alias("pos"),
    )


@query(
    "stream_upsert",
    ctes("""crawl AS (
  SELECT 'src' || (user_id % 20) AS source, CAST(event_id % 200 AS VARCHAR) AS source_notice_id, event_type AS title, sha256(props) AS content_hash, ts, event_id AS pos FROM events),
newest AS (SELECT *, row_number() OVER (PARTITION BY source, source_notice_id ORDER BY ts DESC, pos DESC) AS rn FROM crawl)""")
    + "SELECT source, source_notice_id, title, content_hash, row_number() OVER (ORDER BY pos) - 1 AS id FROM newest WHERE rn = 1",
)
def _(spark, sf):
    path = scratch_dir(spark, "upsert")
    crawled = _crawl(landed(spark, sf, "events")).drop("ts")
    jobs.stream_upsert(crawled, path, ["pos"], buckets=16).awaitTermination()
    state = jobs.upsert_store(spark, path, crawled.schema, buckets=16).snapshot()
    return state.select("source", "source_notice_id", "title", "content_hash", "id")


@query(
    "stream_dedup",
    """SELECT DISTINCT 'src' || (user_id % 20) AS source, CAST(event_id % 200 AS VARCHAR) AS source_notice_id FROM events""",
)
def _(spark, sf):
    """One landed file is one micro-batch, and a post is listed once per batch."""
    path = scratch_dir(spark, "relisted")
    jobs.stream_relisted(_crawl(landed(spark, sf, "events")), path).awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("source", "source_notice_id")


@query(
    "stream_freshness",
    "SELECT 'src' || (user_id % 20) AS source, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS checked_at FROM events GROUP BY 1",
)
def _(spark, sf):
    path = scratch_dir(spark, "freshness")
    jobs.stream_freshness(_crawl(landed(spark, sf, "events")), path).awaitTermination()
    return jobs.read_freshness(spark, path).withColumn("checked_at", F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss"))


@query("stream_canonical", ctes(*store.GROUPED) + "SELECT id, group_id FROM grouped")
def _(spark, sf):
    path = scratch_dir(spark, "canonical")
    docs = landed(spark, sf, "documents")
    notices = docs.select(
        F.col("doc_id").alias("id"), "source",
        F.expr("date_add(DATE '2026-09-01', cast(doc_id % 7 as int))").alias("published_at"),
        text.dedup_key(text.first_line(F.col("text"))).alias("dedup_key"),
    )
    jobs.stream_canonical(notices, path, buckets=16).awaitTermination()
    return spark.read.parquet(f"{path}/groups").select("id", F.coalesce("dup_of", "id").alias("group_id"))


EXPIRY_DAYS = 2
BATCHES = 4

# A row meets earlier rows of its batch, and rows of earlier batches that were no older than EXPIRY_DAYS before the newest of those.
EXPIRING = f"""arrivals AS (
  SELECT *, id * {BATCHES} // (SELECT max(id) + 1 FROM keyed) AS batch FROM keyed),
newest AS (SELECT batch, max(max(published_at)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS day FROM arrivals GROUP BY batch),
meets AS (
  SELECT a.id, min(b.id) AS parent FROM arrivals a JOIN newest n ON n.batch = a.batch JOIN arrivals b
    ON a.dedup_key = b.dedup_key AND a.source <> b.source AND abs(a.published_at - b.published_at) <= 3 AND b.id < a.id
   AND (b.batch = a.batch OR b.published_at >= n.day - {EXPIRY_DAYS})
  GROUP BY a.id),
climbed AS (
  SELECT id, parent AS root FROM meets
  UNION ALL
  SELECT c.id, m.parent FROM climbed c JOIN meets m ON c.root = m.id)"""


@query(
    "stream_canonical_expiry",
    ctes(ad.NOTICE_DOCS, ad.DOC_KEYS, EXPIRING)
    + "SELECT a.id, coalesce(min(c.root), a.id) AS group_id, a.batch FROM arrivals a LEFT JOIN climbed c USING (id) GROUP BY a.id, a.batch",
)
def _(spark, sf):
    """Notices land in four parts by id; state older than two days before the newest notice of earlier parts is let go."""
    path = scratch_dir(spark, "expiry")
    docs = ad.table(spark, sf, "documents").select("doc_id", "source", "text")
    last = docs.agg(F.max("doc_id").alias("m")).first()["m"]
    part = F.floor(F.col("doc_id") * BATCHES / F.lit((last or 0) + 1)).cast("long")
    notices = docs.select(
        F.col("doc_id").alias("id"), "source", F.expr("date_add(DATE '2026-09-01', cast(doc_id % 7 as int))").alias("published_at"),
        text.dedup_key(text.first_line(F.col("text"))).alias("dedup_key"), part.alias("batch"),
    )
    notices.write.partitionBy("batch").parquet(f"{path}/all")
    schema = notices.drop("batch").schema
    for n in range(BATCHES):
        # each run finds the files that landed since the one before
        spark.read.schema(schema).parquet(f"{path}/all").filter(F.col("batch") == n).drop("batch").write.mode("append").parquet(f"{path}/landed")
        jobs.stream_canonical(spark.readStream.schema(schema).parquet(f"{path}/landed"), f"{path}/out", EXPIRY_DAYS, buckets=16, merge_after=2).awaitTermination()
    out = spark.read.parquet(f"{path}/out/groups")
    return out.select("id", F.coalesce("dup_of", "id").alias("group_id"), F.col("batch_id").cast("long").alias("batch"))
