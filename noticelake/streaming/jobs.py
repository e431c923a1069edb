"""Structured Streaming versions of the crawl steps: upsert, re-listing suppression, freshness, grouping.

State lies in bucketed tables: a micro-batch is a version that writes pieces of the buckets it touches and reads no
other, so a batch that is run again after a failure replaces its own pieces and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from noticelake.dims import RECHECK_DAYS
from noticelake.operators.cdc import KEY
from noticelake.operators.notice_store import BUCKETS, NoticeStore
from noticelake.operators.resolve import CELL, place_new
from noticelake.session import ensure_checkpoint_dir
from noticelake.sources.bucketed import BucketedTable


def _batch_path(path: str, name: str, batch_id: int) -> str:
    return f"{path}/{name}/batch_id={batch_id}"


def upsert_store(spark: SparkSession, path: str, schema: T.StructType, grouped: bool = False, **options) -> NoticeStore:
    """The notices that ``stream_upsert`` keeps under ``path``; ``schema`` is that of the crawled rows."""
    return NoticeStore(spark, f"{path}/store", schema, grouped, **options)


def upsert_batch(batch: DataFrame, batch_id: int, path: str, order: list[str], grouped: bool = False, **options) -> None:
    """One micro-batch of crawled rows (source, source_notice_id, title, content_hash, crawled_at, ...).

    The newest row of each key is applied to the store; ``path/seen`` gets the crawl time and status of every key. Stored
    rows are looked up in the buckets of the batch's keys alone, and only in the columns that are compared.
    """
    payload = [c for c in batch.columns if c not in KEY]
    rows = batch.groupBy(*KEY).agg(F.max_by(F.struct(*payload), F.struct("crawled_at", *order)).alias("v")).select(*KEY, "v.*").persist()
    try:
        marked = upsert_store(batch.sparkSession, path, batch.schema, grouped, **options).apply(rows, batch_id, order)
        marked.select(*KEY, "crawled_at", "status").write.mode("overwrite").parquet(_batch_path(path, "seen", batch_id))
    finally:
        rows.unpersist()


def stream_upsert(crawled: DataFrame, path: str, order: list[str], grouped: bool = False, **options) -> StreamingQuery:
    return (
        crawled.writeStream.foreachBatch(lambda df, b: upsert_batch(df, b, path, order, grouped, **options))
        .option("checkpointLocation", f"{path}/_progress")
        .trigger(availableNow=True)
        .start()
    )


def suppress_relisted(listed: DataFrame, days: int = RECHECK_DAYS) -> DataFrame:
    """The first time each post is listed; listings inside the horizon are dropped. Needs ``ts``."""
    return listed.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["source", "source_notice_id"])


def stream_relisted(listed: DataFrame, path: str, days: int = RECHECK_DAYS) -> StreamingQuery:
    return (
        suppress_relisted(listed, days).writeStream.format("parquet").outputMode("append")
        .option("path", f"{path}/rows").option("checkpointLocation", f"{path}/_progress")
        .trigger(availableNow=True).start()
    )


def stream_freshness(checks: DataFrame, path: str) -> StreamingQuery:
    """Last check per board as running state; every batch writes the boards it changed."""
    running = checks.groupBy("source").agg(F.max("ts").alias("checked_at"))

    def save(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(_batch_path(path, "checks", batch_id))

    return (
        running.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start()
    )


def read_freshness(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/checks").groupBy("source").agg(F.max("checked_at").alias("checked_at"))


def cell_table(spark: SparkSession, path: str, **options) -> BucketedTable:
    """State of ``stream_canonical``: one row per (key, board, day), not per notice, so a popular key stays small."""
    fields = T.StructType.fromDDL("dedup_key string, source string, published_at date, m long, root long")
    return BucketedTable(spark, f"{path}/cells", fields, tuple(CELL), ("dedup_key",), **{"buckets": BUCKETS, **options})


def group_batch(batch: DataFrame, batch_id: int, path: str, keep_days: int | None, **options) -> None:
    """Canonical assignment of newly arrived notices (id, source, published_at, dedup_key); ids grow with arrival.

    A cell keeps its lowest id and that row's root, so a batch only adds the cells that were not there. Cells older than
    ``keep_days`` before the newest notice of the earlier batches are not looked at, and are let go when their bucket is
    merged. The newest day is kept beside the state.
    """
    spark = batch.sparkSession
    ensure_checkpoint_dir(spark)
    table = cell_table(spark, path, **options)
    before = table.last(batch_id)
    newest = table.top(before)
    alive = F.lit(True) if keep_days is None or newest < 0 else F.unix_date("published_at") >= newest - keep_days
    table.compact(before, alive)
    arrived = batch.select("id", *CELL).checkpoint()
    keyed = arrived.filter("dedup_key is not null and published_at is not null")
    known = table.read(before, table.touched(keyed)).filter(alive).join(keyed.select("dedup_key").distinct(), "dedup_key", "left_semi").checkpoint()
    placed = place_new(arrived, known.withColumnRenamed("m", "id")).checkpoint()
    cells = keyed.join(placed, "id").groupBy(*CELL).agg(F.min("id").alias("m"), F.min_by(F.coalesce("dup_of", "id"), "id").alias("root"))
    table.write(cells.join(known.select(*CELL), CELL, "left_anti"), batch_id)
    placed.write.mode("overwrite").parquet(_batch_path(path, "groups", batch_id))
    day = arrived.agg(F.max(F.unix_date("published_at")).alias("d")).first()["d"]
    table.close(batch_id, max(newest, -1 if day is None else day))


def stream_canonical(notices: DataFrame, path: str, keep_days: int | None = None, **options) -> StreamingQuery:
    return (
        notices.writeStream.foreachBatch(lambda df, b: group_batch(df, b, path, keep_days, **options))
        .option("checkpointLocation", f"{path}/_progress")
        .trigger(availableNow=True)
        .start()
    )
