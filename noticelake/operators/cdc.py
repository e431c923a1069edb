"""Change capture against the stored notices: classify, apply, report, append.

A change is a different body hash or title; anything else only refreshes ``crawled_at``. Parquet has no
MERGE, so applying returns the next snapshot, to be written to a new location.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.operators.skew import with_global_index

KEY = ["source", "source_notice_id"]
OWN = [*KEY, "id", "crawled_at", "content_updated_at", "dup_of"]  # all other columns are content


def _changed(incoming: str, stored: str) -> Column:
    def differs(c: str) -> Column:
        return F.col(f"{incoming}.{c}") != F.col(f"{stored}.{c}")

    return F.array_compact(
        F.array(F.when(differs("content_hash"), F.lit("content")), F.when(differs("title"), F.lit("title")))
    )


def classify_upsert(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(source, source_notice_id, stored_id, status, changed) for every incoming row."""
    n = incoming.select(*KEY, "title", "content_hash").alias("n")
    s = stored.select(*KEY, "id", "title", "content_hash").alias("s")
    changed = F.when(F.col("s.id").isNull(), F.array().cast("array<string>")).otherwise(_changed("n", "s"))
    status = F.when(F.col("stored_id").isNull(), "new").when(F.size("changed") > 0, "updated").otherwise("unchanged")
    joined = n.join(s, KEY, "left").select(*KEY, F.col("s.id").alias("stored_id"), changed.alias("changed"))
    return joined.withColumn("status", status)


def apply_upsert(incoming: DataFrame, stored: DataFrame, order: list[Column]) -> DataFrame:
    """The next snapshot, with every column of ``stored``: a change takes all content columns that ``incoming`` has.

    New rows get ids above the stored maximum, in ``order`` of processing.
    """
    top = stored.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top")).first()["top"]
    absent = incoming.join(stored.select(*KEY), KEY, "left_anti")
    fresh = (
        with_global_index(absent, order, "id")
        .withColumn("id", F.col("id") + F.lit(top + 1))
        .withColumn("content_updated_at", F.lit(None).cast("timestamp"))
        .withColumn("dup_of", F.lit(None).cast("long"))
    )
    n, s = incoming.alias("n"), stored.alias("s")
    seen = F.col("n.source").isNotNull()
    touched = seen & (F.size(_changed("n", "s")) > 0)
    carried = [c for c in stored.columns if c not in OWN]
    kept = s.join(n, KEY, "left").select(
        "s.id", *KEY,
        *[F.when(touched, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) if c in incoming.columns else F.col(f"s.{c}") for c in carried],
        F.when(seen, F.col("n.crawled_at")).otherwise(F.col("s.crawled_at")).alias("crawled_at"),
        F.when(touched, F.col("n.crawled_at")).otherwise(F.col("s.content_updated_at")).alias("content_updated_at"),
        "s.dup_of",
    )
    return kept.unionByName(fresh.select(*[c for c in kept.columns if c in fresh.columns]), allowMissingColumns=True)


def insert_if_absent(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, report on rows already stored with ``content_changed``). Stored rows are kept."""
    inserts = incoming.join(stored.select(*KEY), KEY, "left_anti")
    n, s = incoming.select(*KEY, "content_hash", "crawled_at").alias("n"), stored.alias("s")
    report = n.join(s, KEY).select(
        *KEY, F.col("s.id").alias("existing_id"), "n.crawled_at",
        (F.col("n.content_hash") != F.col("s.content_hash")).alias("content_changed"),
    )
    return inserts, report


def evolve_schema(old: DataFrame, new_columns: dict[str, str], defaults: dict[str, Column]) -> DataFrame:
    """Old files with the columns they lack: null typed, then filled from ``defaults`` where null."""
    missing = {c: t for c, t in new_columns.items() if c not in old.columns}
    out = old.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()}) if missing else old
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()}) if defaults else out


def backfill_analysis(old: DataFrame, notices: DataFrame) -> DataFrame:
    """Provider defaults to ``unknown``; a missing hash is taken from the notice as it is now."""
    out = evolve_schema(old, {"provider": "string", "content_hash": "string"}, {"provider": F.lit("unknown")})
    hashes = notices.select(F.col("id").alias("notice_id"), F.col("content_hash").alias("_hash"))
    joined = out.join(hashes, "notice_id", "left")
    return joined.withColumn("content_hash", F.coalesce("content_hash", "_hash")).drop("_hash")


def last_checks(log: DataFrame) -> DataFrame:
    """One row per board: the check recorded last (a later call replaces an earlier one)."""
    return log.groupBy("source").agg(F.max_by("checked_at", "seq").alias("checked_at"))


def append_analysis(history: DataFrame, results: DataFrame, order: list[Column]) -> DataFrame:
    """New analysis versions with ids above the stored maximum, ready to append to the history."""
    top = history.agg(F.coalesce(F.max("analysis_id"), F.lit(-1)).alias("top")).first()["top"]
    return with_global_index(results, order, "analysis_id").withColumn("analysis_id", F.col("analysis_id") + F.lit(top + 1))


VERSION_JSON = {
    "summary": "summary_json", "evidence": "evidence_json", "uncertain": "uncertain_fields_json",
    "validation_warnings": "validation_warnings_json", "en": "en_json",
}  # nested fields of a reply and the text columns that hold them


def version_rows(results: DataFrame, prompt_version: str, created_at: Column) -> DataFrame:
    """Replies as stored version rows: nested fields as JSON text, null fields named, the other columns as they are."""
    coded = {name: F.to_json(F.col(field), {"ignoreNullFields": "false"}) for field, name in VERSION_JSON.items()}
    return results.withColumns({**coded, "prompt_version": F.lit(prompt_version), "created_at": created_at}).drop(*VERSION_JSON)
