"""What the snapshot leaves on disk while it is written: texts shuffled once, narrow keys, files of finished steps gone."""

import collections
import pathlib
import re
import time
from datetime import date

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.operators import resolve, views
from noticelake.plans import adapters as ad
from noticelake.session import scratch_dir
from noticelake.sources import export

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanged(df, column):
    """Shuffles of the plan that carry the column."""
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return sum(f"{column}#" in own for own in re.findall(r"^\(\d+\) Exchange[^\n]*\nInput \[\d+\]: ([^\n]*)", plan, re.M))


def rows_of(df):
    return collections.Counter(tuple(map(str, r)) for r in df.collect())


def test_details_of_narrow_rows(spark, shuffled_joins):
    """The same details, repeated ids and missing values included, with one shuffle of the texts."""
    day = date(2026, 9, 1)
    posts = [(i, f"b{i % 3}", day, f"body {i}", f"key {i % 4}" if i % 5 else None) for i in range(40)]
    posts += [posts[6], posts[6], posts[9], (50, None, day, None, "key 1"), (51, "b1", None, "undated", "key 1")]
    notices = spark.createDataFrame(posts, "id long, source string, published_at date, original_content string, dedup_key string")
    notices = notices.withColumn("content_hash", F.sha2("original_content", 256))
    analysis = notices.filter("id % 3 = 1").select(
        F.col("id").alias("notice_id"), (F.col("id") * 10).alias("analysis_id"), "content_hash", F.lit("event").alias("category")).distinct()
    assigned = resolve.assign_canonical(notices).checkpoint()
    rows = views.with_latest_analysis(resolve.with_groups(notices), analysis, ["category"])
    whole = views.detail_by_copy(rows, rows.select("id"), ["category"])
    assert max(r["n_copies"] for r in whole.collect()) > 3
    for hot_rows in (2, 1000):
        narrow = views.detail_by_copy(rows.select(*views.CHOICE, "category"), rows.select("id"), ["category"], notices, assigned, hot_rows)
        assert exchanged(narrow, "original_content") == 1
        assert narrow.columns == whole.columns and rows_of(narrow) == rows_of(whole)
    heads = resolve.with_groups(notices, assigned.filter("dup_of IS NULL"))
    listed = views.canonical_list(rows.select(*views.CHOICE, "category"), ["category"], heads=heads)
    assert exchanged(listed, "original_content") == 1
    assert listed.columns == views.canonical_list(rows, ["category"]).columns
    assert rows_of(listed) == rows_of(views.canonical_list(rows, ["category"]))


def test_analyses_are_hashed_before_the_join(spark, shuffled_joins):
    rows = ad.analysis_docs(spark, SF)
    assert exchanged(rows, "text") == 0 and exchanged(rows, "doc_id") > 0
    texts = {r["doc_id"]: r["text"] for r in ad.table(spark, SF, "documents").collect()}
    body = spark.createDataFrame([*texts.items()], "notice_id long, body string")
    stale = (F.col("notice_id") + F.col("analysis_id") % 10) % 5 == 0
    own = F.sha2(F.when(stale, F.concat("body", F.lit(" (edited)"))).otherwise(F.col("body")), 256)
    got = rows.join(body, "notice_id").select("analysis_id", stale.alias("stale"), (F.col("content_hash") == own).alias("same")).collect()
    assert len(got) == rows.count() and all(r["same"] for r in got)
    assert {(r["analysis_id"] % 10, r["stale"]) for r in got} == {(0, True), (0, False), (1, True), (1, False)}


def test_long_keys_are_not_shuffled(spark, monkeypatch):
    long = "x" * 5000
    rows = spark.createDataFrame(
        [(1, "a", date(2026, 9, 1), long + "1"), (2, "b", date(2026, 9, 1), long + "2"), (3, "b", date(2026, 9, 2), long + "1"),
         (4, "c", date(2026, 9, 2), None), (5, "a", date(2026, 9, 2), None), (6, "a", date(2026, 9, 1), ""), (7, "b", date(2026, 9, 1), "")],
        "id long, source string, published_at date, dedup_key string")
    widths, checkpoint = [], type(rows).checkpoint

    def seen(df: DataFrame, *args):
        if "dedup_key" in df.columns:
            widths.append(df.agg(F.max(F.octet_length("dedup_key"))).first()[0])
        return checkpoint(df, *args)

    monkeypatch.setattr(type(rows), "checkpoint", seen)
    out = {r["id"]: r["dup_of"] for r in resolve.assign_canonical(rows).collect()}
    assert out == {1: None, 2: None, 3: 1, 4: None, 5: None, 6: None, 7: 6}
    assert widths and max(widths) <= 16


def test_finished_steps_leave_no_files(spark, tmp_path, shuffled_joins):
    """Only the snapshot is left: no scratch table, and no shuffle file of the steps before."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for n in map(str, re.findall(r"shuffle_\d+_\d+", disk.getAllBlocks().mkString(" ")))}
    scratch = pathlib.Path(scratch_dir(spark, "any").removeprefix("file:")).parent
    before, tables = shuffles(), {p.name for p in scratch.iterdir()}
    details = spark.range(3000).select(F.col("id").alias("asked_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 9).alias("body")).repartition(4, "body")
    path = str(tmp_path / "snap")
    export.export_snapshot(details.groupBy("body").count(), details, spark.range(1), path, file_bytes=100_000)
    until = time.time() + 20  # files go in the background
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert {p.name for p in scratch.iterdir()} == tables
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    plain = sum(len(x) for x in spark.read.text(f"{path}/details").toPandas()["value"])
    assert sum(p.stat().st_size for p in (tmp_path / "snap/details").glob("part-*")) < 0.8 * plain
    assert export.read_details(spark, path, details.schema, [7]).first()["asked_id"] == 7
