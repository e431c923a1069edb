"""Stores in buckets: versions, pieces and merges, batches against a row-by-row simulation, and what a batch reads."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.functions.text import dedup_key
from noticelake.operators.notice_store import NoticeStore, bytes_behind, upsert
from noticelake.sources.bucketed import BucketedTable
from noticelake.streaming import jobs
from test_resolve import Store

CRAWLED = "source string, source_notice_id string, title string, content_hash string, published_at date, crawled_at timestamp, pos long"
DAY = datetime(2026, 9, 1)


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("part-*.parquet")}


def test_bucketed_table(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), T.StructType.fromDDL("k string, n long, v string, live boolean"), ("k", "n"), ("k",), 4, merge_after=2)
    rows = lambda *r: spark.createDataFrame([(*x, True) if len(x) == 3 else x for x in r], "k string, n long, v string, live boolean")
    state = lambda **kw: sorted(map(tuple, t.read(**kw).collect()), key=str)
    assert t.last() == -1 and t.top(-1) == -1 and state(upto=-1) == []
    t.write(rows(("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")), 0)
    t.close(0, 5)
    t.write(rows(("a", 1, "x2"), ("a", 2, "w"), ("b", 1, None, False)), 1)
    assert t.last() == 0 and state() == [("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")]  # version 1 is not complete
    t.close(1, 7)
    want = [("a", 1, "x2"), ("a", 2, "w"), (None, 1, "z")]
    assert state() == want and t.top(t.last()) == 7
    assert state(upto=0) == [("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")]
    t.write(rows(("c", 9, "lost try")), 2)
    t.write(rows(("a", 3, "second try")), 2)  # of the same version
    assert t.compact(1) and state(upto=1) == want
    assert t.compact(1) == []  # merged already
    t.write(rows((None, 1, "z2")), 3)
    t.close(3)
    assert (None, 1, "z2") in state() and [r[0] for r in state(columns=["v"])].count("a") == 3
    only = t.touched(rows(("a", 0, "")))
    assert len(only) == 1 and all(p.bucket in only for p in t.pieces(3, only))


def test_a_batch_is_joined_once_for_new_and_edited_rows(spark, tmp_path, monkeypatch):
    def crawl(*ids, mark):
        numbers = spark.createDataFrame([(i,) for i in ids], "i long").checkpoint()
        return numbers.select(F.lit("b").alias("source"), F.col("i").cast("string").alias("source_notice_id"), F.concat(F.lit(mark), F.col("i").cast("string")).alias("title"),
                              F.lit(mark).alias("content_hash"), F.lit(date(2026, 9, 1)).alias("published_at"), F.lit(DAY).alias("crawled_at"), F.col("i").alias("pos"))

    schema = T.StructType([*crawl(1, mark="m").schema, T.StructField("views", T.LongType())])  # views: kept from the store
    store = NoticeStore(spark, str(tmp_path / "s"), schema, buckets=2)
    store.apply(crawl(1, 2, mark="old").withColumn("views", F.col("pos") * 10), 0, ["pos"])
    plans, real = [], BucketedTable.write
    monkeypatch.setattr(BucketedTable, "write", lambda self, rows, version, base=False: (
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) if "title" in rows.columns else None, real(self, rows, version, base))[1])
    store.apply(crawl(2, 3, mark="~new~"), 1, ["pos"])
    got = sorted((r["id"], r["title"], r["views"], r["content_updated_at"]) for r in store.snapshot().collect())
    assert [r[:3] for r in got] == [(0, "old1", 10), (1, "~new~2", 20), (2, "~new~3", None)] and [r[3] is None for r in got] == [True, False, True]
    assert len(plans) == 1 and plans[0].count("concat(~new~") == 1


def test_batches_equal_row_by_row_simulation(spark, tmp_path):
    schema = spark.createDataFrame([], CRAWLED).schema
    store = NoticeStore(spark, str(tmp_path / "s"), schema, grouped=True, buckets=5, merge_after=2)
    rnd, sim, ids, rows = random.Random(11), Store(), {}, {}
    titles = [None, "first common title here", "second common title here", "third common title", "short"]
    for version in range(4):
        batch = {}
        for _ in range(30):
            key = (f"board{rnd.randrange(4)}", str(rnd.randrange(40)))
            batch[key] = (rnd.choice(titles) or "?", f"h{rnd.randrange(3)}", rnd.choice([None, *[date(2026, 9, 1) + timedelta(days=d) for d in range(9)]]))
        incoming = [(*k, *v, DAY + timedelta(days=version), n) for n, (k, v) in enumerate(batch.items())]
        told = {(r["source"], r["source_notice_id"]): r for r in store.apply(spark.createDataFrame(incoming, CRAWLED), version, ["pos"]).collect()}
        if version == 2:  # a batch that is run again
            told = {(r["source"], r["source_notice_id"]): r for r in store.apply(spark.createDataFrame(incoming, CRAWLED), version, ["pos"]).collect()}
        keyed = {t: r["k"] for r in spark.createDataFrame([(t,) for t in titles if t] + [("?",)], "t string").select("t", dedup_key(F.col("t")).alias("k")).collect() for t in [r["t"]]}
        edited = sorted((ids[k], k) for k in batch if k in ids and rows[k][:2] != batch[k][:2])
        for i, k in edited:  # edits in id order, then new rows in theirs
            before, rows[k] = rows[k], batch[k]
            sim.rows[i] |= {"key": keyed[batch[k][0]], "day": batch[k][2]}
            if before[0] != batch[k][0]:
                sim.place(i)
        status = {k: "new" if k not in ids else "updated" if ids[k] in dict(edited) else "unchanged" for k in batch}
        for k in batch:
            if k not in ids:
                ids[k] = len(ids)
                rows[k] = batch[k]
                sim.insert(ids[k], k[0], batch[k][2], keyed[batch[k][0]])
        assert {k: (r["id"], r["status"]) for k, r in told.items()} == {k: (ids[k], status[k]) for k in batch}
        got = {r["id"]: r for r in store.snapshot().collect()}
        assert {i: r["dup_of"] for i, r in got.items()} == {i: r["dup_of"] for i, r in sim.rows.items()}
        assert {(r["source"], r["source_notice_id"]): (r["title"], r["content_hash"], r["published_at"]) for r in got.values()} == rows
        assert all(got[ids[k]]["crawled_at"] == DAY + timedelta(days=version) for k in batch)
    assert sorted(map(str, store.rebucket(str(tmp_path / "wide2"), 3).snapshot().collect())) == sorted(map(str, store.snapshot().collect()))


def test_seeded_store_keeps_other_columns_and_files(spark, tmp_path):
    prev = spark.createDataFrame(
        [(7, "a", str(i), f"title number {i}", "h", date(2026, 9, 1), DAY, None, None, f"mark {i}") for i in range(40)],
        "id long, source string, source_notice_id string, title string, content_hash string, published_at date, crawled_at timestamp, content_updated_at timestamp, dup_of long, mark string")
    prev = prev.withColumn("id", F.col("source_notice_id").cast("long"))
    store = NoticeStore(spark, str(tmp_path / "s"), prev.schema, buckets=16)
    store.seed(prev)
    before = files(tmp_path / "s/notices")
    told = upsert(store, spark.createDataFrame([("a", "3", "title changed", "h", date(2026, 9, 1), DAY + timedelta(days=1), 1), ("a", "4", "title number 4", "h", date(2026, 9, 1), DAY + timedelta(days=1), 2)], CRAWLED), ["pos"])
    assert {r["source_notice_id"]: r["status"] for r in told.collect()} == {"3": "updated", "4": "unchanged"}
    after = files(tmp_path / "s/notices")
    assert before <= after and len({f.split("/")[1] for f in after - before if "rows" in f}) == 1  # one bucket got a piece
    rows = {r["id"]: r for r in store.snapshot().collect()}
    assert rows[3]["mark"] == "mark 3" and rows[3]["title"] == "title changed" and rows[3]["content_updated_at"] == DAY + timedelta(days=1)
    assert rows[4]["crawled_at"] == DAY + timedelta(days=1) and rows[4]["content_updated_at"] is None and rows[5]["crawled_at"] == DAY


def test_bytes_read_do_not_grow_with_the_log(spark, tmp_path):
    schema = spark.createDataFrame([], CRAWLED).schema
    store = NoticeStore(spark, str(tmp_path / "s"), schema, buckets=16, merge_after=3)
    one = spark.createDataFrame([("a", "0", "t", "h", None, DAY, 0)], CRAWLED)
    mine = store.notices.touched(one)
    behind = []
    for version in range(8):
        rows = [("a", str(1000 * version + i), "t", f"h{version}", None, DAY, i) for i in range(20)]
        batch = spark.createDataFrame(rows, CRAWLED).filter(~store.notices.bucket().isin(mine))
        store.apply(batch.unionByName(one.withColumn("content_hash", F.lit(f"h{version}"))), version, ["pos"])
        behind.append(bytes_behind(store.notices, one))
    assert max(behind) <= 4.5 * behind[0]  # a base and three deltas at most
    assert store.snapshot().filter("source_notice_id = '0'").first()["content_hash"] == "h7"


def test_stream_of_1_3_and_8_files(spark, tmp_path):
    rnd = random.Random(3)
    rows = [("a", str(rnd.randrange(30)), f"t{rnd.randrange(4)}", f"h{rnd.randrange(3)}", date(2026, 9, 1), DAY + timedelta(hours=i), i) for i in range(160)]
    got = []
    for n in (1, 3, 8):
        folder = tmp_path / f"in{n}"
        for k in range(n):
            part = rows[len(rows) * k // n : len(rows) * (k + 1) // n]
            spark.createDataFrame(part, CRAWLED).coalesce(1).write.parquet(str(folder / f"f{k}"))
        stream = spark.readStream.schema(CRAWLED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
        jobs.stream_upsert(stream, str(tmp_path / f"out{n}"), ["pos"], buckets=4, merge_after=2).awaitTermination()
        state = jobs.upsert_store(spark, str(tmp_path / f"out{n}"), stream.schema, buckets=4, merge_after=2).snapshot()
        got.append(sorted(tuple(r) for r in state.select("source_notice_id", "title", "content_hash").collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == len({r[1] for r in rows})


def test_expired_state_is_let_go(spark, tmp_path):
    fields = "id long, source string, published_at date, dedup_key string"
    path, first = str(tmp_path / "c"), date(2026, 9, 1)
    for batch in range(6):
        rows = [(batch * 10 + i, f"b{i}", first + timedelta(days=batch), f"key {i % 2}") for i in range(4)]
        jobs.group_batch(spark.createDataFrame(rows, fields), batch, path, keep_days=0, merge_after=1)
    table = jobs.cell_table(spark, path, merge_after=1)
    days = {r["published_at"] for r in table.read().select("published_at").collect()}
    assert days == {first + timedelta(days=4), first + timedelta(days=5)}
    got = {r["id"]: r["dup_of"] for r in spark.read.parquet(f"{path}/groups").collect()}
    assert got[0] is None and got[2] == 0 and got[10] == 0 and got[11] == 1
    jobs.group_batch(spark.createDataFrame([], fields), 6, path, keep_days=0)
    assert jobs.cell_table(spark, path).top(6) == (first + timedelta(days=5) - date(1970, 1, 1)).days
