"""Change capture, board lists, run decisions, stop policy, views and counters."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from noticelake.operators import cdc, facets, listing, runs, views
from noticelake.streaming import jobs

STORED = (
    "id long, source string, source_notice_id string, source_url string, title string, original_content string, published_at date, "
    "board_category string, content_hash string, crawled_at timestamp, content_updated_at timestamp, dup_of long"
)
T1, T2 = datetime(2026, 9, 1), datetime(2026, 9, 2)


def stored_row(i, key, title, body, at=T1):
    return (i, "a", key, f"u{key}", title, body, date(2026, 9, 1), None, f"h-{body}", at, None, None)


def test_upsert_classifies_applies_and_is_idempotent(spark):
    stored = spark.createDataFrame([stored_row(4, "1", "t", "x"), stored_row(5, "2", "t", "y"), stored_row(6, "3", "t", "z"), stored_row(7, "9", "t", "q")], STORED)
    incoming = spark.createDataFrame(
        [stored_row(0, "1", "t", "x", T2), stored_row(0, "2", "t2", "y", T2), stored_row(0, "3", "t", "z2", T2), stored_row(0, "8", "n", "n", T2), stored_row(0, "7", "n", "n", T2)],
        STORED).drop("id", "dup_of", "content_updated_at")
    kinds = {r["source_notice_id"]: (r["status"], list(r["changed"])) for r in cdc.classify_upsert(incoming, stored).collect()}
    assert kinds == {"1": ("unchanged", []), "2": ("updated", ["title"]), "3": ("updated", ["content"]), "8": ("new", []), "7": ("new", [])}
    once = cdc.apply_upsert(incoming, stored, [F.col("source_notice_id").asc()]).cache()
    rows = {r["source_notice_id"]: r for r in once.collect()}
    assert {k: r["id"] for k, r in rows.items()} == {"1": 4, "2": 5, "3": 6, "9": 7, "7": 8, "8": 9}
    assert rows["1"]["crawled_at"] == T2 and rows["1"]["content_updated_at"] is None
    assert rows["2"]["title"] == "t2" and rows["2"]["content_updated_at"] == T2 and rows["9"]["crawled_at"] == T1
    twice = cdc.apply_upsert(incoming, once, [F.col("source_notice_id").asc()])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.select(once.columns).collect()))


def test_stream_upsert_over_files_and_repeated_batch(spark, tmp_path):
    schema = "source string, source_notice_id string, title string, content_hash string, crawled_at timestamp, pos long"
    first = [("a", "1", "t", "h", T1, 1), ("a", "2", "t", "h", T1, 2), ("a", "1", "t", "h0", T1, 0)]
    second = [("a", "1", "t", "h2", T2, 3), ("a", "2", "t", "h", T2, 4), ("a", "3", "t", "h", T2, 5)]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{n}"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    jobs.stream_upsert(stream, out, ["pos"]).awaitTermination()
    state = lambda: sorted(tuple(r) for r in jobs.upsert_store(spark, out, spark.createDataFrame([], schema).schema).snapshot().select("source_notice_id", "content_hash", "id").collect())
    want = [("1", "h2", 0), ("2", "h", 1), ("3", "h", 2)]
    assert state() == want
    jobs.upsert_batch(spark.createDataFrame(second, schema), 1, out, ["pos"])
    assert state() == want
    seen = {r["source_notice_id"]: r["status"] for r in spark.read.parquet(f"{out}/seen").filter("batch_id = 1").collect()}
    assert seen == {"1": "updated", "2": "unchanged", "3": "new"}


def test_board_lists(spark):
    rows = [("a", "1", 0, True), ("a", "2", 1, True), ("a", "3", 2, False), ("a", "1", 3, False), ("a", "4", 4, False), ("b", "1", 5, False), ("b", "2", 6, False)]
    listed = spark.createDataFrame(rows, "source string, source_notice_id string, pos long, pinned boolean")
    unique = listing.unique_listed(listed)
    got = {(r["source"], r["source_notice_id"]): (r["pos"], r["pinned"]) for r in unique.collect()}
    assert got[("a", "1")] == (0, False) and got[("a", "2")] == (1, True) and len(got) == 6
    ids = lambda df: sorted((r["source"], r["source_notice_id"]) for r in df.collect())
    assert ids(listing.limit_regular(unique, 1)) == [("a", "1"), ("a", "2"), ("b", "1")]
    assert ids(listing.limit_regular(unique, 0)) == [("a", "2")]
    assert ids(listing.limit_per_source(unique, {"a": 2, "b": None})) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1"), ("b", "2")]
    assert ids(listing.limit_per_source(unique, {"a": 2}, override=1)) == [("a", "1"), ("a", "2"), ("b", "1")]
    boards = spark.createDataFrame([("a", "x", 0), ("b", "y", 1)], "source string, alias string, ord int")
    assert {r["source"] for r in listing.select_sources(unique, boards, "y").collect()} == {"b"}
    with pytest.raises(ValueError, match="nope"):
        listing.select_sources(unique, boards, "a, nope")


def test_recheck_rule(spark):
    today = date(2026, 9, 24)
    stored = spark.createDataFrame(
        [("recent", 1, date(2026, 9, 17), []), ("old", 2, date(2026, 9, 16), ["2026-09-23"]), ("due", 3, date(2026, 9, 1), ["2026-09-24T09:00"]), ("undated", 4, None, [])],
        "source_url string, stored_id long, published_at date, dates array<string>")
    listed = spark.createDataFrame([(u, date(2026, 9, 20)) for u in ("new", "recent", "old", "due", "undated")], "source_url string, listed_date date")
    got = {r["source_url"]: r["reason"] for r in listing.fetch_reason(listed, stored, today).collect()}
    assert got == {"new": "new", "recent": "recent", "old": None, "due": "upcoming", "undated": "recent"}
    full = {r["source_url"]: r["reason"] for r in listing.fetch_reason(listed, stored, today, full=True).collect()}
    assert full["old"] == "full" and full["new"] == "new"


def stop_position(outcomes):
    bad = 0
    for pos, o in outcomes:
        if o in runs.HARD_STOPS:
            return pos
        if o == "overload":
            bad += 1
            if bad == 3:
                return pos
        elif o == "success":
            bad = 0
    return None


def test_stop_policy_across_chunks(spark):
    rnd, rows, want = random.Random(1), [], {}
    for run in range(60):
        kinds = rnd.choice([["success", "overload", "json_error"], ["overload", "json_error"], ["success", "overload", "http_429"], ["success", "json_error"]])
        log = [(pos, rnd.choice(kinds)) for pos in sorted(rnd.sample(range(60), 25))]
        rows += [(run, pos, o) for pos, o in log]
        want[run] = stop_position(log)
    for chunk in (3, 7, 1000):
        out = runs.stop_policy(spark.createDataFrame(rows, "run int, pos long, outcome string"), chunk=chunk).collect()
        assert {r["run"]: r["stopped_at"] for r in out} == want
        assert all((r["result"] == "deferred") == (r["stopped_at"] is not None and r["pos"] > r["stopped_at"]) or r["outcome"] == "no_request" for r in out)


def test_work_decision_ladder_and_budget(spark):
    processed = spark.createDataFrame(
        [(1, 1, "new", 0), (2, 1, "new", 1), (3, 3, "known", 0), (4, 3, "updated", 1), (5, 5, "unchanged", 0), (6, 6, "updated", 0)],
        "id long, group_id long, status string, ord int")
    current = spark.createDataFrame([(3, 3), (6, 6)], "group_id long, current_id long")
    fresh = spark.createDataFrame([(3, 3)], "group_id long, current_id long")
    out = runs.work_decision(processed, current, fresh, ["ord"])
    got = {r["id"]: (r["decision"], r["reason"]) for r in out.collect()}
    assert got[1] == ("analyse", "new") and got[2][0] == "duplicate-skip" and got[3][0] == "known-skip" and got[4][0] == "duplicate-skip"
    assert got[5] == ("analyse", "pending") and got[6][0] == "current-skip"
    up = {r["id"]: (r["decision"], r["reason"]) for r in runs.work_decision(processed, current, fresh, ["ord"], upgrade=True).collect()}
    assert up[6] == ("analyse", "upgrade") and up[3][0] == "known-skip"
    none = {r["id"]: r["decision"] for r in runs.work_decision(processed, current, fresh, ["ord"], analyser_available=False).collect()}
    assert none[1] == none[2] == none[5] == "deferred" and none[3] == "known-skip"
    assert sorted(r["id"] for r in runs.cut_budget(out, 1, ["ord"]).filter("decision = 'deferred'").collect()) == [5]
    assert runs.cut_budget(out, 0, ["ord"]).filter("decision = 'analyse'").count() == 0
    with pytest.raises(ValueError):
        runs.cut_budget(out, -1, ["ord"])


def test_list_and_detail_break_ties_differently(spark):
    rows = spark.createDataFrame(
        [(1, None, 1, "a", date(2026, 9, 1), "pending", None, None, None), (2, 1, 1, "b", date(2026, 9, 2), "ready", 20, "h", "two"),
         (3, 1, 1, "b", date(2026, 9, 3), "ready", 30, "h", "three"), (4, None, 4, "a", None, "stale", 40, "x", "four")],
        "id long, dup_of long, group_id long, source string, published_at date, status string, analysis_id long, analyzed_hash string, category string")
    shown = lambda detail: {r["id"]: (r["shown_id"], r["status"], r["category"], list(r["boards"])) for r in views.canonical_list(rows, ["category"], detail).collect()}
    assert shown(False) == {1: (3, "ready", "three", ["a", "b"]), 4: (4, "stale", "four", ["a"])}
    assert shown(True)[1] == (2, "ready", "two", ["a", "b"])


def test_two_definitions_of_current(spark):
    notices = spark.createDataFrame([(1, 1, "A")], "id long, group_id long, content_hash string")
    analysis = spark.createDataFrame([(10, 1, "A", "v3"), (11, 1, "B", "v3")], "analysis_id long, notice_id long, content_hash string, prompt_version string")
    assert views.with_latest_analysis(notices, analysis, []).first()["status"] == "stale"
    assert views.group_current(notices, analysis).first()["current_id"] == 1
    assert views.group_current(notices, analysis, "v2").count() == 0


def test_source_filters_and_facets(spark):
    boards = spark.createDataFrame(
        [("m", 0, "main", None, None), ("c", 1, "college", "C1", None), ("d1", 2, "department", "C1", "D1"), ("d2", 3, "department", "C1", "D2")],
        "source string, ord int, kind string, college string, major string")
    me, other = {"major": "D1", "college": "C1"}, {"major": "D9", "college": "C9"}
    ids = lambda v, p=None: None if (s := facets.resolve_source(boards, v, p)) is None else sorted(r["source"] for r in s.collect())
    assert ids("all") is None and ids(None) is None and ids("gone") is None and ids("my-major") is None
    assert ids("d2") == ["d2"] and ids("department") == ["d1", "d2"] and ids("my-major", me) == ["d1"] and ids("my-college", me) == ["c"]
    assert ids("my-major", other) == []
    copies = spark.createDataFrame([(1, "m"), (1, "d1"), (2, "d1"), (2, "d1")], "group_id long, source string")
    got = [(r["value"], r["n"]) for r in facets.source_facets(copies, None, boards, me).orderBy("ord").collect()]
    assert got == [("all", 2), ("my-major", 2), ("my-college", 0), ("m", 1), ("c", 0), ("d1", 2), ("d2", 0)]
    assert ("my-major", 0) not in [(r["value"], r["n"]) for r in facets.source_facets(copies, 2, boards, other).collect()]
    values = spark.createDataFrame([("main",), ("department",), ("zzz",), ("d1",), ("my-major",)], "value string")
    assert {r["value"]: r["canonical"] for r in facets.canonical_source_param(values, boards).collect()} == {
        "main": "m", "department": "department", "zzz": "all", "d1": "d1", "my-major": "my-major"}


def test_freshness_prefers_oldest_known_check(spark):
    boards = spark.createDataFrame([("a",), ("b",)], "source string")
    notices = spark.createDataFrame([(T1,), (T2,)], "crawled_at timestamp")
    log = spark.createDataFrame([("a", T2, 1), ("a", T1, 2), ("b", T2, 3), ("gone", datetime(2020, 1, 1), 4)], "source string, checked_at timestamp, seq int")
    assert facets.freshness(cdc.last_checks(log), boards, notices).first()[0] == T1
    assert facets.freshness(cdc.last_checks(log.limit(0)), boards, notices).first()[0] == T2


def test_category_facets_sum_to_total(spark):
    items = spark.createDataFrame([("학사",), ("학사",), (None,), ("기타",)], "category string")
    rows = [(r["value"], r["n"]) for r in facets.category_facets(items, ["장학금", "학사", "기타"]).orderBy("ord").collect()]
    assert rows == [("all", 4), ("학사", 2), ("기타", 1), ("pending", 1)]
