"""Calendar files read event by event, snapshot files with an index, folded lines and hit positions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from noticelake.functions.arrays import running_max, running_sums
from noticelake.operators import search
from noticelake.sources import calendar_files as files
from noticelake.sources import export


def folded(line):
    out, used = "", 0
    for c in line:
        n = len(c.encode())
        if used + n > 75:
            out, used = out + "\r\n ", 1
        out, used = out + c, used + n
    return out


def test_fold_counts_octets(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice("ab가é😀 $\\") for _ in range(n)) for n in [0, 1, 18, 25, 40, 74, 75, 76, 90, 149, 150, 400]]
    lines += ["x" * 75, "x" * 76, "x" * 149, "x" * 150, "가" * 25, "가" * 26]
    block = "\r\n".join(lines)
    got = spark.createDataFrame([(block,), (None,), ("",)], "block string").select(files.ics_fold(F.col("block"))).collect()
    assert [r[0] for r in got] == ["\r\n".join(map(folded, lines)), None, ""]


@pytest.mark.parametrize("end", ["\r\n", "\n", "\r"])
def test_calendars_are_read_by_many_tasks(spark, tmp_path, end):
    lines = ["BEGIN:VCALENDAR", "BEGIN:VTIMEZONE", "DTSTART:19700101T000000", "END:VTIMEZONE", "BEGIN:VEVENT", "UID:lost"]
    for i in range(400):
        lines += ["BEGIN:VEVENT", f"UID:u{i}", f"SUMMARY:가나 {i} BEGIN:VEVENT", "  and on", f"DTSTART;VALUE=DATE:202610{i % 28 + 1:02d}", "END:VEVENT"]
    (tmp_path / "c").mkdir()
    for name in ("a", "b"):
        (tmp_path / "c" / f"{name}.ics").write_bytes(end.join([*lines, "END:VCALENDAR", ""]).replace("UID:u", f"UID:{name}").encode())
    (tmp_path / "c" / "empty.ics").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        events = files.read_ics(spark, str(tmp_path / "c"))
        assert events.rdd.getNumPartitions() > 10
        got = events.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["uid"] for r in got) == sorted(f"{n}{i}" for n in "ab" for i in range(400))
    assert {r["title"] for r in got} == {f"가나 {i} BEGIN:VEVENT and on" for i in range(400)} and all(r["all_day"] for r in got)


def test_fields_of_an_event_are_read_once(spark):
    plan = files.parse_ics(spark.range(1).selectExpr("id", "cast(id AS string) AS text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^DTSTART") == 1 and plan.count("^UID") == 1


def test_snapshot_details_are_not_checkpointed(spark, tmp_path, monkeypatch):
    details = spark.range(50).select(F.col("id").alias("asked_id"), F.array(F.lit("x")).alias("more"), F.lit(None).cast("date").alias("day"))
    monkeypatch.setattr(type(details), "checkpoint", lambda *_: pytest.fail("whole rows are checkpointed"))
    path = str(tmp_path / "snap")
    export.export_snapshot(spark.range(3), details, spark.range(1), path, file_bytes=300)
    assert len(spark.read.json(f"{path}/detail_index").collect()) >= 3
    assert sorted(map(tuple, export.read_details(spark, path, details.schema, [7, 49]).collect())) == [(7, ["x"], None), (49, ["x"], None)]


def test_snapshot_copies_are_found_by_the_index(spark, tmp_path):
    details = spark.range(1000).select(F.col("id").alias("asked_id"), (F.col("id") % 7).alias("canonical_id"), F.repeat(F.lit("본문"), 30).alias("body"))
    items = spark.range(3)
    path = str(tmp_path / "snap")
    export.export_snapshot(items, details, items.agg(F.count("*").alias("n")), path, file_bytes=20_000)
    index = spark.read.json(f"{path}/detail_index").collect()
    assert len(index) >= 5 and sum(r["rows"] for r in index) == 1000
    spans = sorted((r["least"], r["largest"]) for r in index)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    back = export.read_details(spark, path, details.schema, [3, 996, 5000])
    assert {r["asked_id"]: (r["canonical_id"], r["body"]) for r in back.collect()} == {3: (3, "본문" * 30), 996: (2, "본문" * 30)}
    assert len(back.inputFiles()) == 2 and export.read_details(spark, path, details.schema, [-1]).count() == 0
    empty = str(tmp_path / "none")
    export.export_snapshot(items, details.limit(0), items, empty)
    assert export.read_details(spark, empty, details.schema, [3]).count() == 0


def brute_spans(text, terms):
    keep = [i for i, c in enumerate(text) if not re.match(r"[\s ​　]", c) or c == "​"]
    plain = "".join(text[i].lower() if len(text[i].lower()) == 1 else text[i] for i in keep)
    hits = sorted((keep[i], keep[i + len(t) - 1] + 1) for t in terms for i in range(len(plain)) if t and plain.startswith(t, i))
    out = []
    for s, e in hits:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def test_spans_equal_a_search_at_every_place(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAbB .😀İ 가") for _ in range(n)) for n in [0, 1, 2, 5, 10, 30, 60, 120] * 5]
    texts += ["aaaa", "a a\na", "ab", "abab" * 500]
    for terms in (["a"], ["aa", "ab"], ["aba", "b"], [".", "가"], ["😀a", "", "a"], ["zz"]):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search.match_spans(F.col("t"), terms).alias("m")).collect()
        for r in got:
            assert [(x["s"], x["e"]) for x in r["m"]] == brute_spans(r["t"], terms), (r["t"], terms)
    row = spark.createDataFrame([(None,)], "t string").select(search.match_spans(F.col("t"), ["a"]).alias("m")).first()
    assert row["m"] == []


def test_running_sums(spark):
    rows = spark.createDataFrame([([],), ([4],), ([3, 1, 2, 5, 5, 0, 9],), (list(range(1000)),)], "v array<int>")
    for r in rows.select("v", running_sums(F.col("v")).alias("s"), running_max(F.col("v")).alias("m")).collect():
        assert r["s"] == [sum(r["v"][: i + 1]) for i in range(len(r["v"]))] and r["m"] == [max(r["v"][: i + 1]) for i in range(len(r["v"]))]
