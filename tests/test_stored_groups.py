"""Stored groups whose canonical row is gone, and whole version rows."""

from datetime import date

from pyspark.sql import functions as F

from noticelake.operators import cdc, views

ROWS = "id long, dup_of long, source string, published_at date, content_hash string, analysis_id long, category string, status string, attachments_json string"


def stored(spark):
    day = date(2026, 9, 1)
    return spark.createDataFrame([
        (1, None, "b2", day, "h", None, None, "pending", '[{"kind":"file","name":"a.pdf","url":"u"}]'),
        (2, 1, "b1", day, "h", 20, "event", "ready", None),
        (3, 1, "zz", day, "h", None, None, "pending", "no json"),
        (5, 4, "b1", day, "h", 50, "other", "stale", None),
        (6, 4, "b2", day, "h", 60, "event", "ready", None),
    ], ROWS)


def test_list_and_detail_without_the_canonical_row(spark):
    boards = spark.createDataFrame([("b2", 0), ("b1", 1)], "source string, ord int")
    got = {r["id"]: r for r in views.stored_list(stored(spark), boards, ["category"]).collect()}
    assert sorted(got) == [1, 5, 6]  # in a list each orphan stands alone
    assert got[1]["boards"] == ["b2", "b1", "zz"] and got[1]["shown_id"] == 2 and got[1]["n_copies"] == 3
    assert (got[5]["status"], got[6]["status"]) == ("stale", "ready")
    asked = spark.createDataFrame([(3,), (6,), (99,)], "id long")
    detail = {r["asked_id"]: r for r in views.stored_detail(stored(spark), asked, ["category"]).collect()}
    assert sorted(detail) == [3, 6]
    assert detail[3]["canonical_id"] == 1 and [x["name"] for x in detail[3]["attachments"]] == ["a.pdf"]
    assert detail[6]["canonical_id"] == 5 and detail[6]["shown_id"] == 6 and detail[6]["attachments"] == []
    assert views.stored_list(stored(spark).limit(0), boards, ["category"]).count() == 0


def test_version_rows_keep_every_field(spark):
    reply = spark.sql("""SELECT 7L AS notice_id, 'p' AS provider, 'm' AS model, array('a "b"') AS summary, array(named_struct('field', 'f', 'quote', CAST(NULL AS STRING))) AS evidence,
        CAST(NULL AS array<string>) AS uncertain, CAST(array() AS array<string>) AS validation_warnings, named_struct('title', 't') AS en, 'raw' AS raw_response""")
    rows = cdc.version_rows(reply, "v3", F.lit("2026-09-08 00:00:00").cast("timestamp"))
    history = spark.createDataFrame([(41,)], "analysis_id long")
    got = cdc.append_analysis(history, rows, [F.col("notice_id")]).first()
    assert got["analysis_id"] == 42 and got["prompt_version"] == "v3" and got["raw_response"] == "raw"
    assert got["summary_json"] == '["a \\"b\\""]' and got["evidence_json"] == '[{"field":"f","quote":null}]'
    assert got["uncertain_fields_json"] is None and got["validation_warnings_json"] == "[]" and got["en_json"] == '{"title":"t"}'
