"""Search, validation, analyser, calendar, calendar files and page extraction."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from noticelake.functions import dates, labels
from noticelake.functions import text as texts
from noticelake.operators import analyse, grams, search, validate
from noticelake.operators import calendar as cal
from noticelake.sources import calendar_files as files
from noticelake.sources import pages as pg

ITEM = "id long, title string, has_analysis boolean, category string, summary array<string>, target string, en struct<title:string,summary:array<string>,easyExplanation:string,target:string,eventInfo:string>"


def item(i, title="공지", summary=(), target="", category="기타", en=None, analysed=True):
    en = None if en is None else (en[0], list(en[2]), "", en[1], None)
    return (i, title, analysed, category if analysed else None, list(summary) if analysed else None, target if analysed else None, en)


def found(spark, rows, query, lang="ko"):
    return sorted(r["id"] for r in search.search(spark.createDataFrame(rows, ITEM), query, lang).collect())


def test_search_predicate(spark):
    rows = [
        item(1, "겨울 장학금 안내", en=("Winter Scholarship", "All students", [])), item(2, target="국제학생 대상", summary=["장학금 지원"]),
        item(3, "방학 중 도서관 운영 안내", analysed=False), item(4, "공지 장", target="학생 전체 대상"), item(5, category="국제교류"),
        item(6, target="한국어 대상", en=("EN title", "international students", [])),
    ]
    assert found(spark, rows, "   ") == [1, 2, 3, 4, 5, 6]
    assert found(spark, rows, "  winter   SCHOLARSHIP ", "en") == [1]
    assert found(spark, rows, "장학") == [1, 2]
    assert found(spark, rows, "장학 국제") == [2]
    assert found(spark, rows, "도서관") == [3]
    assert found(spark, rows, "international", "en") == [5, 6] and found(spark, rows, "international") == []
    assert found(spark, rows, "한국어", "en") == []
    many = search.search_many(spark.createDataFrame(rows, ITEM), {"a": "장학 국제", "b": "", "c": "없음"}).collect()
    assert sorted((r["query_id"], r["id"]) for r in many) == [("a", 2), *[("b", i) for i in range(1, 7)]]
    table = spark.createDataFrame([("a", "장학 국제"), ("b", ""), ("c", "없음"), ("d", "장"), ("e", None), ("f", "학생 대상"), ("g", "장학금 장학 학금"), ("h", "zz")], "query_id string, query string")
    index = search.search_many(spark.createDataFrame(rows, ITEM), table).collect()
    want = [(q, i) for q, text in (("a", "장학 국제"), ("b", ""), ("d", "장"), ("e", ""), ("f", "학생 대상"), ("g", "장학금 장학 학금")) for i in found(spark, rows, text)]
    assert sorted((r["query_id"], r["id"]) for r in index) == sorted(want)
    assert search.search_many(spark.createDataFrame(rows, ITEM), table.limit(0)).count() == 0


def test_many_thousand_saved_queries(spark):
    rows = [item(i, f"notice {i} of board b{i % 7}") for i in range(300)]
    queries = spark.range(50_000).selectExpr("id AS query_id", "concat('NOTICE', id % 1000, 'of b', id % 9) AS query")
    got = search.search_many(spark.createDataFrame(rows, ITEM), queries).groupBy("query_id").count().collect()
    want = {q: sum(1 for i in range(300) if f"notice{q % 1000}of" in f"notice{i}ofboardb{i % 7}" and f"b{q % 9}" in f"notice{i}ofboardb{i % 7}") for q in range(50_000)}
    assert {r["query_id"]: r["count"] for r in got} == {q: n for q, n in want.items() if n}


def test_saved_queries_of_the_same_terms_are_searched_once(spark, monkeypatch):
    rows = [item(i, f"notice {i} of board b{i % 7}") for i in range(40)]
    table = spark.range(3000).selectExpr("id AS query_id", "CASE id % 3 WHEN 0 THEN 'notice B1' WHEN 1 THEN ' b1  NOTICE b1' ELSE concat('zz', id) END AS query")
    asked, real = [], search.candidates
    monkeypatch.setattr(search, "candidates", lambda texts, needles: asked.append(needles.count()) or real(texts, needles))
    got = search.search_many(spark.createDataFrame(rows, ITEM), table).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {q: 6 for q in range(3000) if q % 3 != 2}
    assert asked == [1001]


@pytest.mark.parametrize("listed", [0, 64])
def test_many_needles_of_few_grams_shuffle_no_grams(spark, monkeypatch, listed):
    monkeypatch.setattr(grams, "BROADCAST_GRAMS", 1200)  # fewer than the needles, more than their grams
    monkeypatch.setattr(grams, "LISTED_GRAMS", listed)
    needles = spark.range(5000).selectExpr("id AS needle_id", "array(concat('n', id, 'z')) AS terms", "id % 2 AS side")
    texts_ = spark.range(50).selectExpr("id AS text_id", "array(concat('of n', id, 'z'), 'other') AS parts")
    found = grams.candidates(texts_, needles)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    kept = found.filter(F.exists("terms", lambda t: F.lit(True)) & (F.col("needle_id") == F.col("text_id"))).collect()
    assert found.columns == ["text_id", "needle_id", "terms", "side"] and sorted(r["text_id"] for r in kept) == list(range(50))


def brute_spans(text, terms):
    keep = [i for i, c in enumerate(text) if not c.isspace()]
    plain = "".join(text[i].lower() for i in keep)
    marks = [False] * len(text)
    glue = set()
    for t in terms:
        for at in range(len(plain) - len(t) + 1):
            if plain[at : at + len(t)] == t:
                for i in range(keep[at], keep[at + len(t) - 1] + 1):
                    marks[i] = True
    out, i = [], 0
    while i < len(text):
        if marks[i]:
            j = i
            while j < len(text) and marks[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    assert not glue
    return out


def test_spans_highlight_and_excerpt(spark):
    rnd = random.Random(3)
    rows = [("".join(rnd.choice("aAb c\n") for _ in range(rnd.randrange(40))),) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string").withColumn("s", search.match_spans(F.col("t"), ["ab", "aba", "c"]))
    df = df.withColumn("parts", search.highlight(F.col("t"), F.col("s"))).withColumn("cut", search.excerpt(F.col("t"), F.col("s"), 5))
    for r in df.collect():
        want = brute_spans(r["t"], ["ab", "aba", "c"])
        assert [(x["s"], x["e"]) for x in (r["s"] or [])] == want
        assert "".join(p["text"] for p in r["parts"] or []) == r["t"] or not want
        if want:
            s, e = want[0]
            lo, hi = max(0, s - 5), min(len(r["t"]), e + 5)
            assert r["cut"] == ("…" if lo else "") + r["t"][lo:hi] + ("…" if hi < len(r["t"]) else "")
            assert [p["text"] for p in r["parts"] if p["match"]] == [r["t"][a:b] for a, b in want]
    one = spark.createDataFrame([("국제 교류 협력",)], "t string").withColumn("s", search.match_spans(F.col("t"), ["국제교류"]))
    assert [tuple(p) for p in one.select(search.highlight(F.col("t"), F.col("s"))).first()[0]] == [("국제 교류", True), (" 협력", False)]


def test_no_hit_leaves_text_whole(spark):
    one = spark.createDataFrame([("학사 안내",)], "t string").withColumn("s", search.match_spans(F.col("t"), ["등록금"]))
    row = one.select(search.highlight(F.col("t"), F.col("s")).alias("p"), search.excerpt(F.col("t"), F.col("s")).alias("x")).first()
    assert [tuple(p) for p in row["p"]] == [("학사 안내", False)] and row["x"] == "학사 안내"


def test_best_match_field(spark):
    rows = [item(1, "장학 안내"), item(2, summary=["다른 줄", "장학 금액"]), item(3, target="장학 대상"), item(4, category="장학금"), item(5, "장학", analysed=False)]
    out = {r["id"]: (r["best_field"], r["best_text"]) for r in search.best_match(spark.createDataFrame(rows, ITEM), "장학 없음").collect()}
    assert out == {1: ("title", "장학 안내"), 2: ("summary", "장학 금액"), 3: ("target", "장학 대상"), 4: (None, None), 5: ("title", "장학")}


# --- validation and analyser ------------------------------------------------------------------------------

def reply(**changes):
    base = {
        "category": "학사", "applicationStart": None, "applicationEnd": "2026-10-16", "deadline": "2026-10-16T18:00", "eventDate": None,
        "target": "학생", "summary": ["a", "b", "c"], "easyExplanation": "e",
        "evidence": {"applicationStart": None, "applicationEnd": "10월 16일", "deadline": "10월 16일", "eventDate": None}, "uncertain": [],
        "en": {"title": "t", "summary": ["a", "b", "c"], "easyExplanation": "e", "target": "s", "eventInfo": None},
    }
    return {**base, **changes}


def test_contract_and_warnings(spark):
    en = reply()["en"]
    no_deadline = {k: v for k, v in reply().items() if k != "deadline"}
    cases = {
        "ok": reply(), "enum": reply(category="없음"), "missing": no_deadline, "number": reply(target=3), "null text": reply(target=None),
        "list": reply(summary=["a", 1]), "null in list": reply(summary=["a", None]), "doubt": reply(uncertain=[{"field": "x"}]),
        "good doubt": reply(uncertain=[{"field": "x", "reason": "y", "extra": 1}]), "en": reply(en={**en, "summary": None}), "extra key": reply(more=1),
        "format": reply(deadline="내일"), "order": reply(applicationStart="2026-10-20", evidence={**reply()["evidence"], "applicationStart": "10월16일"}),
        "no quote": reply(eventDate="2026-10-01", evidence={**reply()["evidence"], "deadline": "12월"}), "bullets": reply(summary=["a"]),
        "info": reply(en={**en, "eventInfo": "hall"}),
    }
    rows = [(k, json.dumps(v, ensure_ascii=False), True) for k, v in cases.items()]
    rows += [("cut", json.dumps(reply())[:50], True), ("unfinished", json.dumps(reply()), False), ("text", "sorry", True)]
    out = validate.check_contract(spark.createDataFrame(rows, "k string, reply string, finished boolean"))
    body = F.lit("신청은 10월\n16일까지 합니다")
    out = out.withColumn("w", validate.validation_warnings(F.col("analysis"), body))
    got = {r["k"]: (r["error_class"], r["w"]) for r in out.collect()}
    schema_errors = {"enum", "missing", "number", "null text", "list", "null in list", "doubt", "en"}
    assert {k for k, v in got.items() if v[0] == "schema"} == schema_errors
    assert got["cut"][0] == got["text"][0] == "not_json" and got["unfinished"][0] == "incomplete"
    assert got["ok"] == (None, []) and got["good doubt"] == (None, []) and got["extra key"] == (None, [])
    assert got["format"][1] == ['deadline="내일" is not YYYY-MM-DD[THH:mm]']
    assert got["order"][1] == ["applicationStart is after applicationEnd"]
    assert got["no quote"][1] == [
        'deadline evidence "12월" not found verbatim in notice', "eventDate has a date but no evidence quote",
        "eventDate 2026-10-01 is before the deadline 2026-10-16T18:00; check which is which"]
    assert got["bullets"][1] == ["summary has 1 bullets (expected 3-6)", "en.summary has 3 bullets but summary has 1"]
    assert got["info"][1] == ["en.eventInfo is set but eventDate is null"]


def test_analyser_failures_are_rows(spark):
    def plug(row):
        if row["id"] == 1:
            raise analyse.AnalyserError("http_429", "quota")
        if row["id"] == 2:
            raise RuntimeError("boom")
        return row["prompt"].upper(), True

    work = spark.createDataFrame([(0, "h", "p"), (1, "h", "p"), (2, "h", "p")], "id long, content_hash string, prompt string")
    got = {r["id"]: (r["outcome"], r["reply"], r["message"]) for r in analyse.analyse(work, plug).collect()}
    assert got == {0: ("success", "P", None), 1: ("http_429", None, "quota"), 2: ("failed", None, "RuntimeError: boom")}
    assert {r["outcome"] for r in analyse.analyse(work, None).collect()} == {"deferred"}


# --- calendar -------------------------------------------------------------------------------------------------

def test_month_cells_and_shift(spark):
    sep = cal.month_cells(spark, 2026, 9).orderBy("date").collect()
    assert len(sep) == 35 and (sep[0]["date"], sep[0]["in_month"]) == (date(2026, 8, 30), False) and sum(c["in_month"] for c in sep) == 30
    assert cal.month_cells(spark, 2026, 2).count() == 28
    one = spark.range(1)
    assert one.select(cal.shift_month(F.lit("2026-12"), 1), cal.shift_month(F.lit("2026-01"), -1)).first() == ("2027-01", "2025-12")


def test_events_landing_and_next(spark):
    rows = [(1, "2026-10-16", "2026-11-06"), (2, "2026-09-01", "2026-09-30T14:00"), (3, "2026-09-01", None), (4, None, None), (5, "2026-09-30", None)]
    items = spark.createDataFrame([(i, f"t{i}", d, e, date(2026, 9, 1)) for i, d, e in rows], "id long, title string, due string, event_date string, published_at date")
    today = date(2026, 9, 23)
    land = {r["id"]: (r["landing_day"], r["href"]) for r in cal.landing_day(items, today).collect()}
    assert {i: v[0] for i, v in land.items()} == {1: "2026-10-16", 2: "2026-09-30", 3: "2026-09-01", 4: None, 5: "2026-09-30"}
    assert land[1][1] == "/calendar?month=2026-10&date=2026-10-16&notice=1" and land[4][1] is None
    events = cal.unpivot_events(items)
    day = [(r["kind"], r["id"]) for r in cal.events_by_day(events).filter("day = '2026-09-30'").orderBy("pos").collect()]
    assert day == [("deadline", 5), ("event", 2)]
    assert cal.next_event(events, date(2026, 10, 1)).first()["id"] == 1 and cal.next_event(events, date(2027, 1, 1)).count() == 0


def test_date_labels(spark):
    row = spark.range(1).select(
        *[dates.dday_label(F.lit(d), date(2026, 9, 24)) for d in ("2026-09-23", "2026-09-24", "2026-10-01T09:00")],
        dates.short_date(F.lit("2026-10-16T14:00")), dates.short_date(F.lit("2026-10-16"), "en"), dates.full_date(F.lit("2026-09-22"), "en"),
        dates.period(F.lit(None).cast("string"), F.lit("2026-10-16")), dates.csv_clock(F.lit("2026-10-16T00:05")), dates.csv_clock(F.lit("2026-10-16T12:00")),
        dates.csv_clock(F.lit("2026-10-16")), dates.csv_day(F.lit("2026-01-02")), dates.ics_utc(F.lit("2026-10-16T03:00")), dates.dotted_date(F.lit("작성일 2026.9.2.")),
        dates.seoul_day(F.lit("2026-09-22 15:30:00").cast("timestamp")).cast("string"), labels.board_label(F.lit(None), F.lit(None), "en"),
    ).first()
    assert list(row) == ["마감", "D-DAY", "D-7", "10.16(금) 14:00", "Oct 16 (Fri)", "September 22, 2026", "~ 10.16(금)", "12:05 AM", "12:00 PM", "", "1/2/2026",
                         "20261015T180000Z", "2026-09-02", "2026-09-23", "University"]


def test_csv_and_ics_files(spark, tmp_path):
    rows = [("deadline", "2026-10-16", 'a, "b"', "7", "u7"), ("event", "2026-10-16T14:05", "가나다라마바사 " * 12, "8", "u8")]
    events = spark.createDataFrame(rows, "kind string, date string, title string, source_notice_id string, source_url string").coalesce(1)
    assert files.write_csv(files.csv_rows(events, "en"), str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("part-*")).read_bytes().decode()
    lines = raw.split("\r\n")
    assert lines[0] == "﻿Subject,Start Date,Start Time,End Date,End Time,All Day Event,Description,Location,Private"
    assert lines[1].startswith('"[Deadline] a, ""b""",10/16/2026,,10/16/2026,,True,') and ",2:05 PM," in lines[2] and lines[3] == ""
    assert not files.write_csv(files.csv_rows(events.limit(0)), str(tmp_path / "none")) and not (tmp_path / "none").exists()

    blocks = files.ics_blocks(events, "20260924T000000Z", "notice", "x.org")
    assert files.write_ics(blocks, str(tmp_path / "ics"), "-//N//KO")
    raw = next((tmp_path / "ics").glob("part-*")).read_bytes()
    assert raw.startswith(b"BEGIN:VCALENDAR\r\n") and raw.endswith(b"END:VCALENDAR\r\n")
    assert all(len(line) <= 75 for line in raw.split(b"\r\n")) and b"DTEND;VALUE=DATE:20261017" in raw and b"DTSTART:20261016T050500Z" in raw
    back = {r["uid"]: r for r in files.read_ics(spark, str(tmp_path / "ics")).collect()}
    assert back["notice-7-deadline@x.org"]["title"] == '[신청 마감] a, "b"' and back["notice-7-deadline@x.org"]["all_day"]
    assert back["notice-8-event@x.org"]["title"] == f"[행사 일정] {rows[1][2]}" and back["notice-8-event@x.org"]["date"] == "2026-10-16T14:05"


def test_ics_import_cases(spark):
    text = "\r\n".join([
        "BEGIN:VCALENDAR", "BEGIN:VTIMEZONE", "DTSTART:19700101T000000", "END:VTIMEZONE", "BEGIN:VEVENT", "UID:lost", "BEGIN:VEVENT", "UID: a ", "SUMMARY;LANGUAGE=ko:one\\, t\\;wo\\nthr",
        " ee", "DTSTART;TZID=Asia/Seoul:20261016T140000", "RRULE:FREQ=DAILY", "END:VEVENT", "BEGIN:VEVENT", "DTSTART:20261016T160000Z", "END:VEVENT",
        "BEGIN:VEVENT", "UID:nodate", "SUMMARY:x", "END:VEVENT", "BEGIN:VEVENT", "UID:day", "DTSTART;VALUE=DATE:20261016", "SUMMARY:d", "END:VEVENT", "BEGIN:VEVENT", "UID:bad", "DTSTART:soon", "END:VEVENT", "END:VCALENDAR", ""])
    got = [tuple(r) for r in files.parse_ics(spark.createDataFrame([(text,)], "text string")).orderBy("seq").drop("seq").collect()]
    assert got == [("a", "one, t;wo\nthree", "2026-10-16T14:00", False), ("2026-10-17T01:00-", "", "2026-10-17T01:00", False), ("day", "d", "2026-10-16", True)]


# --- pages ------------------------------------------------------------------------------------------------------

LIST = """<table class="artclTable"><tbody>
<tr class="headline"><td><a class="artclLinkView" href="/bbs/x/8/11/artclView.do"><strong>고정 공지</strong><span>새글</span></a></td><td class="_artclTdRdate">2026.09.02.</td></tr>
<tr><td><a class="artclLinkView" href="/bbs/x/8/12/artclView.do"> 일반 <span>새글</span> 공지 </a></td><td class="_artclTdRdate">2026.9.3.</td></tr>
<tr><td><a class="artclLinkView" href="/bbs/other/9/13/artclView.do">남의 공지</a></td></tr><tr><td>no link</td></tr></tbody></table>"""


def test_list_pages(spark):
    rows = [("a", 1, LIST), ("a", 2, "<html><p>error</p></html>")]
    pages = spark.createDataFrame(rows, "source string, page int, html string").withColumns({
        "href_pattern": F.lit(r"/bbs/x/8/(\d+)/artclView\.do"), "url_prefix": F.lit("https://h/bbs/x/8/"), "url_suffix": F.lit("/artclView.do")})
    listed, rejected = pg.listed_from_pages(pages)
    got = [tuple(r) for r in listed.orderBy("row").select("source_notice_id", "url", "title", "listed_date", "pinned").collect()]
    assert got == [("11", "https://h/bbs/x/8/11/artclView.do", "고정 공지", "2026-09-02", True), ("12", "https://h/bbs/x/8/12/artclView.do", "일반 공지", "2026-09-03", False)]
    assert [(r["source"], r["page"]) for r in rejected.collect()] == [("a", 2)]


ARTICLE = """<h2 class="artclViewTitle"> 제목&nbsp;하나 </h2><div class="artclViewHead"><dl><dt>작성일</dt><dd>2026.09.22.</dd></dl><dl><dt>분류</dt><dd>모집</dd></dl>
<dl><dt>작성자</dt><dd></dd></dl></div><div class="artclView"><p>첫 줄 &amp; 끝<br/>둘째   줄<p>셋째 줄<ul><li>가<li>나</ul><script>x()</script><img src="/img/%ED%8F%AC 1.png"></div>
<a href="/bbs/x/download.do">양식.hwp</a>"""


def test_articles_and_quality_gate(spark):
    rows = [(1, "https://h", ARTICLE), (2, "https://h", "<h2 class='artclViewTitle'>t</h2>"), (3, "https://h", "<h2 class='artclViewTitle'>t</h2><div class='artclView'><p>길이가 충분한 본문입니다. 서른 글자가 넘도록 조금 더 적어 둡니다.</p></div>")]
    out = pg.articles_from_pages(spark.createDataFrame(rows, "page_id int, origin string, html string"))
    got = {r["page_id"]: r for r in pg.quality_gate(out.withColumn("n_attachments", F.size("attachments"))).collect()}
    a = got[1]
    assert (a["title"], a["board_category"], a["author"], a["published_at"]) == ("제목 하나", "모집", None, date(2026, 9, 22))
    assert a["original_content"] == "첫 줄 & 끝\n둘째 줄\n셋째 줄\n가\n나"
    assert [tuple(x) for x in a["attachments"]] == [("image", "포 1.png", "https://h/img/%ED%8F%AC%201.png"), ("file", "양식.hwp", "https://h/bbs/x/download.do")]
    assert a["error_class"] == "empty_content" and "2 image/file attachment(s)" in a["error"]
    assert got[2]["error_class"] == "structure" and got[3]["error_class"] is None
    assert got[1]["raw_html"].startswith("<p>첫 줄") and got[1]["raw_html"].endswith('1.png">')


def test_native_markup_expressions(spark):
    html = "<dl><dt>a</dt><dd>1</dd></dl><dl><dt> b </dt><dd>x &amp; <b>y</b></dd></dl><dl><dt>a</dt><dd>2</dd></dl>"
    df = spark.createDataFrame([(html, "<p>one<br>two</p><script>no()</script><div> three  four </div><!-- c -->")], "h string, t string")
    row = df.select(pg.metadata_map(F.col("h")).alias("m"), texts.html_to_text(F.col("t")).alias("t")).first()
    assert row["m"] == {"a": "2", "b": "x & y"} and row["t"] == "one\ntwo\nthree four"


def test_urls(spark):
    rows = [(" http://h/bbs/x/8/45/artclView.do?a=1#t ",), ("https://h/bbs/y/9/46/artclView.do",), ("https://h/other",)]
    boards = spark.createDataFrame([("main", 0, "https://h/bbs/x/8/"), ("dept", 1, "https://h/bbs/y/9/")], "source string, ord int, url_prefix string")
    out = pg.route_urls(pg.parse_article_url(spark.createDataFrame(rows, "url string"), "url"), boards).orderBy("canonical_url").collect()
    assert [(r["article_id"], r["source"]) for r in out] == [("45", "main"), ("46", "dept"), (None, "main")]


@pytest.mark.parametrize("lang, want", [("ko", ("제목", "줄", False)), ("en", ("T", "line", False))])
def test_language_projection(spark, lang, want):
    df = spark.createDataFrame([("제목", ["줄"], ("T", ["line"], "", "", None))], "title string, summary array<string>, en struct<title:string,summary:array<string>,easyExplanation:string,target:string,eventInfo:string>")
    none = F.lit(None).cast("string")
    row = df.select(labels.notice_title(F.col("title"), F.col("en"), lang), labels.summary_line(F.col("summary"), none, F.col("en"), lang),
                    labels.english_missing(F.lit(True), F.col("en"), lang)).first()
    assert tuple(row) == want


def test_deeply_nested_page_is_walked():
    deep = "<div>" * 3000 + "inside" + "</div>" * 3000
    root = pg._Tree(f"<section>{deep}<p>one<br>two</p><p>three</p></section>").root
    out = []
    root.lines(out)
    assert len(list(root.find(("div", None)))) == 3000 and root.text() == "insideonetwothree"
    assert [line for line in "".join(out).split("\n") if line] == ["inside", "one", "two", "three"]
