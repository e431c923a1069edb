"""Matching scenarios, and rankings of many profiles against scoring every pair."""

import random
from datetime import date, timedelta
from itertools import groupby

from pyspark.sql import functions as F

from noticelake import dims
from noticelake.operators import audience, match
from noticelake.sources.profiles import load_profiles, validate_profiles

TODAY = date(2026, 9, 24)
ITEM = "id long, title string, category string, target string, b_majors array<string>, b_colleges array<string>, due string, event_date string, published_at date, source_url string, title_en string"
PROFILE = "profile_id string, college string, major string, year int, entrance_year int, interests array<string>"
CSE = ("AI융합대학", "컴퓨터공학과", 1, 2026, [])
MECH = ("공과대학", "기계공학과", 1, 2026, [])


def item(i, target, title=None, category="기타", boards=(), colleges=(), due=None, event=None, published=date(2026, 9, 20)):
    return (i, title or f"공지 {i}", None if target is None else category, target, list(boards), list(colleges), due, event, published, "u", None)


def features(spark, items):
    df = spark.createDataFrame(items, ITEM)
    return match.notice_features(df, dims.unit_terms(), dims.INTEREST_RULES, TODAY)


def score(spark, cases):
    """cases: name -> (profile, item)."""
    items = [(n, *c[1][1:]) for n, c in enumerate(cases.values())]
    people = [(str(n), *c[0]) for n, c in enumerate(cases.values())]
    f = features(spark, items)
    p = match.with_profile(spark.createDataFrame(people, PROFILE)).withColumn("id", F.col("profile_id").cast("long"))
    rows = {r["id"]: r for r in match.score_pairs(f.join(p, "id"), TODAY).collect()}
    return {name: rows[n] for n, name in enumerate(cases)}


def test_rule_scenarios(spark):
    me = lambda **kw: tuple({**dict(zip("cmyei", CSE, strict=True)), **kw}.values())
    got = score(spark, {
        "own major": (CSE, item(0, "컴퓨터공학과 재학생")),
        "title unit": (CSE, item(0, "참가 희망 학생", title="[컴퓨터공학과] 캡스톤 설명회")),
        "broad": (CSE, item(0, "2026학년도 재학생(학부생) 전체")),
        "other major": (CSE, item(0, "기계공학과 3학년 재학생")),
        "other college": (CSE, item(0, "공과대학 재학생")),
        "graduates": (CSE, item(0, "일반대학원 석사과정 대학원생")),
        "mixed": (CSE, item(0, "학부생, 대학원생")),
        "years": (CSE, item(0, "3학년 2학기 또는 4학년 1학기 재학생")),
        "semesters": (CSE, item(0, "4학기 이상 이수한 학부 재학생")),
        "excluded year": (CSE, item(0, "학부 재학생 (1학년 불가)")),
        "interest": (me(i=["scholarship"]), item(0, "학부 재학생 전체", category="장학금")),
        "pending keyword": (me(i=["scholarship"]), item(0, None, title="[학부-교외장학] 봄내장학생 선발 안내")),
        "year two": (me(y=2), item(0, "2학년 재학생")),
        "own board": (CSE, item(0, "참가 희망 학생", boards=["컴퓨터공학과"], colleges=["AI융합대학"])),
        "sibling board": (me(m="데이터사이언스학과"), item(0, "참가 희망 학생", boards=["컴퓨터공학과"], colleges=["AI융합대학"])),
        "board beats title": (CSE, item(0, "참가 희망 학생", title="[컴퓨터공학과] 설명회", boards=["컴퓨터공학과"], colleges=["AI융합대학"])),
        "exclusion beats board": (CSE, item(0, "일반대학원 석사과정 대학원생", boards=["컴퓨터공학과"])),
        "former college": (CSE, item(0, "소프트웨어융합대학 재학생")),
        "longest name": (MECH, item(0, "파이낸스경영학과 학생")),
        "alias": (("경영대학", "경영학과", 2, 2025, []), item(0, "경영학부 학생")),
        "cohort": (CSE, item(0, "26학번 신입생")),
        "range": (CSE, item(0, "1~2학년")),
    })
    flat = {k: (r["score"], r["level"], list(r["reasons"])) for k, r in got.items()}
    assert flat["own major"] == (50, "high", ["컴퓨터공학과 대상"])
    assert flat["title unit"] == (35, "medium", ["컴퓨터공학과 공지"])
    assert flat["broad"] == (25, "medium", ["학부생 전체 대상"])
    assert flat["other major"] == (0, "none", ["다른 학과 대상 (기계공학과)"])
    assert flat["other college"] == (0, "none", ["다른 단과대학 대상 (공과대학)"])
    assert flat["graduates"] == (0, "none", ["대학원생 대상"])
    assert flat["mixed"][1] != "none"
    assert flat["years"] == (0, "none", ["3학년·4학년 대상"])
    assert flat["semesters"] == (0, "none", ["4학기 이상 이수 조건"])
    assert flat["excluded year"] == (0, "none", ["1학년 제외"])
    assert flat["interest"] == (55, "high", ["학부생 전체 대상", "관심 분야: 장학금"])
    assert flat["pending keyword"][0] == 20 and got["pending keyword"]["title_only"]
    assert flat["year two"] == (25, "medium", ["2학년 대상"])
    assert flat["own board"] == (35, "medium", ["컴퓨터공학과 게시판 공지"])
    assert got["own board"]["reasons_en"] == ["Posted on the 컴퓨터공학과 board"]
    assert flat["sibling board"] == (20, "low", ["AI융합대학 게시판 공지"])
    assert flat["board beats title"][2] == ["컴퓨터공학과 게시판 공지"]
    assert flat["exclusion beats board"][1] == "none"
    assert flat["former college"][2] == ["AI융합대학 대상"]
    assert flat["longest name"][2] == ["다른 학과 대상 (파이낸스경영학과)"]
    assert flat["alias"][2] == ["경영학과 대상"]
    assert flat["cohort"] == (25, "medium", ["신입생·26학번 대상"])
    assert got["cohort"]["reasons_en"] == ["For first-year students, class of '26"]
    assert flat["range"][2] == ["1~2학년·2학년 대상"]


def test_longer_name_starting_inside_a_shorter_hit(spark):
    terms = [("AB", "AB", "x"), ("BCD", "BCD", "x")]
    df = spark.createDataFrame([("ABCD",), ("AB BCD",)], "t string")
    out = [list(r[0]) for r in df.select(match.unit_names(match.find_terms(F.col("t"), terms), terms)[0]).collect()]
    assert out == [["BCD"], ["BCD", "AB"]]


def test_names_by_index_equal_names_one_by_one(spark):
    rnd = random.Random(5)
    names = sorted({"".join(rnd.choice("ABC") for _ in range(rnd.randrange(1, 6))) for _ in range(60)})
    terms = [(n, n if rnd.random() < 0.7 else None, f"col{k % 4}") for k, n in enumerate(names)]
    texts = [(i, "".join(rnd.choice("ABC  d") for _ in range(rnd.randrange(0, 25)))) for i in range(150)] + [(900, None), (901, "")]
    df = spark.createDataFrame(texts, "text_id long, text string")
    units = spark.createDataFrame(terms, "term string, major string, college string")
    listed = df.select("text_id", match.find_terms(F.col("text"), terms).alias("h")).collect()
    order = [t[0] for t in match._longest_first(terms)]
    want = {r["text_id"]: [order[i] for i in r["h"]] for r in listed if r["h"]}
    got = {r["text_id"]: [t["term"] for t in r["hits"]] for r in match.unit_hits(df, units).collect()}
    assert got == want


def test_names_of_title_and_target_go_through_one_index(spark, monkeypatch):
    calls, real = [], match.candidates
    monkeypatch.setattr(match, "candidates", lambda texts, needles: calls.append(1) or real(texts, needles))
    units = spark.createDataFrame([(f"Unit{i}", f"major{i}" if i % 2 else None, f"col{i % 3}") for i in range(600)], "term string, major string, college string")
    rows = [item(1, "for Unit3 and Unit8", "Unit5"), item(2, None, "Unit12 and Unit7"), item(3, "Unit7", "none"), item(4, "x", "y")]
    rows.append((5, None, None, "Unit9", [], [], None, None, None, "u", None))
    got = {r["id"]: r for r in match.notice_features(spark.createDataFrame(rows, ITEM), units, dims.INTEREST_RULES, TODAY).collect()}
    names = lambda i: [got[i][c] for c in ("t_majors", "t_colleges", "n_majors", "n_colleges")]
    assert names(1) == [["major3"], ["col2"], ["major5"], ["col2"]]
    assert names(2) == [[], [], ["major7"], ["col0", "col1"]]
    assert names(3) == [["major7"], [], [], []] and names(4) == [[], [], [], []] and names(5)[0] == ["major9"]
    assert len(calls) == 1


def test_fifty_thousand_names(spark):
    units = spark.range(50_000).selectExpr("concat('Unit', id, 'Z') AS term", "concat('major', id) AS major", "'c' AS college")
    df = spark.createDataFrame([(i, f"for Unit{i * 7}Z and Unit{i}Z, not Unit{i}") for i in range(200)], "text_id long, text string")
    got = {r["text_id"]: {t["major"] for t in r["hits"]} for r in match.unit_hits(df, units).collect()}
    assert got == {i: {f"major{i * 7}", f"major{i}"} for i in range(200)}
    assert not isinstance(match.terms_from_units(units), list)


def random_world(seed, n_items=220, n_people=40):
    rnd = random.Random(seed)
    majors = ["컴퓨터공학과", "인공지능공학과", "기계공학과", "화학과"]
    college = {"컴퓨터공학과": "AI융합대학", "인공지능공학과": "AI융합대학", "기계공학과": "공과대학", "화학과": "자연과학대학"}
    targets = [
        None, "전체 학생", "대학원생", "1, 2학년 제외한 재학생", "3학년 이상 재학생", "25학번 재학생", "24학번", "26학번, 4학년", "4학기 이상 재학생",
        "학부생 (2학년 불가)", "참가 희망자", "1~2학년 또는 졸업예정자", *[f"{m} 재학생" for m in majors], "공과대학 2학년", "AI융합대학 학생, 화학과",
    ]
    items, people = [], []
    for i in range(n_items):
        m = rnd.choice(majors)
        due = rnd.choice([None, *[(TODAY + timedelta(days=d)).isoformat() + rnd.choice(["", "T10:00"]) for d in range(-4, 12)]])
        event = rnd.choice([None, (TODAY + timedelta(days=rnd.randrange(-3, 40))).isoformat()])
        target = rnd.choice(targets)
        if target is None:
            due = event = None
        board = rnd.random() < 0.3
        items.append(item(i, target, title=rnd.choice([f"공지 {i}", f"[{m}] 특강", "장학 안내"]), category=rnd.choice(dims.CATEGORIES),
                          boards=[m] if board else [], colleges=[college[m]] if board else [], due=due, event=event,
                          published=TODAY - timedelta(days=rnd.randrange(30))))
    for p in range(n_people):
        m = rnd.choice(majors)
        year = rnd.randint(1, 4)
        people.append((f"p{p}", college[m], m, year, rnd.choice([2026 - year + 1, 2025]), rnd.sample(list(dims.INTEREST_RULES), rnd.randrange(3))))
    return items, people


def every_pair(f, p):
    return match.score_pairs(f.crossJoin(p), TODAY).select(
        "profile_id", "id", "score", "level", "due", "event_date", "published_at", "reasons").collect()


def test_rankings_equal_scoring_every_pair(spark):
    items, people = random_world(5)
    f = features(spark, items).cache()
    p = match.with_profile(spark.createDataFrame(people, PROFILE)).cache()
    pairs = every_pair(f, p)
    age = lambda r: (TODAY - r["published_at"]).days

    open_ = [r for r in pairs if r["score"] >= 25 and (r["due"] is None or r["due"][:10] >= TODAY.isoformat())]
    open_.sort(key=lambda r: (r["profile_id"], -r["score"], r["due"] is None, r["due"] or "", age(r), -r["id"]))
    want = {k: [(r["id"], r["score"]) for r in list(g)[:6]] for k, g in groupby(open_, key=lambda r: r["profile_id"])}
    got = {}
    for r in sorted(audience.for_you(f, p, TODAY).collect(), key=lambda r: (r["profile_id"], r["rank"])):
        got.setdefault(r["profile_id"], []).append((r["id"], r["score"]))
    assert got == want

    counts = {r["id"]: (r["n_high"], r["n_medium"], r["n_low"], r["n_none"]) for r in audience.level_counts(f, p, TODAY).collect()}
    for i in counts:
        levels = [r["level"] for r in pairs if r["id"] == i]
        assert counts[i] == tuple(levels.count(v) for v in ("high", "medium", "low", "none"))

    near = []
    for r in pairs:
        for n, (kind, when) in enumerate((("deadline", r["due"]), ("event", r["event_date"]))):
            if r["level"] != "none" and when and TODAY.isoformat() <= when[:10] <= (TODAY + timedelta(days=30)).isoformat():
                near.append((r["profile_id"], when, age(r), -r["id"], n, kind, r["id"]))
    near.sort()
    want = {k: [(e[6], e[5]) for e in list(g)[:6]] for k, g in groupby(near, key=lambda e: e[0])}
    got = {}
    for r in sorted(audience.upcoming(f, p, TODAY).collect(), key=lambda r: (r["profile_id"], r["rank"])):
        got.setdefault(r["profile_id"], []).append((r["id"], r["kind"]))
    assert got == want

    member = {r["profile_id"]: r["segment"] for r in audience.with_segment(p).collect()}
    high = {(r["id"], r["segment"]): list(r["reasons"]) for r in audience.high_matches(f, p, TODAY).collect()}
    assert high == {(r["id"], member[r["profile_id"]]): list(r["reasons"]) for r in pairs if r["level"] == "high"}

    feed = audience.notification_feed(f, p, TODAY).collect()
    recent = {r["id"] for r in pairs if age(r) < 14}
    assert {m["id"] for m in feed} == recent
    for i in recent:
        assert sum(m["n_profiles"] for m in feed if m["id"] == i) == len(people)


def test_profiles_are_validated(spark, tmp_path):
    raw = [
        (0, None, ("소프트웨어융합대학", " 컴퓨터공학과 ", "1", "2026", ["scholarship", "bogus", "scholarship"])),
        (1, "x", ("소프트웨어융합대학", "컴퓨터공학과", "7", "2026", [])), (2, "y", ("c", "  ", "1", "2026", [])),
        (3, "z", (None, "m", "1", "2026", [])), (4, "w", ("c", "m", "2", "2026.5", [])), (5, "v", ("c", "m", "2", "1999", None)),
        (6, "ok", ("c", "m", "2", "2025", None)),
    ]
    df = spark.createDataFrame(raw, "pos long, id string, profile struct<college:string,major:string,year:string,entranceYear:string,interests:array<string>>")
    got = [tuple(r) for r in validate_profiles(df).orderBy("profile_id").collect()]
    assert got == [("ok", "c", "m", 2, 2025, []), ("profile-1", "AI융합대학", "컴퓨터공학과", 1, 2026, ["scholarship"])]
    path = tmp_path / "profiles.json"
    path.write_text('[{"profile": {"college": "c", "major": "m", "year": 3, "entranceYear": 2024, "interests": ["career"]}},'
                    ' {"id": "b", "profile": {"college": "c", "major": "m", "year": 9, "entranceYear": 2024}}]')
    assert [tuple(r) for r in load_profiles(spark, str(path)).collect()] == [("profile-1", "c", "m", 3, 2024, ["career"])]
