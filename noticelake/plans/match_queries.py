"""Queries over profiles: validation, matching rules, rankings and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.operators import audience, match
from noticelake.plans import adapters as ad
from noticelake.plans.adapters import ctes
from noticelake.plans.registry import query
from noticelake.sources.profiles import validate_profiles

ITEMS = (ad.NOTICE_ORDERS, ad.ANALYSIS_ORDERS, ad.ORDER_ITEMS, ad.ORDER_BOARDS)
LABELS = {name: (f"{name.lower()} 분야", name.title()) for name in ad.ORDER_INTERESTS}


def unit_table(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = ad.table(spark, sf, "nation"), ad.table(spark, sf, "region")
    majors = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("term"), F.col("n_name").alias("major"), F.col("r_name").alias("college"))
    colleges = region.select(F.col("r_name").alias("term"), F.lit(None).cast("string").alias("major"), F.col("r_name").alias("college"))
    return majors.unionByName(colleges).orderBy("term")


def feature_items(spark: SparkSession, sf: str) -> DataFrame:
    items = ad.order_items(spark, sf).withColumn("title_en", F.when(F.col("id") % 2 == 0, F.concat(F.lit("EN "), "title")))
    units = ad.order_boards(spark, sf).select(
        "source",
        F.array_compact(F.array("major")).alias("b_majors"),
        F.array_compact(F.array("college")).alias("b_colleges"),
    )
    return items.join(F.broadcast(units), "source")  # one row per board; every notice here has one copy


def features(spark: SparkSession, sf: str) -> DataFrame:
    return match.notice_features(feature_items(spark, sf), match.terms_from_units(unit_table(spark, sf)), ad.ORDER_INTERESTS, ad.TODAY_ORDERS)


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return match.with_profile(ad.profile_customers(spark, sf))


def reader_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Who opened which notice: every line item as (order, part), the part number folded onto the customer numbers."""
    lines, readers = ad.table(spark, sf, "lineitem"), max(1, ad.table(spark, sf, "customer").count())
    seen = lines.select(F.col("l_orderkey").alias("id"), F.pmod("l_partkey", F.lit(readers)).cast("string").alias("profile_id")).distinct()
    return seen.join(profiles(spark, sf), "profile_id").join(features(spark, sf), "id")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return match.score_pairs(reader_pairs(spark, sf), ad.TODAY_ORDERS, LABELS)


def _labels_sql(column: str, ko: bool) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v[0 if ko else 1]}'" for k, v in LABELS.items())
    return f"CASE {column} {cases} END"


def _hits_sql() -> str:
    parts = []
    for name, (categories, keywords) in ad.ORDER_INTERESTS.items():
        cats = f"WHEN category IN ({', '.join(repr(c) for c in categories)}) THEN 30 " if categories else ""
        parts.append(f"'{name}': CASE {cats}WHEN regexp_matches(title, '{keywords}') THEN 20 ELSE 0 END")
    return "MAP {" + ", ".join(parts) + "}"


FEAT = rf"""unit_text AS (
  SELECT i.*, coalesce(i.target, '') AS tg, b.major AS b_major, b.college AS b_college, r.r_name AS n_college, n.n_name AS n_major
  FROM order_items i JOIN order_boards b USING (source)
  JOIN nation n ON n.n_name = regexp_extract(i.title, 'NATION_[0-9]+') JOIN region r ON r.r_regionkey = n.n_regionkey),
feat AS (
  SELECT *, list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(tg, 'NATION_[0-9]+')), lambda x: (99 - length(x)) || x)), lambda x: x[3:]) AS t_majors,
    list_distinct(regexp_extract_all(tg, 'AFRICA|AMERICA|ASIA|EUROPE|MIDDLE EAST')) AS t_colleges,
    list_concat(flatten(list_transform(plus, lambda y: range(CAST(y AS INTEGER), 5))), list_concat(
      flatten(list_transform(range(1, len(lo) + 1), lambda k: range(CAST(lo[k] AS INTEGER), CAST(hi[k] AS INTEGER) + 1))), list_concat(
      list_transform(single, lambda y: CAST(y AS BIGINT)), list_concat(CASE WHEN contains(tg, '신입생') THEN [CAST(1 AS BIGINT)] ELSE [] END, list_concat(
      CASE WHEN regexp_matches(tg, '졸업\s*예정자') THEN [CAST(4 AS BIGINT)] ELSE [] END,
      list_filter(list_transform(cohort, lambda c: 2002 - c), lambda y: y BETWEEN 1 AND 4)))))) AS years,
    array_to_string(list_concat(list_transform(plus, lambda y: y || '학년 이상'), list_concat(
      list_transform(range(1, len(lo) + 1), lambda k: lo[k] || '~' || hi[k] || '학년'), list_concat(
      list_transform(single, lambda y: y || '학년'), list_concat(CASE WHEN contains(tg, '신입생') THEN ['신입생'] ELSE [] END, list_concat(
      CASE WHEN regexp_matches(tg, '졸업\s*예정자') THEN ['졸업예정자'] ELSE [] END, list_transform(cohort, lambda c: (c - 2000) || '학번')))))), '·') AS year_label,
    array_to_string(list_concat(list_transform(plus, lambda y: 'year ' || y || '+'), list_concat(
      list_transform(range(1, len(lo) + 1), lambda k: 'years ' || lo[k] || '–' || hi[k]), list_concat(
      list_transform(single, lambda y: 'year ' || y), list_concat(CASE WHEN contains(tg, '신입생') THEN ['first-year students'] ELSE [] END, list_concat(
      CASE WHEN regexp_matches(tg, '졸업\s*예정자') THEN ['expected graduates'] ELSE [] END, list_transform(cohort, lambda c: 'class of ''' || (c - 2000))))))), ', ') AS year_label_en,
    list_distinct(list_transform(regexp_extract_all(array_to_string(regexp_extract_all(tg, '(([1-4]\s*,\s*)*[1-4])\s*학년[^,.)]*?(불가|제외)', 1), ','), '[1-4]'), lambda y: CAST(y AS INTEGER))) AS excluded_years,
    list_transform(regexp_extract_all(tg, '([0-9]{{1,2}})\s*학기\s*이상', 1), lambda y: CAST(y AS INTEGER)) AS semesters,
    regexp_matches(tg, '대학원생|석사|박사') AND NOT contains(tg, '학부') AS grad_only,
    regexp_matches(tg, '학부생|재학생|전체\s*학생|학생\s*전체|전체') AND NOT regexp_matches(tg, '대학원생|석사|박사')
      AND NOT regexp_matches(tg, '이수\s*중|이수자|이수예정자|취득|해당|참여자|수강생|수혜자\s*중|선정된|선발된|소지자') AS broad,
    {_hits_sql()} AS hits
  FROM (SELECT *, regexp_extract_all(tg, '([1-4])\s*학년\s*이상', 1) AS plus,
          regexp_extract_all(tg, '([1-4])\s*[~∼-]\s*([1-4])\s*학년', 1) AS lo, regexp_extract_all(tg, '([1-4])\s*[~∼-]\s*([1-4])\s*학년', 2) AS hi,
          list_transform(regexp_extract_all(tg, '([0-9]{{2}}|[0-9]{{4}})\s*학번', 1), lambda c: 2000 + CAST(right(c, 2) AS BIGINT)) AS cohort,
          regexp_extract_all(regexp_replace(regexp_replace(tg, '[1-4]\s*학년\s*이상', '#', 'g'),
            '([1-4]\s*,\s*)*[1-4]\s*학년[^,.)]{{0,10}}?(불가|제외)', '#', 'g'), '([1-4])\s*학년', 1) AS single
        FROM unit_text))"""

READERS = """pairs AS (
  SELECT f.*, p.profile_id, p.college AS p_college, p.major AS p_major, p.year AS p_year, p.entrance_year AS p_entrance, p.interests AS p_interests
  FROM (SELECT DISTINCT l_orderkey, CAST(l_partkey % (SELECT count(*) FROM customer) AS VARCHAR) AS reader FROM lineitem) l
  JOIN profiles p ON p.profile_id = l.reader JOIN feat f ON f.id = l.l_orderkey)"""

SEGMENTS = """segs AS (SELECT college AS p_college, major AS p_major, year AS p_year, entrance_year AS p_entrance, interests AS p_interests,
  count(*) AS n_profiles FROM profiles GROUP BY ALL)"""

SCORED = f"""rules1 AS (
  SELECT *, CASE WHEN list_contains(t_majors, p_major) THEN 50 WHEN list_contains(t_colleges, p_college) THEN 30 ELSE 0 END AS s_unit,
    CASE WHEN list_contains(cohort, p_entrance) OR list_contains(years, p_year) THEN 'pass' WHEN len(years) > 0 THEN 'fail' ELSE 'none' END AS year_state,
    list_filter(semesters, lambda s: s > (p_year - 1) * 2)[1] AS need,
    list_max(list_transform(p_interests, lambda i: hits[i])) AS s_interest
  FROM pairs),
rules2 AS (
  SELECT *, CASE WHEN s_unit > 0 THEN 0 WHEN b_major = p_major THEN 35 WHEN b_college = p_college THEN 20 ELSE 0 END AS s_board,
    CASE WHEN year_state = 'pass' THEN 25 ELSE 0 END AS s_year,
    CASE WHEN s_interest > 0 THEN list_filter(p_interests, lambda i: hits[i] = s_interest)[1] END AS interest,
    CASE WHEN s_unit = 0 AND len(t_majors) > 0 THEN '다른 학과 대상 (' || array_to_string(t_majors[1:2], ', ') || ')'
         WHEN s_unit = 0 AND len(t_colleges) > 0 THEN '다른 단과대학 대상 (' || array_to_string(t_colleges[1:2], ', ') || ')' END AS x_unit,
    CASE WHEN grad_only THEN '대학원생 대상' END AS x_grad,
    CASE WHEN list_contains(excluded_years, p_year) THEN p_year || '학년 제외' END AS x_excluded_year,
    CASE WHEN year_state = 'fail' THEN year_label || ' 대상' END AS x_year,
    CASE WHEN need IS NOT NULL THEN need || '학기 이상 이수 조건' END AS x_semester
  FROM rules1),
rules3 AS (
  SELECT *, CASE WHEN s_unit > 0 OR s_board > 0 THEN 0 WHEN n_major = p_major THEN 35 WHEN n_college = p_college THEN 20 ELSE 0 END AS s_title,
    CASE WHEN broad AND s_unit = 0 AND s_year = 0 THEN 25 ELSE 0 END AS s_broad,
    coalesce(x_unit, x_grad, x_excluded_year, x_year, x_semester) AS excluded
  FROM rules2),
rules4 AS (
  SELECT *, CASE WHEN excluded IS NOT NULL THEN 0 ELSE least(100, s_unit + s_board + s_title + s_year + s_broad + s_interest) END AS score FROM rules3),
scored AS (
  SELECT *, CASE WHEN excluded IS NOT NULL THEN 'none' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level,
    CASE WHEN excluded IS NOT NULL THEN [excluded] ELSE list_filter([
      CASE s_unit WHEN 50 THEN p_major || ' 대상' WHEN 30 THEN p_college || ' 대상' END,
      CASE s_board WHEN 35 THEN p_major || ' 게시판 공지' WHEN 20 THEN p_college || ' 게시판 공지' END,
      CASE s_title WHEN 35 THEN p_major || ' 공지' WHEN 20 THEN p_college || ' 공지' END,
      CASE WHEN s_year > 0 THEN year_label || ' 대상' END, CASE WHEN s_broad > 0 THEN '학부생 전체 대상' END,
      CASE WHEN s_interest > 0 THEN '관심 분야: ' || {_labels_sql('interest', True)} END], lambda x: x IS NOT NULL) END AS reasons,
    CASE WHEN excluded IS NOT NULL THEN [CASE WHEN x_unit IS NOT NULL THEN 'For another ' || CASE WHEN len(t_majors) > 0 THEN 'major (' || array_to_string(t_majors[1:2], ', ')
        ELSE 'college (' || array_to_string(t_colleges[1:2], ', ') END || ')'
      WHEN x_grad IS NOT NULL THEN 'For graduate students' WHEN x_excluded_year IS NOT NULL THEN 'Year ' || p_year || ' excluded'
      WHEN x_year IS NOT NULL THEN 'For ' || year_label_en ELSE 'Requires ' || need || '+ completed semesters' END] ELSE list_filter([
      CASE s_unit WHEN 50 THEN 'For ' || p_major WHEN 30 THEN 'For ' || p_college END,
      CASE s_board WHEN 35 THEN 'Posted on the ' || p_major || ' board' WHEN 20 THEN 'Posted on the ' || p_college || ' board' END,
      CASE s_title WHEN 35 THEN 'Posted by ' || p_major WHEN 20 THEN 'Posted by ' || p_college END,
      CASE WHEN s_year > 0 THEN 'For ' || year_label_en END, CASE WHEN s_broad > 0 THEN 'Open to all undergraduates' END,
      CASE WHEN s_interest > 0 THEN 'Interest: ' || {_labels_sql('interest', False)} END], lambda x: x IS NOT NULL) END AS reasons_en
  FROM rules4)"""

PAIRED = (*ITEMS, FEAT, ad.PROFILES, READERS, SCORED)


def _crossed(where: str = "TRUE") -> tuple[str, ...]:
    every = f"pairs AS (SELECT f.*, s.* FROM feat f CROSS JOIN segs s WHERE {where})"
    return (*ITEMS, FEAT, ad.PROFILES, SEGMENTS, every, SCORED)


PROFILE_OF_SEGMENT = """JOIN profiles p ON p.college = s.p_college AND p.major = s.p_major AND p.year = s.p_year
  AND p.entrance_year = s.p_entrance AND p.interests = s.p_interests"""


@query(
    "profile_validate",
    """SELECT CASE WHEN c_custkey % 11 = 0 THEN 'profile-' || (c_custkey + 1) ELSE 'c' || c_custkey END AS profile_id,
  CASE WHEN c_nationkey = 3 THEN 'New college' ELSE 'College ' || c_nationkey END AS college, c_name AS major,
  c_custkey % 4 + 1 AS year, 2002 - c_custkey % 4 AS entrance_year,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END AS interests
FROM customer WHERE c_custkey % 50 <> 0 AND 2002 - c_custkey % 4 >= 2000 AND c_custkey % 13 <> 1""",
)
def _(spark, sf):
    """Customers as untrusted profiles: some years, entrance years and majors are unusable."""
    c = F.col("c_custkey")
    raw = ad.table(spark, sf, "customer").select(
        c.alias("pos"),
        F.when(c % 11 != 0, F.concat(F.lit("c"), c.cast("string"))).alias("id"),
        F.struct(
            F.when(F.col("c_nationkey") == 3, "Old college").otherwise(F.concat(F.lit("College "), F.col("c_nationkey").cast("string"))).alias("college"),
            F.when(c % 13 == 1, "  ").otherwise(F.concat(F.lit(" "), "c_name")).alias("major"),
            F.when(c % 50 == 0, "7").otherwise((c % 4 + 1).cast("string")).alias("year"),
            (F.lit(2002) - c % 4).cast("string").alias("entranceYear"),
            F.array("c_mktsegment", F.lit("bogus"), "c_mktsegment").alias("interests"),
        ).alias("profile"),
    )
    known = [i for i in ad.ORDER_INTERESTS if i != "MACHINERY"]
    out = validate_profiles(raw, known, {"Old college": "New college"})
    return out.withColumn("interests", F.array_join("interests", ","))


@query("unit_terms", ctes(*ITEMS, FEAT) + "SELECT id, array_to_string(t_majors, ',') AS majors, array_to_string(t_colleges, ',') AS colleges FROM feat")
def _(spark, sf):
    return features(spark, sf).select("id", F.array_join("t_majors", ",").alias("majors"), F.array_join("t_colleges", ",").alias("colleges"))


@query(
    "unit_terms_index",
    ctes(*ITEMS, FEAT)
    + """, people AS (SELECT c_name AS term FROM customer)
SELECT id, array_to_string(t_majors, ',') AS majors, array_to_string(t_colleges, ',') AS colleges, len(t_majors) AS n_majors FROM feat""",
)
def _(spark, sf):
    """The same names through the index, in a unit table that also holds every customer's name as a unit."""
    people = ad.table(spark, sf, "customer").select(F.col("c_name").alias("term"), F.col("c_name").alias("major"), F.lit("-").alias("college"))
    out = match.notice_features(feature_items(spark, sf), unit_table(spark, sf).unionByName(people), ad.ORDER_INTERESTS, ad.TODAY_ORDERS)
    return out.select("id", F.array_join("t_majors", ",").alias("majors"), F.array_join("t_colleges", ",").alias("colleges"), F.size("t_majors").cast("long").alias("n_majors"))


@query(
    "match_score",
    ctes(*PAIRED)
    + """SELECT id, profile_id, score, level, array_to_string(reasons, ' / ') AS reasons, array_to_string(reasons_en, ' / ') AS reasons_en,
  target IS NULL AS title_only FROM scored""",
)
def _(spark, sf):
    return scored(spark, sf).select(
        "id", "profile_id", "score", "level", F.array_join("reasons", " / ").alias("reasons"),
        F.array_join("reasons_en", " / ").alias("reasons_en"), "title_only",
    )


def _rule(name: str, sql: str, columns: dict[str, str]) -> None:
    """One rule over the reader pairs."""

    @query(name, ctes(*PAIRED) + f"SELECT id, profile_id, {sql} FROM scored")
    def _(spark, sf):
        return scored(spark, sf).select("id", "profile_id", *[F.expr(e).alias(c) for c, e in columns.items()])


_rule("rule_unit", "s_unit, coalesce(x_unit, '-') AS x_unit", {"s_unit": "s_unit", "x_unit": "coalesce(x_unit, '-')"})
_rule("rule_board", "s_board", {"s_board": "s_board"})
_rule("rule_title", "s_title", {"s_title": "s_title"})
_rule("rule_grad", "coalesce(x_grad, '-') AS x_grad", {"x_grad": "coalesce(x_grad, '-')"})
_rule(
    "rule_year", "s_year, year_state, year_label, year_label_en, coalesce(x_year, '-') AS x_year",
    {"s_year": "s_year", "year_state": "year_state", "year_label": "year_label", "year_label_en": "year_label_en", "x_year": "coalesce(x_year, '-')"},
)
_rule("rule_excluded_year", "coalesce(x_excluded_year, '-') AS x", {"x": "coalesce(x_excluded_year, '-')"})
_rule("rule_semester", "coalesce(x_semester, '-') AS x", {"x": "coalesce(x_semester, '-')"})
_rule("rule_broad", "s_broad", {"s_broad": "s_broad"})
_rule("rule_interest", "s_interest, coalesce(interest, '-') AS interest", {"s_interest": "s_interest", "interest": "coalesce(interest, '-')"})
_rule("first_exclusion", "coalesce(excluded, '-') AS excluded", {"excluded": "coalesce(excluded, '-')"})


@query(
    "profile_notice_cross",
    ctes(*_crossed())
    + """SELECT id, coalesce(sum(n_profiles) FILTER (level = 'high'), 0) AS n_high, coalesce(sum(n_profiles) FILTER (level = 'medium'), 0) AS n_medium,
  coalesce(sum(n_profiles) FILTER (level = 'low'), 0) AS n_low, coalesce(sum(n_profiles) FILTER (level = 'none'), 0) AS n_none FROM scored GROUP BY id""",
)
def _(spark, sf):
    """Every profile with every notice, as counts per notice and level."""
    return audience.level_counts(features(spark, sf), profiles(spark, sf), ad.TODAY_ORDERS)


@query(
    "for_you_topk",
    ctes(*_crossed("f.due IS NULL OR substr(f.due, 1, 10) >= '2001-06-15'"), """top AS (
  SELECT *, row_number() OVER (PARTITION BY p_college, p_major, p_year, p_entrance, p_interests
     ORDER BY score DESC, due IS NULL, due, published_at DESC, id DESC) AS rank FROM scored WHERE score >= 25)""")
    + f"SELECT p.profile_id, s.rank, s.id, s.score, s.level FROM top s {PROFILE_OF_SEGMENT} WHERE s.rank <= 6",
)
def _(spark, sf):
    return audience.for_you(features(spark, sf), profiles(spark, sf), ad.TODAY_ORDERS)


@query(
    "upcoming_topk",
    ctes(*_crossed("substr(f.due, 1, 10) BETWEEN '2001-06-15' AND '2001-07-15' OR substr(f.event_date, 1, 10) BETWEEN '2001-06-15' AND '2001-07-15'"),
         """near AS (
  SELECT *, 'deadline' AS kind, 0 AS kind_ord, due AS date FROM scored WHERE level <> 'none' AND substr(due, 1, 10) BETWEEN '2001-06-15' AND '2001-07-15'
  UNION ALL
  SELECT *, 'event', 1, event_date FROM scored WHERE level <> 'none' AND substr(event_date, 1, 10) BETWEEN '2001-06-15' AND '2001-07-15'),
top AS (SELECT *, row_number() OVER (PARTITION BY p_college, p_major, p_year, p_entrance, p_interests
     ORDER BY date, published_at DESC, id DESC, kind_ord) AS rank FROM near)""")
    + f"SELECT p.profile_id, s.rank, s.id, s.kind, s.date FROM top s {PROFILE_OF_SEGMENT} WHERE s.rank <= 6",
)
def _(spark, sf):
    return audience.upcoming(features(spark, sf), profiles(spark, sf), ad.TODAY_ORDERS)


SEG_NAME = "concat_ws('|', p_college, p_major, p_year, p_entrance, array_to_string(p_interests, ','))"
FRESH = "f.has_analysis AND f.published_at BETWEEN DATE '2001-06-09' AND DATE '2001-06-15'"


@query(
    "notify_candidates",
    ctes(*_crossed(FRESH))
    + f"""SELECT id, {SEG_NAME} AS segment, score, n_profiles, array_to_string(reasons, ' / ') AS reasons FROM scored WHERE level = 'high'""",
)
def _(spark, sf):
    """The run's fresh analyses (notices of the last week) and the segments they are highly relevant to."""
    fresh = features(spark, sf).filter("has_analysis and published_at between DATE '2001-06-09' and DATE '2001-06-15'")
    out = audience.high_matches(fresh, profiles(spark, sf), ad.TODAY_ORDERS, LABELS)
    return out.select("id", "segment", "score", "n_profiles", F.array_join("reasons", " / ").alias("reasons"))


@query(
    "notification_feed",
    ctes(*_crossed("f.published_at BETWEEN DATE '2001-06-02' AND DATE '2001-06-15'"), """told AS (
  SELECT id, title, CASE WHEN id % 2 = 0 THEN 'EN ' || title ELSE title END AS title_en, due, published_at, source_url,
    CASE WHEN level = 'high' THEN 'relevant' ELSE 'new' END AS kind, n_profiles,
    CASE WHEN level = 'high' THEN array_to_string(reasons[1:2], ' · ') END AS why,
    CASE WHEN level = 'high' THEN array_to_string(reasons_en[1:2], ' · ') END AS why_en FROM scored)""")
    + """SELECT id, kind, CASE kind WHEN 'new' THEN 'New notice' ELSE 'Relevant to you' END AS title,
  CASE WHEN why_en IS NULL THEN title_en ELSE title_en || ' (' || why_en || ')' END AS body,
  CASE WHEN why IS NULL THEN title ELSE title || ' (' || why || ')' END AS body_ko,
  coalesce(due, '-') AS deadline, strftime(published_at, '%Y-%m-%d') AS published_at, source_url, sum(n_profiles) AS n_profiles
FROM told GROUP BY ALL""",
)
def _(spark, sf):
    out = audience.notification_feed(features(spark, sf), profiles(spark, sf), ad.TODAY_ORDERS, LABELS)
    both = out.withColumn("keep", F.col("body_ko"))
    return audience.localize(both, "en").select(
        "id", "kind", "title", "body", F.col("keep").alias("body_ko"), F.coalesce("deadline", F.lit("-")).alias("deadline"),
        F.date_format("published_at", "yyyy-MM-dd").alias("published_at"), "source_url", "n_profiles",
    )
