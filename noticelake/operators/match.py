"""Profile matching: small explainable rules over eligibility text, boards, titles and interests.

Notices are reduced to features first (``notice_features``). A pair of a profile and a notice is then
scored with array lookups only (``score_pairs``). Pairs come from the caller or from operators.audience;
nothing here pairs every profile with every notice.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake import dims
from noticelake.dims import SCORE
from noticelake.functions.text import WS_CLASS
from noticelake.operators.grams import candidates
from noticelake.session import ensure_checkpoint_dir

WS = WS_CLASS + "*"
INTS = "array<int>"
TEXTS = "array<string>"
LISTED_TERMS = 500  # names that every text is searched for one by one; more of them are looked up in an index


def terms_from_units(units: DataFrame) -> list[tuple[str, str | None, str]] | DataFrame:
    """Unit names from a dimension table (term, major, college): a list while they are few, else the table itself."""
    units = units.select("term", "major", "college")
    rows = units.limit(LISTED_TERMS + 1).collect()
    return units if len(rows) > LISTED_TERMS else [tuple(r) for r in rows]


def _longest_first(terms: list[tuple[str, str | None, str]]) -> list[tuple[str, str | None, str]]:
    first: dict[str, tuple[str, str | None, str]] = {}
    for t in terms:
        first.setdefault(t[0], t)
    return sorted(first.values(), key=lambda t: -len(t[0]))


def find_terms(text: Column, terms: list[tuple[str, str | None, str]]) -> Column:
    """Positions (in the longest-first term list) of the names in a text.

    A hit is blanked before shorter names are tried, so no name matches inside a longer one.
    """
    names = [t[0] for t in _longest_first(terms)]
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("term"), F.lit(" " * len(n)).alias("blank")) for i, n in enumerate(names)])
    start = F.struct(text.alias("rest"), F.array().cast(INTS).alias("hits"))

    def step(acc: Column, t: Column) -> Column:
        hit = F.struct(
            F.replace(acc["rest"], t["term"], t["blank"]).alias("rest"), F.array_append(acc["hits"], t["i"]).alias("hits")
        )
        return F.when(F.contains(acc["rest"], t["term"]), hit).otherwise(acc)

    return F.coalesce(F.aggregate(table, start, step)["hits"], F.array().cast(INTS))


def unit_names(hits: Column, terms: list[tuple[str, str | None, str]]) -> tuple[Column, Column, Column]:
    """(majors, colleges, colleges of the majors) for term positions."""
    ordered = _longest_first(terms)
    majors = F.array(*[F.lit(t[1]) for t in ordered]).cast(TEXTS)
    colleges = F.array(*[F.lit(t[2]) for t in ordered]).cast(TEXTS)
    is_major = F.array(*[F.lit(t[1] is not None) for t in ordered])

    def pick(values: Column, want_major: bool) -> Column:
        chosen = F.filter(hits, lambda i: F.get(is_major, i) == F.lit(want_major))
        return F.array_distinct(F.transform(chosen, lambda i: F.get(values, i)))

    return pick(majors, True), pick(colleges, False), pick(colleges, True)


def unit_hits(texts: DataFrame, units: DataFrame) -> DataFrame:
    """(text_id, hits) of the texts (text_id, text) that name a unit; hits: structs of term, major, college."""
    hits = part_hits(texts.filter("text is not null").select("text_id", F.array("text").alias("parts")), units)
    return hits.select("text_id", F.col("hits")[0].alias("hits"))


def part_hits(texts: DataFrame, units: DataFrame) -> DataFrame:
    """(text_id, hits) of the texts (text_id, parts) that name a unit; hits: of each part structs of term, major, college.

    The names are those of ``find_terms``, longest first, equally long ones by name; a name that the table has twice has
    the least of its units. Texts meet names through an index on short character sequences. Only the names that a text
    holds are then blanked out in turn, so the work does not grow with the table. Names that hold two blanks in a row
    count where the text has them. The parts of all columns go through the index together, and stay with their candidates.
    """
    ensure_checkpoint_dir(texts.sparkSession)
    named = units.filter("term is not null and term != ''").groupBy("term").agg(F.min(F.struct("major", "college")).alias("u"))
    named = named.select(F.col("term").alias("needle_id"), F.array("term").alias("terms"), "u.major", "u.college").checkpoint()
    met = candidates(texts.select("text_id", "parts", F.col("parts").alias("_own")), named).withColumnsRenamed({"needle_id": "term", "_own": "parts"})
    held = met.filter(F.exists("parts", lambda p: F.contains(p, F.col("term"))) & F.col("text_id").isNotNull())
    own = F.struct((-F.length("term")).alias("n"), "term", "major", "college")
    held = held.groupBy("text_id").agg(F.array_sort(F.collect_list(own)).alias("found"), F.first("parts").alias("parts"))

    def step(acc: Column, t: Column) -> Column:
        rest = F.replace(acc["rest"], t["term"], F.repeat(F.lit(" "), -t["n"]))
        return F.when(F.contains(acc["rest"], t["term"]), F.struct(rest.alias("rest"), F.array_append(acc["hits"], t).alias("hits"))).otherwise(acc)

    def hits(part: Column) -> Column:
        start = F.struct(part.alias("rest"), F.filter("found", lambda t: F.lit(False)).alias("hits"))
        return F.transform(F.aggregate("found", start, step)["hits"], lambda t: F.struct(t["term"].alias("term"), t["major"].alias("major"), t["college"].alias("college")))

    return held.select("text_id", F.transform("parts", hits).alias("hits"))


def _with_units(items: DataFrame, target: Column, units: DataFrame) -> DataFrame:
    """``items`` plus t_majors, t_colleges, n_majors, n_colleges, _n_of_majors by ``part_hits`` over target and title."""
    parts = F.array(F.coalesce(target, F.lit("")), F.coalesce("title", F.lit("")))
    hits = part_hits(items.select(F.col("id").alias("text_id"), parts.alias("parts")), units).withColumnsRenamed({"text_id": "id", "hits": "_hits"})
    out = items.join(hits, "id", "left")
    for i, name in enumerate(("t", "n")):
        own = F.coalesce(F.col("_hits")[i], F.array())
        majors, colleges = F.filter(own, lambda t: t["major"].isNotNull()), F.filter(own, lambda t: t["major"].isNull())
        out = out.withColumns({
            f"{name}_majors": F.array_distinct(F.transform(majors, lambda t: t["major"])),
            f"{name}_colleges": F.array_distinct(F.transform(colleges, lambda t: t["college"])),
            f"_{name}_of_majors": F.array_distinct(F.transform(majors, lambda t: t["college"])),
        })
    return out.drop("_hits")


def completed_semesters(year: Column, today: date) -> Column:
    """Semesters finished by a student of the academic year (spring runs March to August)."""
    in_year = 0 if 3 <= today.month <= 8 else (1 if today.month >= 9 else 2)
    return (year - 1) * 2 + in_year


def _ints(values: Column) -> Column:
    return F.transform(values, lambda v: v.cast("int"))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def year_features(target: Column, today: date) -> dict[str, Column]:
    """Academic years, entrance cohorts, excluded years and semester counts named in a text."""
    plus = _all(target, f"([1-4]){WS}학년{WS}이상")
    lo, hi = [_all(target, f"([1-4]){WS}[~∼-]{WS}([1-4]){WS}학년", g) for g in (1, 2)]
    # not "N or above", and not "N ... not allowed" within the next 12 characters
    single = _all(target, f"([1-4]){WS}학년(?!{WS}이상)(?![^,.)]{{0,10}}?(?:불가|제외))")
    fresh, leaving = target.rlike("신입생"), target.rlike(f"졸업{WS}예정자")
    short = F.transform(_all(target, f"([0-9]{{2}}|[0-9]{{4}}){WS}학번"), lambda c: F.right(c, F.lit(2)))
    cohorts = F.transform(short, lambda c: c.cast("int") + 2000)
    now = today.year - (1 if today.month <= 2 else 0)
    pairs = F.arrays_zip(lo.alias("lo"), hi.alias("hi"))
    none = F.array().cast(INTS)

    def span(p: Column) -> Column:
        a, b = p["lo"].cast("int"), p["hi"].cast("int")
        return F.when(a <= b, F.sequence(a, b)).otherwise(none)

    years = F.flatten(F.array(
        F.flatten(F.transform(plus, lambda y: F.sequence(y.cast("int"), F.lit(4)))),
        F.flatten(F.transform(pairs, span)),
        _ints(single),
        F.when(fresh, F.array(F.lit(1))).otherwise(none),
        F.when(leaving, F.array(F.lit(4))).otherwise(none),
        F.filter(F.transform(cohorts, lambda c: F.lit(now + 1) - c), lambda y: y.between(1, 4)),
    ))
    no_text = F.array().cast(TEXTS)

    def labels(ko: bool) -> Column:
        def say(template: str, *values: Column) -> Column:
            return F.format_string(template, *values)

        parts = F.flatten(F.array(
            F.transform(plus, lambda y: say("%s학년 이상" if ko else "year %s+", y)),
            F.transform(pairs, lambda p: say("%s~%s학년" if ko else "years %s–%s", p["lo"], p["hi"])),
            F.transform(single, lambda y: say("%s학년" if ko else "year %s", y)),
            F.when(fresh, F.array(F.lit("신입생" if ko else "first-year students"))).otherwise(no_text),
            F.when(leaving, F.array(F.lit("졸업예정자" if ko else "expected graduates"))).otherwise(no_text),
            F.transform(short, lambda c: say("%d학번" if ko else "class of '%d", c.cast("int"))),
        ))
        return F.array_join(F.array_distinct(parts), "·" if ko else ", ")

    listed = _all(target, f"((?:[1-4]{WS},{WS})*[1-4]){WS}학년[^,.)]*?(?:불가|제외)")
    excluded = F.flatten(F.transform(listed, lambda m: _ints(F.split(F.regexp_replace(m, f"{WS_CLASS}", ""), ","))))
    return {
        "years": F.coalesce(F.array_sort(F.array_distinct(years)), none),
        "cohorts": F.coalesce(F.array_distinct(cohorts), none),
        "year_label": F.coalesce(labels(True), F.lit("")),
        "year_label_en": F.coalesce(labels(False), F.lit("")),
        "excluded_years": F.coalesce(F.array_distinct(excluded), none),
        "semesters": F.coalesce(_ints(_all(target, f"([0-9]{{1,2}}){WS}학기{WS}이상")), none),
    }


def interest_hits(category: Column, title: Column, rules: dict) -> Column:
    """Map interest -> score the notice has for it (category beats title keyword); misses are absent."""
    scores = []
    for categories, keywords in rules.values():
        by_title = F.when(title.rlike(keywords), SCORE["interest_keyword"]).otherwise(0)
        scores.append(F.when(category.isin(categories), SCORE["interest_category"]).otherwise(by_title) if categories else by_title)
    names = F.array(*[F.lit(k) for k in rules])
    return F.map_filter(F.map_from_arrays(names, F.array(*scores)), lambda _, s: s > 0)


FEATURES = [
    "t_majors", "t_colleges", "b_majors", "b_colleges", "n_majors", "n_colleges", "years", "cohorts", "year_label",
    "year_label_en", "excluded_years", "semesters", "grad_only", "broad", "hits", "title_only",
]


def board_units(copies: DataFrame, boards: DataFrame) -> DataFrame:
    """Per notice: majors and colleges of the boards it was posted on (bounded by the board dimension).

    ``copies``: (id, source), one row per copy with the canonical id.
    """
    dim = boards.select("source", "major", "college")
    posted = copies.select("id", "source").distinct()
    return posted.join(dim, "source", "left").groupBy("id").agg(
        F.array_sort(F.collect_set("major")).alias("b_majors"), F.array_sort(F.collect_set("college")).alias("b_colleges")
    )


def notice_features(items: DataFrame, terms: list | DataFrame, rules: dict, today: date) -> DataFrame:
    """``items`` (id, title, category, target, b_majors, b_colleges; target null while pending) + FEATURES.

    ``terms``: unit names as a list, or a table (term, major, college) of any size.
    """
    target = F.coalesce("target", F.lit(""))
    if isinstance(terms, DataFrame):
        found = _with_units(items, target, terms)
        t_majors, t_colleges, n_majors, n_colleges, n_of_majors = (F.col(c) for c in ("t_majors", "t_colleges", "n_majors", "n_colleges", "_n_of_majors"))
    else:
        found = items.withColumns({"_t": find_terms(target, terms), "_n": find_terms(F.col("title"), terms)})
        t_majors, t_colleges, _ = unit_names(F.col("_t"), terms)
        n_majors, n_colleges, n_of_majors = unit_names(F.col("_n"), terms)
    grad = target.rlike(dims.GRAD_WORDS)
    broad = target.rlike(dims.BROAD_WORDS.replace(r"\s", WS_CLASS)) & ~target.rlike(dims.UNVERIFIABLE_WORDS.replace(r"\s", WS_CLASS))
    return found.withColumns({
        "t_majors": t_majors,
        "t_colleges": t_colleges,
        "n_majors": n_majors,
        "n_colleges": F.array_distinct(F.concat(n_colleges, n_of_majors)),
        **year_features(target, today),
        "grad_only": grad & ~target.rlike(dims.UNDERGRAD_WORDS),
        "broad": broad & ~grad,
        "hits": interest_hits(F.col("category"), F.col("title"), rules),
        "title_only": F.col("target").isNull(),
    }).drop("_t", "_n", "_t_of_majors", "_n_of_majors")


# --- rules over a pair: profile columns p_college, p_major, p_year, p_entrance, p_interests -----------

def _has(values: str, value: str) -> Column:
    return F.array_contains(values, F.col(value))


def unit_rule() -> Column:
    return (
        F.when((F.size("t_majors") > 0) & _has("t_majors", "p_major"), SCORE["major"])
        .when(_has("t_colleges", "p_college"), SCORE["college"])
        .otherwise(0)
    )


def unit_exclusion(ko: bool = True) -> Column:
    """Set when units are named and none is the profile's."""
    def named(units: str) -> Column:
        return F.array_join(F.slice(units, 1, 2), ", ")

    major = F.concat(F.lit("다른 학과 대상 (" if ko else "For another major ("), named("t_majors"), F.lit(")"))
    college = F.concat(F.lit("다른 단과대학 대상 (" if ko else "For another college ("), named("t_colleges"), F.lit(")"))
    missed = F.col("s_unit") == 0
    return F.when(missed & (F.size("t_majors") > 0), major).when(missed & (F.size("t_colleges") > 0), college)


def board_rule() -> Column:
    fired = F.when(_has("b_majors", "p_major"), SCORE["board_major"]).when(_has("b_colleges", "p_college"), SCORE["board_college"])
    return F.when(F.col("s_unit") > 0, 0).otherwise(F.coalesce(fired, F.lit(0)))


def title_rule() -> Column:
    fired = F.when(_has("n_majors", "p_major"), SCORE["title_major"]).when(_has("n_colleges", "p_college"), SCORE["title_college"])
    return F.when((F.col("s_unit") > 0) | (F.col("s_board") > 0), 0).otherwise(F.coalesce(fired, F.lit(0)))


def year_state() -> Column:
    """none (no rule), pass or fail."""
    cohort = _has("cohorts", "p_entrance")
    return F.when(cohort | _has("years", "p_year"), "pass").when(F.size("years") > 0, "fail").otherwise("none")


def semester_need(today: date) -> Column:
    """The first stated number of semesters the profile has not completed."""
    done = completed_semesters(F.col("p_year"), today)
    return F.try_element_at(F.filter("semesters", lambda n: n > done), F.lit(1))


def interest_best() -> Column:
    return F.array_max(F.transform("p_interests", lambda i: F.coalesce(F.try_element_at("hits", i), F.lit(0))))


def interest_name() -> Column:
    wins = F.filter("p_interests", lambda i: F.coalesce(F.try_element_at("hits", i), F.lit(0)) == F.col("s_interest"))
    return F.when(F.col("s_interest") > 0, F.try_element_at(wins, F.lit(1)))


def score_pairs(pairs: DataFrame, today: date, interest_labels: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Adds rule scores, ``excluded``, ``score``, ``level`` and the aligned reasons in both languages."""
    rules = pairs.withColumns({"s_unit": unit_rule(), "year_state": year_state(), "need": semester_need(today),
                               "s_interest": F.coalesce(interest_best(), F.lit(0))})
    rules = rules.withColumn("s_board", board_rule())
    rules = rules.withColumns({
        "s_title": title_rule(),
        "s_year": F.when(F.col("year_state") == "pass", SCORE["year"]).otherwise(0),
        "x_unit": unit_exclusion(),
        "x_grad": F.when(F.col("grad_only"), "대학원생 대상"),
        "x_excluded_year": F.when(_has("excluded_years", "p_year"), F.format_string("%d학년 제외", "p_year")),
        "x_year": F.when(F.col("year_state") == "fail", F.concat("year_label", F.lit(" 대상"))),
        "x_semester": F.when(F.col("need").isNotNull(), F.format_string("%d학기 이상 이수 조건", "need")),
        "interest": interest_name(),
    })
    specific = (F.col("s_unit") > 0) | (F.col("s_year") > 0)
    rules = rules.withColumn("s_broad", F.when(F.col("broad") & ~specific, SCORE["all_undergrad"]).otherwise(0))
    excluded = F.coalesce("x_unit", "x_grad", "x_excluded_year", "x_year", "x_semester")
    total = sum((F.col(c) for c in ("s_unit", "s_board", "s_title", "s_year", "s_broad", "s_interest")), F.lit(0))
    rules = rules.withColumn("excluded", excluded)
    rules = rules.withColumn("score", F.when(F.col("excluded").isNotNull(), 0).otherwise(F.least(total, F.lit(dims.MAX_SCORE))))
    level = (
        F.when(F.col("excluded").isNotNull(), "none").when(F.col("score") >= dims.LEVEL_HIGH, "high")
        .when(F.col("score") >= dims.LEVEL_MEDIUM, "medium").otherwise("low")
    )
    return rules.withColumns({
        "level": level, "reasons": _reasons(True, interest_labels), "reasons_en": _reasons(False, interest_labels),
        "excluded_en": _excluded_en(),
    })


def _excluded_en() -> Column:
    return F.coalesce(
        unit_exclusion(False),
        F.when(F.col("grad_only"), "For graduate students"),
        F.when(F.col("x_excluded_year").isNotNull(), F.format_string("Year %d excluded", "p_year")),
        F.when(F.col("x_year").isNotNull(), F.concat(F.lit("For "), "year_label_en")),
        F.when(F.col("need").isNotNull(), F.format_string("Requires %d+ completed semesters", "need")),
    )


def _reasons(ko: bool, interest_labels: dict[str, tuple[str, str]] | None) -> Column:
    def about(score: str, value: int, unit: str, korean: str, english: str) -> Column:
        return F.when(F.col(score) == value, F.format_string(korean if ko else english, unit))

    if interest_labels is None:
        interest_labels = dims.INTEREST_LABELS
    names = F.create_map(*[F.lit(x) for k, v in interest_labels.items() for x in (k, v[0 if ko else 1])])
    interest = F.concat(F.lit("관심 분야: " if ko else "Interest: "), F.coalesce(F.try_element_at(names, F.col("interest")), "interest"))
    given = F.array_compact(F.array(
        about("s_unit", SCORE["major"], "p_major", "%s 대상", "For %s"),
        about("s_unit", SCORE["college"], "p_college", "%s 대상", "For %s"),
        about("s_board", SCORE["board_major"], "p_major", "%s 게시판 공지", "Posted on the %s board"),
        about("s_board", SCORE["board_college"], "p_college", "%s 게시판 공지", "Posted on the %s board"),
        about("s_title", SCORE["title_major"], "p_major", "%s 공지", "Posted by %s"),
        about("s_title", SCORE["title_college"], "p_college", "%s 공지", "Posted by %s"),
        F.when(F.col("s_year") > 0, F.concat("year_label", F.lit(" 대상")) if ko else F.concat(F.lit("For "), "year_label_en")),
        F.when(F.col("s_broad") > 0, "학부생 전체 대상" if ko else "Open to all undergraduates"),
        F.when(F.col("s_interest") > 0, interest),
    ))
    why = F.col("excluded") if ko else _excluded_en()
    return F.when(F.col("excluded").isNotNull(), F.array(why)).otherwise(given)


def with_profile(profiles: DataFrame) -> DataFrame:
    """Profile columns under the names the rules use."""
    return profiles.withColumnsRenamed(
        {"college": "p_college", "major": "p_major", "year": "p_year", "entrance_year": "p_entrance", "interests": "p_interests"}
    )
