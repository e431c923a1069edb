"""Ranking and notifying many profiles without pairing every profile with every notice.

Only five attributes of a profile matter, so profiles are grouped into segments (bounded by the unit,
year and interest dimensions). Only the features of a notice matter, so notices are grouped into
signatures. Segments meet signatures through equi-joins on what they have in common:

* ``m|major`` / ``c|college``: a unit named by the eligibility text, a board or the title;
* ``i|interest``: an interest the notice scores for;
* ``y|year`` and ``y|year|cohort``: years the notice is open to.

A score of 50 needs a shared unit or interest, so those joins find every high match. Pairs that share
nothing but a year are never listed: they are counted through their keys, and a top-k needs only the
best k notices of each key.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake import dims
from noticelake.dims import SCORE
from noticelake.functions.dates import days_until
from noticelake.operators.calendar import unpivot_events
from noticelake.operators.match import completed_semesters, score_pairs
from noticelake.operators.skew import hot_lookup_join, with_global_index
from noticelake.operators.views import FAR_PAST
from noticelake.session import ensure_checkpoint_dir

SEGMENT = ["p_college", "p_major", "p_year", "p_entrance", "p_interests"]
TEXTS = "array<string>"


def with_segment(profiles: DataFrame) -> DataFrame:
    parts = [F.col(c).cast("string") for c in SEGMENT[:4]]
    return profiles.withColumn("segment", F.concat_ws("|", *parts, F.array_join("p_interests", ",")))


def segments(profiles: DataFrame) -> DataFrame:
    """Distinct attribute combinations: number ``seg``, name ``segment`` and how many profiles are in it."""
    found = with_segment(profiles).groupBy("segment", *SEGMENT).agg(F.count("*").alias("n_profiles"))
    return with_global_index(found, [F.col("segment").asc()], "seg")


MAX_BROADCAST_SEGMENTS = 100_000


def _small(per_segment: DataFrame, segs: DataFrame) -> DataFrame:
    """Broadcast rows of the segments only after counting the segments; otherwise a shuffle join."""
    return F.broadcast(per_segment) if segs.count() <= MAX_BROADCAST_SEGMENTS else per_segment


def _prefixed(prefix: str, values: str) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v.cast("string")))


def _segment_keys() -> Column:
    return F.concat(
        F.array(F.concat(F.lit("m|"), "p_major"), F.concat(F.lit("c|"), "p_college")), _prefixed("i|", "p_interests")
    )


def _year_key(year: Column, cohort: Column | None = None) -> Column:
    head = F.concat(F.lit("y|"), year.cast("string"))
    return head if cohort is None else F.concat(head, F.lit("|"), cohort.cast("string"))


def _segment_year_keys() -> Column:
    return F.array(_year_key(F.col("p_year")), _year_key(F.col("p_year"), F.col("p_entrance")))


def _names_units() -> Column:
    return (F.size("t_majors") > 0) | (F.size("t_colleges") > 0)


def _open_years(today: date) -> Column:
    """Years neither excluded nor short of a stated number of semesters."""
    years = F.array(*[F.lit(y) for y in (1, 2, 3, 4)])
    need = F.coalesce(F.array_max("semesters"), F.lit(0))
    return F.filter(years, lambda y: ~F.array_contains("excluded_years", y) & (completed_semesters(y, today) >= need))


def _year_keys(today: date, sure_score: bool) -> Column:
    """Keys of the profiles a notice without named units does not exclude.

    With ``sure_score`` only those for which the year or the open-to-all rule fires (25 points).
    """
    open_years = _open_years(today)
    stated = F.size("years") > 0
    by_year = F.filter(open_years, lambda y: ~stated | F.array_contains("years", y))
    year_keys = F.transform(by_year, lambda y: _year_key(y))
    rest = F.filter(open_years, lambda y: stated & ~F.array_contains("years", y))
    all_open = F.when(stated, rest).otherwise(open_years)

    def cohort_keys(of: Column) -> Column:
        return F.flatten(F.transform(of, lambda y: F.transform("cohorts", lambda c: _year_key(y, c))))

    if sure_score:
        keys = F.when(stated | F.col("broad"), F.concat(year_keys, cohort_keys(rest))).otherwise(cohort_keys(all_open))
    else:
        keys = F.concat(year_keys, cohort_keys(rest))
    return F.when(F.col("grad_only") | _names_units(), F.array().cast(TEXTS)).otherwise(keys)


# Features that decide the score and its reasons, as stored in a signature.
SIGNATURE = (
    "t_majors array<string>, t_colleges array<string>, b_majors array<string>, b_colleges array<string>, "
    "n_majors array<string>, n_colleges array<string>, years array<int>, cohorts array<int>, year_label string, "
    "year_label_en string, excluded_years array<int>, semesters array<int>, grad_only boolean, broad boolean, "
    "hits map<string,int>"
)
SIGNATURE_COLS = [part.split(" ")[0] for part in SIGNATURE.split(", ")]


def with_signature(features: DataFrame) -> DataFrame:
    """Adds ``sig``. Where units are named, boards, title and the open-to-all rule can no longer matter."""
    named, none = _names_units(), F.array().cast(TEXTS)
    unused = {c: F.when(named, none).otherwise(F.col(c)).alias(c) for c in ("b_majors", "b_colleges", "n_majors", "n_colleges")}
    unused["broad"] = (F.col("broad") & ~named).alias("broad")
    return features.withColumn("sig", F.to_json(F.struct(*[unused.get(c, F.col(c)) for c in SIGNATURE_COLS])))


def _signed(features: DataFrame, keep: list) -> tuple[DataFrame, DataFrame]:
    """(id, sig, keep...) rows, computed once, and the distinct signatures with ``n`` notices each.

    Signatures are numbered, so only a long travels with the rows and pairs that follow.
    """
    ensure_checkpoint_dir(features.sparkSession)
    rows = with_signature(features).select("id", F.col("sig").alias("text"), *keep).checkpoint()
    numbered = with_global_index(rows.groupBy("text").agg(F.count("*").alias("n")), [F.col("text").asc()], "sig")
    rows = hot_lookup_join(rows, numbered, ["text"], "id", "n").drop("text").checkpoint()
    return rows, numbered.withColumn("f", F.from_json("text", SIGNATURE)).select("sig", "n", "f.*")


def _points() -> Column:
    """What a notice offers to whom: (key, role, points)."""
    def offer(prefix: str, values: str, role: str, points: str) -> Column:
        return F.transform(values, lambda v: F.struct(
            F.concat(F.lit(prefix), v).alias("key"), F.lit(role).alias("role"), F.lit(SCORE[points]).alias("points")))

    interests = F.transform(F.map_entries("hits"), lambda e: F.struct(
        F.concat(F.lit("i|"), e["key"]).alias("key"), F.lit("interest").alias("role"), e["value"].alias("points")))
    every = F.concat(
        offer("m|", "t_majors", "unit", "major"), offer("c|", "t_colleges", "unit", "college"),
        offer("m|", "b_majors", "board", "board_major"), offer("c|", "b_colleges", "board", "board_college"),
        offer("m|", "n_majors", "title", "title_major"), offer("c|", "n_colleges", "title", "title_college"), interests,
    )
    return F.filter(every, lambda _: ~F.col("grad_only"))


def _scores(sigs: DataFrame, segs: DataFrame, today: date) -> DataFrame:
    """(sig, seg, score, allowed, sure) for the pairs that share a unit or an interest.

    The points of a pair are the best offer per role among the keys both sides have.
    """
    facts = ["named", "years", "cohorts", "open_years", "broad"]
    ready = sigs.withColumns({"named": _names_units(), "open_years": _open_years(today)}).repartition("sig")
    offers = ready.select("sig", *facts, F.inline(_points()))
    wants = segs.select("seg", "p_year", "p_entrance", "n_profiles", F.explode(_segment_keys()).alias("key"))
    wanted = ["seg", "p_year", "p_entrance", "n_profiles"]

    def best(role: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("role") == role, F.col("points"))), F.lit(0)).alias(role)

    # with the segments broadcast, offers stay where they are and the sums need no further shuffle
    met = offers.join(_small(wants, segs), "key")
    passed_here = F.array_contains("cohorts", F.col("p_entrance")) | F.array_contains("years", F.col("p_year"))
    met = met.select(
        "sig", *wanted, "role", "points", "named", "broad", passed_here.alias("passed"),
        (F.array_contains("open_years", F.col("p_year")) & (passed_here | (F.size("years") == 0))).alias("open"),
    )
    pairs = met.groupBy("sig", "seg").agg(
        *[best(r) for r in ("unit", "board", "title", "interest")],
        *[F.first(c).alias(c) for c in ("n_profiles", "named", "broad", "passed", "open")],
    )
    unit, board = F.col("unit"), F.col("board")
    allowed = F.col("open") & ((unit > 0) | ~F.col("named"))
    sure = F.when(F.col("passed"), SCORE["year"]).when((unit == 0) & F.col("broad"), SCORE["all_undergrad"]).otherwise(0)
    place = F.when(unit > 0, unit).when(board > 0, board).otherwise(F.col("title"))
    score = F.least(place + sure + F.col("interest"), F.lit(dims.MAX_SCORE))
    return pairs.select("sig", "seg", "n_profiles", allowed.alias("allowed"), (sure > 0).alias("sure"), F.when(allowed, score).otherwise(0).alias("score"))


def _level(score: Column) -> Column:
    return F.when(score >= dims.LEVEL_HIGH, "high").when(score >= dims.LEVEL_MEDIUM, "medium").otherwise("low")


def _best_first() -> list[Column]:
    """For-you order below the score: dated before undated, soonest first, then newest, then list order."""
    published = F.coalesce(-F.unix_date("published_at"), F.lit(FAR_PAST))
    return [F.col("due").isNull().alias("o1"), F.coalesce("due", F.lit("")).alias("o2"), published.alias("o3"), (-F.col("id")).alias("o4")]


ORDER = ["o1", "o2", "o3", "o4"]


def _top(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def _to_profiles(profiles: DataFrame, segs: DataFrame, per_segment: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each segment (at most k) for every profile in it."""
    packed = per_segment.groupBy("seg").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    lookup = segs.select("seg", "segment", F.col("n_profiles").alias("n")).join(packed, "seg").drop("seg")
    rows = with_segment(profiles).select("profile_id", "segment")
    return hot_lookup_join(rows, lookup, ["segment"], "profile_id", "n").select("profile_id", F.inline("rows"))


def _cell(college: str, major: str) -> Column:
    return F.concat_ws("|", college, major)


ANY = "*"


def _place_table(sigs: DataFrame, segs: DataFrame) -> DataFrame:
    """(p, cell, place): points from units, boards and titles per unit feature set and (college, major).

    Feature sets that name no units also get a row for any cell, with no points.
    """
    cells = segs.select("p_college", "p_major").distinct().select(
        _cell("p_college", "p_major").alias("cell"),
        F.explode(F.array(F.concat(F.lit("m|"), "p_major"), F.concat(F.lit("c|"), "p_college"))).alias("key"),
    )
    sets = sigs.groupBy("p").agg(*[F.any_value(c).alias(c) for c in PLACE], F.any_value(_names_units()).alias("named"))
    offers = sets.withColumns({"hits": F.create_map().cast("map<string,int>"), "grad_only": F.lit(False)}).select("p", F.inline(_points()))

    def best(role: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("role") == role, F.col("points"))), F.lit(0)).alias(role)

    met = offers.join(cells, "key").groupBy("p", "cell").agg(*[best(r) for r in ("unit", "board", "title")])
    place = F.when(F.col("unit") > 0, F.col("unit")).when(F.col("board") > 0, F.col("board")).otherwise(F.col("title"))
    anyone = sets.filter(~F.col("named")).select("p", F.lit(ANY).alias("cell"), F.lit(0).alias("place"))
    named = sets.select("p", "named")
    exact = met.join(named, "p").filter(~F.col("named") | (F.col("unit") > 0)).select("p", "cell", place.alias("place"))
    return exact.unionByName(anyone)


def _year_table(sigs: DataFrame, segs: DataFrame, today: date) -> DataFrame:
    """(y, ycell, sure): the years and cohorts a year feature set admits, and the points for it."""
    sets = sigs.groupBy("y").agg(*[F.any_value(c).alias(c) for c in YEAR]).filter(~F.col("grad_only"))
    none = F.array().cast(TEXTS)
    keys = sets.withColumns({"t_majors": none, "t_colleges": none}).select("*", F.explode(_year_keys(today, False)).alias("key"))
    cells = segs.select("p_year", "p_entrance").distinct().select("p_year", "p_entrance", F.explode(_segment_year_keys()).alias("key"))
    passed = F.array_contains("cohorts", F.col("p_entrance")) | F.array_contains("years", F.col("p_year"))
    sure = F.when(passed, SCORE["year"]).when(F.col("broad"), SCORE["all_undergrad"]).otherwise(0)
    met = keys.join(cells, "key").select("y", F.concat_ws("|", "p_year", "p_entrance").alias("ycell"), sure.alias("sure"))
    return met.distinct()


def _interest_table(sigs: DataFrame, segs: DataFrame) -> DataFrame:
    """(i, wants, interest): points per interest feature set and interest list, plus any list with none."""
    sets = sigs.groupBy("i").agg(F.any_value(F.map_entries("hits")).alias("entries"))
    lists = segs.select("p_interests").distinct().select(
        F.array_join("p_interests", ",").alias("wants"), F.explode("p_interests").alias("key"))
    offers = sets.select("i", F.inline("entries"))
    met = offers.join(lists, "key").groupBy("i", "wants").agg(F.max("value").alias("interest"))
    return met.unionByName(sets.select("i", F.lit(ANY).alias("wants"), F.lit(0).alias("interest")))


PLACE = ["t_majors", "t_colleges", "b_majors", "b_colleges", "n_majors", "n_colleges"]
YEAR = ["years", "cohorts", "excluded_years", "semesters", "grad_only", "broad"]


def for_you(features: DataFrame, profiles: DataFrame, today: date, k: int = dims.FOR_YOU_LIMIT) -> DataFrame:
    """The best k open notices per profile (level medium or high): profile_id, rank, id, score, level.

    ``features``: match.notice_features with id, due and published_at. ``profiles``: match.with_profile.

    The score is place + year + interest, and each part depends on its own piece of the profile. So only
    the best k notices are kept per combination, one part after the other: by unit cell and place points,
    then by year cell, then by interest list. "Any" stands for no shared unit or no shared interest; it
    never overstates a score, so whatever it displaces is behind k better notices, and the larger of two
    scores found for a notice is the true one.
    """
    segs = segments(profiles)
    open_ = features.filter(F.col("due").isNull() | (days_until(F.col("due"), today) >= 0))
    rows, sigs = _signed(open_, _best_first())
    parts = _with_parts(sigs)
    best = _top(rows, ["sig"], ORDER, k).join(parts.select("sig", "p", "y", "i"), "sig").drop("sig")

    by_place = best.join(_place_table(parts, segs), "p").drop("p")
    by_place = _top(by_place, ["cell", "place", "y", "i"], ORDER, k)
    by_year = by_place.join(_year_table(parts, segs, today), "y").withColumn("base", F.col("place") + F.col("sure"))
    by_year = _top(by_year.select("cell", "ycell", "base", "i", "id", *ORDER), ["cell", "ycell", "base", "i"], ORDER, k)
    scored = by_year.join(_interest_table(parts, segs), "i").withColumn("score", F.least(F.col("base") + F.col("interest"), F.lit(dims.MAX_SCORE)))
    scored = scored.filter(F.col("score") >= dims.LEVEL_MEDIUM).select("cell", "ycell", "wants", "score", "id", *ORDER)
    scored = _top(scored, ["cell", "ycell", "wants"], [F.desc("score"), *ORDER], k)

    mine = F.concat_ws("|", "p_year", "p_entrance").alias("ycell")
    places = F.explode(F.array(_cell("p_college", "p_major"), F.lit(ANY))).alias("cell")
    wishes = F.array(F.array_join("p_interests", ","), F.lit(ANY))
    keyed = segs.select("seg", mine, "p_interests", places).select("seg", "ycell", "cell", F.explode(wishes).alias("wants"))
    both = keyed.join(scored, ["cell", "ycell", "wants"]).groupBy("seg", "id").agg(
        F.max("score").alias("score"), *[F.min(o).alias(o) for o in ORDER]
    )
    w = Window.partitionBy("seg").orderBy(F.desc("score"), *ORDER)
    ranked = both.withColumn("level", _level(F.col("score"))).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return _to_profiles(profiles, segs, ranked, ["rank", "id", "score", "level"])


# Features that decide whether a notice excludes a profile.
ACCESS = ["t_majors", "t_colleges", "years", "cohorts", "excluded_years", "semesters", "grad_only"]
ACCESS_SCHEMA = ", ".join(part for part in SIGNATURE.split(", ") if part.split(" ")[0] in ACCESS)


def upcoming(features: DataFrame, profiles: DataFrame, today: date, days: int = dims.UPCOMING_DAYS, k: int = dims.UPCOMING_LIMIT) -> DataFrame:
    """The next k events per profile among notices that do not exclude it: profile_id, rank, id, kind, date.

    ``features``: match.notice_features with id, published_at, due and event_date. The date filter is put on
    the notices too, where it reaches below the feature expressions.
    """
    def soon(when: str) -> Column:
        return days_until(F.col(when), today).between(0, days)

    events = unpivot_events(features.filter(soon("due") | soon("event_date")))
    segs = segments(profiles)
    near = events.filter(soon("date")).withColumn("sig", F.to_json(F.struct(*ACCESS)))
    near = near.select("id", "kind", "kind_ord", "date", "published_at", "sig").checkpoint()
    published = F.coalesce(-F.unix_date("published_at"), F.lit(FAR_PAST))
    order = [F.col("date").alias("o1"), published.alias("o2"), (-F.col("id")).alias("o3"), F.col("kind_ord").alias("o4")]
    best = _top(near.select("id", "kind", "sig", *order), ["sig"], ORDER, k)
    sigs = near.select("sig").distinct().withColumn("f", F.from_json("sig", ACCESS_SCHEMA)).select("sig", "f.*")

    unit_keys = F.concat(_prefixed("m|", "t_majors"), _prefixed("c|", "t_colleges"))
    named = sigs.filter(_names_units() & ~F.col("grad_only"))
    reach = named.select("sig", F.explode(unit_keys).alias("key")).join(
        segs.select("seg", F.explode(_segment_keys()).alias("key")), "key").select("sig", "seg").distinct()
    cohort = F.array_contains("cohorts", F.col("p_entrance"))
    year_ok = cohort | (F.size("years") == 0) | F.array_contains("years", F.col("p_year"))
    need = F.coalesce(F.array_max("semesters"), F.lit(0))
    allowed = ~F.array_contains("excluded_years", F.col("p_year")) & year_ok & (completed_semesters(F.col("p_year"), today) >= need)
    strong = reach.join(named, "sig").join(segs, "seg").filter(allowed).select("seg", "sig")
    heads = best.groupBy("sig").agg(F.min(F.struct(*ORDER)).alias("head"))
    strong = _top(strong.join(heads, "sig"), ["seg"], ["head"], k).join(best, "sig").select("seg", "id", "kind", *ORDER)

    open_keys = sigs.select("sig", F.explode(_year_keys(today, False)).alias("key"))
    weak = _top(open_keys.join(best, "sig").select("key", "id", "kind", *ORDER), ["key"], ORDER, k)
    weak = weak.join(segs.select("seg", F.explode(_segment_year_keys()).alias("key")), "key").select("seg", "id", "kind", *ORDER)

    w = Window.partitionBy("seg").orderBy(*ORDER)
    both = strong.unionByName(weak).distinct()
    ranked = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumnRenamed("o1", "date")
    return _to_profiles(profiles, segs, ranked, ["rank", "id", "kind", "date"])


def _with_parts(sigs: DataFrame) -> DataFrame:
    """Signatures with the texts of their three feature sets: place, year and interest."""
    parts = sigs.withColumns({"p": F.to_json(F.struct(*PLACE)), "y": F.to_json(F.struct(*YEAR)), "i": F.to_json("hits")})
    return parts.drop("year_label", "year_label_en").checkpoint()


def level_counts(features: DataFrame, profiles: DataFrame, today: date) -> DataFrame:
    """Per notice: for how many profiles it is high, medium, low and none.

    Every (profile, notice) pair is counted once, none is listed. A signature meets the unit cells, year
    cells and interest lists it shares something with; ``any`` stands for all of them together. What a
    shared cell or list scores is added, and what the same profiles had been counted for under ``any`` is
    taken off again (inclusion and exclusion over the two parts).
    """
    segs = segments(profiles)
    rows, sigs = _signed(features, [])
    parts = _with_parts(sigs)

    ycell = F.concat_ws("|", "p_year", "p_entrance").alias("ycell")
    cells = F.explode(F.array(_cell("p_college", "p_major"), F.lit(ANY))).alias("cell")
    lists = F.explode(F.array(F.array_join("p_interests", ","), F.lit(ANY))).alias("wants")
    people = segs.select("n_profiles", "p_interests", ycell, cells).select("n_profiles", "ycell", "cell", lists)
    people = people.groupBy("cell", "ycell", "wants").agg(F.sum("n_profiles").alias("people"))

    met = (
        parts.select("sig", "p", "y", "i", _names_units().alias("named"))
        .join(_small(_place_table(parts, segs), segs), "p").join(_small(_year_table(parts, segs, today), segs), "y")
        .join(_small(_interest_table(parts, segs), segs), "i").join(_small(people, segs), ["cell", "ycell", "wants"])
        .select("sig", "named", "place", "sure", "interest", "people", (F.col("cell") != ANY).alias("at"), (F.col("wants") != ANY).alias("wish"))
    )
    place, sure, interest, at, wish = (F.col(c) for c in ("place", "sure", "interest", "at", "wish"))

    def people_where(test, name: str) -> Column:
        def one(points: Column, when: Column) -> Column:
            return F.when(when & test(points), 1).otherwise(0)

        open_ = ~F.col("named")
        signed = (
            one(place + sure + interest, F.lit(True)) - one(place + sure, wish) - one(sure + interest, at & open_) + one(sure, at & wish & open_)
        )
        return F.coalesce(F.sum(signed * F.col("people")), F.lit(0)).alias(name)

    per_sig = met.groupBy("sig").agg(
        people_where(lambda s: s >= dims.LEVEL_HIGH, "high"),
        people_where(lambda s: (s >= dims.LEVEL_MEDIUM) & (s < dims.LEVEL_HIGH), "medium"),
        people_where(lambda s: s < dims.LEVEL_MEDIUM, "low"),
    )
    total = segs.agg(F.coalesce(F.sum("n_profiles"), F.lit(0)).alias("t")).first()["t"]
    table = sigs.select("sig", "n").join(per_sig, "sig", "left").na.fill(0)
    counts = table.select(
        "sig", "n", F.col("high").alias("n_high"), F.col("medium").alias("n_medium"), F.col("low").alias("n_low"),
        (F.lit(total) - F.col("high") - F.col("medium") - F.col("low")).alias("n_none"),
    )
    return hot_lookup_join(rows.select("id", "sig"), counts, ["sig"], "id", "n").drop("sig")


def high_matches(features: DataFrame, profiles: DataFrame, today: date, labels: dict | None = None) -> DataFrame:
    """(id, segment, score, reasons, n_profiles) for every notice and segment at level high.

    Segments stand for their profiles; ``with_segment`` maps profiles to them for delivery.
    """
    rows, sigs = _signed(features, [])
    segs = segments(profiles)
    high = _scores(sigs, segs, today).filter(F.col("score") >= dims.LEVEL_HIGH).select("sig", "seg")
    told = score_pairs(high.join(sigs.drop("n"), "sig").join(segs, "seg"), today, labels)
    told = told.select("sig", "segment", "score", "reasons", "reasons_en", "n_profiles")
    return rows.join(told, "sig").drop("sig")


def notification_feed(features: DataFrame, profiles: DataFrame, today: date, labels: dict | None = None, days: int = dims.NOTIFICATION_DAYS) -> DataFrame:
    """Messages of the last ``days`` days with the number of profiles that get each.

    A profile at level high gets the relevant message with its first two reasons, everybody else the
    plain one. ``features`` also has title, source_url, due and title_en (null when not translated).
    """
    age = F.datediff(F.lit(today), "published_at")
    recent = features.filter(age.between(0, days - 1))
    total = profiles.count()
    high = high_matches(recent, profiles, today, labels).select(
        "id", F.array_join(F.slice("reasons", 1, 2), " · ").alias("why"), F.array_join(F.slice("reasons_en", 1, 2), " · ").alias("why_en"), "n_profiles"
    )
    relevant = high.groupBy("id", "why", "why_en").agg(F.sum("n_profiles").alias("n_profiles"))
    told = relevant.groupBy("id").agg(F.sum("n_profiles").alias("told"))
    head = recent.select("id", "title", F.coalesce("title_en", "title").alias("title_en"), "due", "published_at", "source_url")
    ko, en = dims.LABELS["ko"], dims.LABELS["en"]

    def message(kind: str, body: Column, body_en: Column) -> list[Column]:
        return [
            F.lit(kind).alias("kind"), F.lit(ko[kind]).alias("title_ko"), F.lit(en[kind]).alias("title_en"), body.alias("body_ko"),
            body_en.alias("body_en"), F.col("due").alias("deadline"), "published_at", "source_url", F.col("n_profiles"),
        ]

    def because(title: str, why: str) -> Column:
        return F.when(F.col(why) != "", F.concat(title, F.lit(" ("), why, F.lit(")"))).otherwise(F.col(title))

    first = head.join(relevant, "id").select("id", *message("relevant", because("title", "why"), because("title_en", "why_en")))
    others = head.join(told, "id", "left").withColumn("n_profiles", F.lit(total) - F.coalesce("told", F.lit(0)))
    second = others.filter("n_profiles > 0").select("id", *message("new", F.col("title"), F.col("title_en")))
    return first.unionByName(second)


def localize(messages: DataFrame, lang: str) -> DataFrame:
    """Pick the language of stored messages."""
    return messages.withColumns({"title": F.col(f"title_{lang}"), "body": F.col(f"body_{lang}")}).drop(
        "title_ko", "title_en", "body_ko", "body_en"
    )
