"""Day and time expressions over ``YYYY-MM-DD`` / ``YYYY-MM-DDTHH:mm`` strings (Seoul wall clock).

The strings are kept because "all day" and "midnight" differ; days are derived where distance counts.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.dims import LABELS


def day_text(when: Column) -> Column:
    return F.substring(when, 1, 10)


def day(when: Column) -> Column:
    return F.try_to_date(day_text(when), "yyyy-MM-dd")


def is_timed(when: Column) -> Column:
    return F.length(when) > 10


def days_until(when: Column, today: date) -> Column:
    return F.datediff(day(when), F.lit(today))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def dotted_date(text: Column) -> Column:
    """``2026.9.2.`` anywhere in the text to ``2026-09-02``; null when there is none. No range check."""
    pattern = r"([0-9]{4})\.\s*([0-9]{1,2})\.\s*([0-9]{1,2})"
    part = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    return F.when(part[0] != "", F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")))


def seoul_day(instant: Column) -> Column:
    """UTC instant to the calendar day in Seoul."""
    return F.to_date(F.from_utc_timestamp(instant, "Asia/Seoul"))


def dday_label(when: Column, today: date, lang: str = "ko") -> Column:
    days = days_until(when, today)
    return (
        F.when(days < 0, LABELS[lang]["closed"])
        .when(days == 0, "D-DAY")
        .otherwise(F.concat(F.lit("D-"), days.cast("string")))
    )


def dday_tone(when: Column, today: date) -> Column:
    days = days_until(when, today)
    return F.when(days < 0, "closed").when(days <= 2, "urgent").when(days <= 7, "soon").otherwise("open")


def _name(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index)


def _number(when: Column, start: int, length: int) -> Column:
    return F.substring(when, start, length).cast("int")


def clock(when: Column) -> Column:
    return F.when(is_timed(when), F.concat(F.lit(" "), F.substring(when, 12, 5))).otherwise("")


def short_date(when: Column, lang: str = "ko") -> Column:
    weekday = _name(LABELS[lang]["weekdays"], F.dayofweek(day(when)))
    if lang == "en":
        month = _name(LABELS["en"]["months"], _number(when, 6, 2))
        head = F.concat(month, F.lit(" "), _number(when, 9, 2).cast("string"), F.lit(" ("), weekday, F.lit(")"))
    else:
        head = F.concat(F.substring(when, 6, 2), F.lit("."), F.substring(when, 9, 2), F.lit("("), weekday, F.lit(")"))
    return F.concat(head, clock(when))


def full_date(when: Column, lang: str = "ko") -> Column:
    year, month, dom = _number(when, 1, 4), _number(when, 6, 2), _number(when, 9, 2)
    if lang == "en":
        name = _name(LABELS["en"]["months_long"], month)
        return F.concat(name, F.lit(" "), dom.cast("string"), F.lit(", "), year.cast("string"))
    return F.concat(year.cast("string"), F.lit("년 "), month.cast("string"), F.lit("월 "), dom.cast("string"), F.lit("일"))


def period(start: Column, end: Column, lang: str = "ko") -> Column:
    s, e = short_date(start, lang), short_date(end, lang)
    return (
        F.when(start.isNotNull() & end.isNotNull(), F.concat(s, F.lit(" – "), e))
        .when(end.isNotNull(), F.concat(F.lit("~ "), e))
        .when(start.isNotNull(), F.concat(s, F.lit(" ~")))
    )


def csv_day(when: Column) -> Column:
    """M/D/YYYY without leading zeros."""
    return F.concat_ws("/", _number(when, 6, 2).cast("string"), _number(when, 9, 2).cast("string"), F.substring(when, 1, 4))


def csv_clock(when: Column) -> Column:
    """12-hour clock; empty for all-day values."""
    hour = _number(when, 12, 2)
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12).cast("string")
    text = F.concat(twelve, F.lit(":"), F.substring(when, 15, 2), F.when(hour >= 12, " PM").otherwise(" AM"))
    return F.when(is_timed(when), text).otherwise("")


def ics_day(when: Column, add_days: int = 0) -> Column:
    return F.date_format(F.date_add(day(when), add_days), "yyyyMMdd")


def ics_utc(when: Column, add_hours: int = 0) -> Column:
    """Seoul wall clock to a compact UTC instant. The offset is fixed, so no zone database is needed."""
    moment = F.try_to_timestamp(F.substring(when, 1, 16), F.lit("yyyy-MM-dd'T'HH:mm"))
    shifted = moment.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(add_hours - 9))
    return F.date_format(shifted, "yyyyMMdd'T'HHmmss'Z'")


def entrance_year(academic_year: Column, today: date) -> Column:
    """Usual entrance year of a student in the given academic year."""
    return F.lit(today.year) - academic_year + 1
