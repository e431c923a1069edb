"""Calendar files: CSV and iCalendar export of events, iCalendar import."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.dims import LABELS
from noticelake.functions import dates, text
from noticelake.functions.labels import event_label

# The columns calendar apps expect, in order.
CSV_COLUMNS = [
    "Subject", "Start Date", "Start Time", "End Date", "End Time", "All Day Event", "Description", "Location", "Private",
]


def _subject(lang: str) -> Column:
    return F.concat(F.lit("["), event_label(F.col("kind"), lang), F.lit("] "), F.col("title"))


def csv_rows(events: DataFrame, lang: str = "ko") -> DataFrame:
    """One CSV row per event. ``events``: kind, date, title, source_url."""
    when, timed = F.col("date"), dates.is_timed(F.col("date"))
    about = F.concat(F.lit(f"{LABELS[lang]['description']} {LABELS[lang]['source']}: "), F.col("source_url"))
    values = [
        _subject(lang), dates.csv_day(when), dates.csv_clock(when), dates.csv_day(when), dates.csv_clock(when),
        F.when(timed, "False").otherwise("True"), about, F.lit(""), F.lit("False"),
    ]
    return events.select(*[v.alias(name) for v, name in zip(values, CSV_COLUMNS, strict=True)])


def csv_field(value: Column) -> Column:
    """Quoted only when needed."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)


def write_csv(rows: DataFrame, path: str) -> bool:
    """Part files that are each a complete CSV: byte order mark, header, CRLF. Nothing is written for no rows."""
    if rows.isEmpty():
        return False
    header = ",".join(rows.columns)
    lines = rows.select(F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in rows.columns]).alias("value"))

    def with_header(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for part in parts:
            if first and len(part):
                yield pd.DataFrame({"value": ["﻿" + header]})
                first = False
            yield part

    lines.mapInPandas(with_header, "value string").write.mode("errorifexists").option("lineSep", "\r\n").text(path)
    return True


# --- iCalendar export ----------------------------------------------------------------------------------

def ics_escape(value: Column) -> Column:
    text = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.regexp_replace(text, "([,;])", r"\\$1")


def ics_blocks(events: DataFrame, stamp: str, uid_prefix: str, uid_domain: str, lang: str = "ko") -> DataFrame:
    """Adds ``block``: the unfolded VEVENT of each event, lines joined by CRLF.

    ``events``: kind, date, title, source_notice_id, source_url. ``stamp``: compact UTC creation time.
    """
    when, timed = F.col("date"), dates.is_timed(F.col("date"))
    timed_lines = F.concat(F.lit("DTSTART:"), dates.ics_utc(when), F.lit("\r\nDTEND:"), dates.ics_utc(when, 1))
    day_lines = F.concat(
        F.lit("DTSTART;VALUE=DATE:"), dates.ics_day(when), F.lit("\r\nDTEND;VALUE=DATE:"), dates.ics_day(when, 1)
    )
    about = F.concat(F.lit(f"{LABELS[lang]['description']}\n{LABELS[lang]['source']}: "), F.col("source_url"))
    uid = F.concat(F.lit(f"{uid_prefix}-"), "source_notice_id", F.lit("-"), "kind", F.lit(f"@{uid_domain}"))
    block = F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), uid),
        F.lit(f"DTSTAMP:{stamp}"),
        F.when(timed, timed_lines).otherwise(day_lines),
        F.concat(F.lit("SUMMARY:"), ics_escape(_subject(lang))),
        F.concat(F.lit("DESCRIPTION:"), ics_escape(about)),
        F.concat(F.lit("URL:"), "source_url"),
        F.lit("END:VEVENT"),
    )
    return events.withColumn("block", block)


# Octets that may follow a cut: any but the second and later ones of a character.
_WHOLE = r"(?![\x80-\xBF])"


def _fold_line(line: Column) -> Column:
    # one character per octet, so that a pattern counts octets and sees where a character goes on
    octets = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    first = F.regexp_extract(octets, f"(?s)^.{{1,75}}{_WHOLE}", 0)
    rest = F.substring(octets, F.length(first) + 1, F.length(octets))
    folded = F.concat(first, F.regexp_replace(rest, f"(?s).{{1,74}}{_WHOLE}", "\r\n $0"))
    return F.when(F.octet_length(line) <= 75, line).otherwise(F.decode(F.encode(folded, "ISO-8859-1"), "UTF-8"))


def ics_fold(block: Column) -> Column:
    """Lines of more than 75 octets are folded (74 after the leading blank) without cutting a character."""
    return F.array_join(F.transform(F.split(block, "\r\n"), _fold_line), "\r\n")


def calendar_head(product: str) -> str:
    return "\r\n".join(["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:{product}", "CALSCALE:GREGORIAN", "METHOD:PUBLISH"])


def calendar_text(blocks: Column, product: str) -> Column:
    """A whole calendar from folded blocks."""
    return F.concat(F.lit(calendar_head(product) + "\r\n"), blocks, F.lit("\r\nEND:VCALENDAR\r\n"))


def write_ics(blocks: DataFrame, path: str, product: str) -> bool:
    """Folded blocks to part files, each a complete calendar."""
    if blocks.isEmpty():
        return False
    head = calendar_head(product)

    def wrap(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for part in parts:
            if first and len(part):
                yield pd.DataFrame({"value": [head]})
                first = False
            yield part
        if not first:
            yield pd.DataFrame({"value": ["END:VCALENDAR"]})

    folded = blocks.select(ics_fold(F.col("block")).alias("value"))
    folded.mapInPandas(wrap, "value string").write.mode("errorifexists").option("lineSep", "\r\n").text(path)
    return True


# --- iCalendar import ----------------------------------------------------------------------------------

def read_ics(spark: SparkSession, path: str) -> DataFrame:
    """Events of calendar files, whatever their size: a file is read by many tasks, event by event.

    Records end at a line break and BEGIN:VEVENT, so a record is one event, or what stands before the first. Files whose
    lines end in a single CR have one record, which holds all of their events. No line of a calendar starts with
    BEGIN:VEVENT and goes on; one that does is taken as the end of the event before.
    """
    records = spark.read.option("lineSep", "\nBEGIN:VEVENT").text(path)
    opened = F.col("value").startswith("\n") | F.col("value").startswith("\r")
    return parse_ics(records.select(F.when(opened, F.concat(F.lit("BEGIN:VEVENT"), "value")).otherwise(F.col("value")).alias("text"))).drop("seq")


def _last_field(block: Column, name: str) -> Column:
    values = F.regexp_extract_all(block, F.lit(rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$"), 1)
    return F.try_element_at(values, F.lit(-1))


def ics_unescape(value: Column) -> Column:
    text = F.regexp_replace(value, r"\\[nN]", "\n")
    text = F.replace(F.replace(text, F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";"))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def parse_ics(files: DataFrame) -> DataFrame:
    """Every VEVENT with a usable DTSTART as (uid, title, date, all_day), plus the other input columns.

    Repeating events are taken once, at their first date. ``...Z`` times move to Seoul wall clock.
    """
    rest = [c for c in files.columns if c != "text"]
    lines = F.regexp_replace(F.regexp_replace("text", "\r\n|\r", "\n"), "\n[ \t]", "")
    # what follows each BEGIN up to its END; a BEGIN without END is dropped in favour of the next one
    opened = F.split(F.concat(F.lit("\n"), lines), r"(?<=\n)BEGIN:VEVENT(?=\n)")
    closed = F.transform(opened, lambda part: F.split(part, r"(?<=\n)END:VEVENT(?=\n|$)", 2))
    whole = F.filter(closed, lambda part, n: (n > 0) & (F.size(part) == 2))

    def fields(part: Column) -> Column:
        block = part[0]
        return F.struct(
            text.strip(_last_field(block, "UID")).alias("raw_uid"),
            ics_unescape(F.coalesce(_last_field(block, "SUMMARY"), F.lit(""))).alias("title"),
            text.strip(_last_field(block, "DTSTART")).alias("start"),
        )

    # fields are read before the events are taken apart, so that no filter reads them again
    events = files.select(*rest, F.posexplode(F.transform(whole, fields)).alias("seq", "e")).select(*rest, "seq", "e.*")
    pattern = "^[0-9]{8}(T[0-9]{6}Z?)?$"
    start = F.col("start")
    day = F.concat_ws("-", F.substring(start, 1, 4), F.substring(start, 5, 2), F.substring(start, 7, 2))
    local = F.concat(day, F.lit("T"), F.substring(start, 10, 2), F.lit(":"), F.substring(start, 12, 2))
    utc = F.try_to_timestamp(local, F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz")
    moved = F.date_format(utc + F.make_dt_interval(F.lit(0), F.lit(9)), "yyyy-MM-dd'T'HH:mm")
    all_day = F.length(start) == 8
    date = F.when(all_day, day).when(start.endswith("Z"), moved).otherwise(local)
    out = events.filter(F.col("start").rlike(pattern)).select(*rest, "seq", "raw_uid", "title", date.alias("date"), all_day.alias("all_day"))
    uid = F.when(F.coalesce("raw_uid", F.lit("")) != "", F.col("raw_uid")).otherwise(F.concat("date", F.lit("-"), "title"))
    return out.select(*rest, "seq", uid.alias("uid"), "title", "date", "all_day")
