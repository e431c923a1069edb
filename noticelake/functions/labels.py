"""Language-dependent projections of a notice and its analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake import dims


def effective_deadline(deadline: Column, application_end: Column) -> Column:
    return F.coalesce(deadline, application_end)


def notice_title(title: Column, en: Column, lang: str) -> Column:
    return F.coalesce(en["title"], title) if lang == "en" else title


def english_missing(has_analysis: Column, en: Column, lang: str) -> Column:
    return (has_analysis & en.isNull()) if lang == "en" else F.lit(False)


def summary_line(summary: Column, explanation: Column, en: Column, lang: str) -> Column:
    """First bullet, else the explanation; the translation when it exists and is asked for."""
    korean = F.coalesce(F.try_element_at(summary, F.lit(1)), explanation, F.lit(""))
    if lang != "en":
        return korean
    english = F.coalesce(F.try_element_at(en["summary"], F.lit(1)), en["easyExplanation"], F.lit(""))
    return F.when(en.isNotNull(), english).otherwise(korean)


def category_name(category: Column, lang: str, names: dict[str, str] | None = None) -> Column:
    if lang != "en":
        return category
    pairs = [F.lit(x) for kv in (names or dims.CATEGORY_EN).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), category)


def board_label(major: Column, college: Column, lang: str = "ko") -> Column:
    return F.coalesce(major, college, F.lit(dims.LABELS[lang]["main"]))


def event_label(kind: Column, lang: str = "ko") -> Column:
    return F.when(kind == "deadline", dims.LABELS[lang]["deadline"]).otherwise(dims.LABELS[lang]["event"])


def prompt_text(title: Column, published: Column, category: Column, body: Column, attachments: Column) -> Column:
    """The document handed to the analyser. Attachment notes name what the text does not contain."""
    names = F.transform(attachments, lambda a: F.concat(a["kind"], F.lit(' "'), a["name"], F.lit('"')))
    note = F.when(
        F.size(attachments) > 0, F.concat(F.lit("\n\n[Not visible to you: "), F.array_join(names, ", "), F.lit("]"))
    )
    unknown = F.lit("unknown")
    return F.concat(
        F.lit("제목: "), title,
        F.lit("\n게시일(publication date): "), F.coalesce(published.cast("string"), unknown),
        F.lit("\n게시판 분류: "), F.coalesce(category, unknown),
        F.lit("\n\n본문:\n"), body, F.coalesce(note, F.lit("")),
    )
