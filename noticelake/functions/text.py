"""Text expressions: whitespace, HTML to text, hashes and the duplicate key."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake import dims

# Unicode white space, written so that the class reads the same in Java and RE2.
WS_CLASS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def squash(text: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(text, WS_CLASS + "+", "")


def normalize_inline(text: Column) -> Column:
    """White space runs become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, WS_CLASS + "+", " "))


def search_form(text: Column) -> Column:
    return F.lower(squash(text))


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def tidy_lines(text: Column) -> Column:
    """Per line: collapse blanks and trim; drop empty lines."""
    lines = F.transform(
        F.split(F.regexp_replace(text, r"\x{A0}", " "), "\n"),
        lambda line: F.regexp_replace(F.regexp_replace(line, "[ \t]+", " "), f"^{WS_CLASS}+|{WS_CLASS}+$", ""),
    )
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def html_to_text(html: Column) -> Column:
    """Markup to plain text with regular expressions only (entities stay as written).

    Block ends and ``<br>`` break the line, script and style content and comments go away. The
    entity-aware variant is part of article extraction (sources.pages).
    """
    text = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)</(p|div|li|tr|h[1-6])\s*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return tidy_lines(text)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


# Fixed pattern: one leading tag of a title.
TITLE_TAG = r"\[[^\]]*\]|\([^)]*\)|【[^】]*】|<[^>]*>|★+|☆+"


def dedup_key(title: Column, use_nfkc: bool = True) -> Column:
    """Key that is equal for cross-posted copies; null when the title is too short to be safe.

    Leading tags are dropped. A graduate-school tag marks the key, unless it names undergraduates too.
    """
    text = nfkc(title) if use_nfkc else title
    tags = F.regexp_extract(text, rf"^(?:{WS_CLASS}*(?:{TITLE_TAG}){WS_CLASS}*)+", 0)
    is_grad = F.exists(
        F.regexp_extract_all(tags, F.lit(f"({TITLE_TAG})"), 1), lambda t: t.contains("대학원") & ~t.contains("학부")
    )
    rest = F.substring(text, F.length(tags) + 1, F.length(text))
    core = F.regexp_replace(F.lower(rest), r"[^\p{L}\p{N}]", "")
    return F.when(F.length(core) >= dims.MIN_KEY_CHARS, F.when(is_grad, F.concat(F.lit("grad:"), core)).otherwise(core))
