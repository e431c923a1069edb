"""Keyword search over list items: predicate, spans, highlights, excerpts and the best field to show."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake import dims
from noticelake.functions.arrays import bound, running_max, running_sums
from noticelake.functions.labels import category_name, notice_title
from noticelake.functions.text import WS_CLASS, search_form
from noticelake.operators.grams import BROADCAST_GRAMS, candidates
from noticelake.session import ensure_checkpoint_dir

LITERAL_QUERIES = 100  # queries that are tested on every item in one pass; more of them are looked up in an index
_BLANK = re.compile(r"[\s\x0b\xa0  -     　﻿]+")


def search_terms(query: str) -> list[str]:
    """Words of a query in the form fields are compared in."""
    return [w.lower() for w in _BLANK.split(query) if w]


def search_fields(items: DataFrame, lang: str, category_names: dict[str, str] | None = None) -> Column:
    """Searchable fields, kept apart so that no term matches across two of them.

    ``items``: title, has_analysis, summary, target, category and ``en`` (null when not translated).
    A pending item has only its title.
    """
    en = F.col("en")
    use_en = en.isNotNull() if lang == "en" else F.lit(False)
    summary = F.when(use_en, en["summary"]).otherwise(F.col("summary"))
    target = F.when(use_en, en["target"]).otherwise(F.col("target"))
    title = notice_title(F.col("title"), en, lang)
    full = F.concat(F.array(title), summary, F.array(target, category_name(F.col("category"), lang, category_names)))
    return F.when(F.col("has_analysis"), full).otherwise(F.array("title"))


def _in_some_field(fields: Column, term: Column) -> Column:
    return F.exists(fields, lambda f: F.contains(f, term))


def with_search_forms(items: DataFrame, lang: str, category_names: dict[str, str] | None = None) -> DataFrame:
    """Adds ``search_forms``: every field normalised once, however many queries follow."""
    fields = search_fields(items, lang, category_names)
    return items.withColumn("search_forms", F.transform(fields, search_form))


def search(items: DataFrame, query: str, lang: str = "ko", category_names: dict[str, str] | None = None) -> DataFrame:
    """Items in which every term occurs in at least one field; an empty query keeps all."""
    terms = search_terms(query)
    if not terms:
        return items
    ready = with_search_forms(items, lang, category_names)
    for term in terms:
        ready = ready.filter(_in_some_field(F.col("search_forms"), F.lit(term)))
    return ready.drop("search_forms")


def query_terms(query: Column) -> Column:
    """``search_terms`` of a column: null has none."""
    return F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), WS_CLASS + "+"), lambda w: w != "")


def search_many(items: DataFrame, queries: dict[str, str] | DataFrame, lang: str = "ko", category_names: dict[str, str] | None = None, item_id: str = "id") -> DataFrame:
    """(query_id, item) for many saved queries: a dict, or a DataFrame of query_id and query. ``item_id`` names the items.

    A few queries in a dict are tested on the items in one pass. Any others meet the items through an index on short
    character sequences: each query finds its candidates by its rarest one, and all its terms are verified on these. A
    query without terms keeps all items, so it gives a row for each.
    """
    ready = with_search_forms(items, lang, category_names)
    if isinstance(queries, dict) and len(queries) > LITERAL_QUERIES:
        queries = items.sparkSession.createDataFrame(list(queries.items()), "query_id string, query string")
    if isinstance(queries, dict):
        table = F.array(*[
            F.struct(F.lit(q).alias("query_id"), F.array(*[F.lit(t) for t in search_terms(text)]).cast("array<string>").alias("terms"))
            for q, text in queries.items()
        ])
        hits = F.filter(table, lambda q: F.forall(q["terms"], lambda t: _in_some_field(F.col("search_forms"), t)))
        return ready.withColumn("query_id", F.explode(F.transform(hits, lambda q: q["query_id"]))).drop("search_forms")
    return _search_index(ready, queries, item_id).drop("search_forms")


def query_classes(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, query) plus ``query_class``: equal for queries of the same terms, which find the same items."""
    return queries.withColumn("query_class", F.array_join(F.array_sort(F.array_distinct(query_terms(F.col("query")))), " "))


def _search_index(ready: DataFrame, queries: DataFrame, item_id: str) -> DataFrame:
    ensure_checkpoint_dir(ready.sparkSession)
    asked = query_classes(queries).select("query_id", "query_class").checkpoint()
    worded = asked.filter("query_class != '' and query_id is not null")
    # queries of the same terms are searched as one
    classes = worded.select(F.col("query_class").alias("needle_id")).distinct().withColumn("terms", F.split("needle_id", " ")).checkpoint()
    met = candidates(ready.select(F.col(item_id).alias("text_id"), F.col("search_forms").alias("parts")), classes)
    met = met.withColumnsRenamed({"text_id": "_item", "terms": "_terms", "needle_id": "_class"})
    rows = ready.join(met, ready[item_id] == met["_item"])
    rows = rows.filter(F.forall("_terms", lambda t: _in_some_field(F.col("search_forms"), t)))
    ids = worded.withColumnRenamed("query_class", "_class")
    few = worded.count() <= BROADCAST_GRAMS // 4
    rows = rows.join(F.broadcast(ids) if few else ids, "_class").select(*ready.columns, "query_id")
    blank = asked.filter("query_class = ''").select("query_id")
    if blank.isEmpty():
        return rows
    # every item for each of them: the rows asked for, made item by item from a list that is small or else comes in parts
    lists = blank.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(64)).alias("part")).agg(F.collect_list("query_id").alias("ids"))
    every = ready.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63)))).join(lists, "part").drop("part")
    return rows.unionByName(every.withColumn("query_id", F.explode("ids")).drop("ids"))


def _hits(low: Column, term: str) -> Column:
    """Structs (s, e) of every place of the term in a lower-case text, white space inside it aside."""
    pattern = (WS_CLASS + "*").join(f"\\x{{{ord(c):X}}}" for c in term)
    # zero-width matches, so that hits may overlap: the pieces between them give the starts
    widths = F.transform(F.regexp_extract_all(low, F.lit(f"(?=({pattern}))"), F.lit(1)), F.length)
    pieces = F.transform(F.split(low, f"(?={pattern})", -1), F.length)
    ends = running_sums(F.concat(F.array(F.lit(0)), pieces))

    def spans(widths: Column) -> Column:
        # the last piece ends the text; a piece stands before the first hit unless the text begins with it
        starts = bound(ends, lambda e: F.slice(e, F.size(e) - F.size(widths), F.size(widths)))
        return F.zip_with(starts, widths, lambda s, n: F.struct(s.alias("s"), (s + n).alias("e")))

    return bound(widths, spans)


def _merged(spans: Column) -> Column:
    """Sorted spans, those that overlap or touch as one."""

    def join(sorted_: Column, reach: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (F.get(sorted_, i)["s"] > F.get(reach, i - 1)))
        return bound(first, lambda f: F.transform(f, lambda i, j: F.struct(
            F.get(sorted_, i)["s"].alias("s"), F.get(reach, F.coalesce(F.get(f, j + 1), F.size(sorted_)) - 1).alias("e"))))

    return bound(spans, lambda x: bound(running_max(F.transform(x, lambda y: y["e"])), lambda reach: F.when(F.size(x) > 0, join(x, reach)).otherwise(x)))


def match_spans(text: Column, terms: list[str]) -> Column:
    """[s, e) of every hit in the original text, merged where they overlap or touch.

    Hits ignore case and white space. Positions count code points; the one letter whose lower case is longer stays as it is.
    """
    terms = [t for t in dict.fromkeys(terms) if t]
    none = F.array().cast("array<struct<s:int,e:int>>")
    if not terms:
        return none
    form = search_form(text)
    some = reduce(lambda a, b: a | b, [F.contains(form, F.lit(t)) for t in terms])
    low = F.array_join(F.transform(F.split(text, "\u0130", -1), F.lower), "\u0130")
    hits = bound(low, lambda x: F.array_sort(F.concat(*[_hits(x, t) for t in terms])))
    return F.when(some, _merged(hits)).otherwise(none)


def highlight(text: Column, spans: Column) -> Column:
    """Alternating plain and matched parts, joined they give the text again."""
    size = F.size(spans)
    one = F.lit(1)

    def part(start: Column, end: Column, hit: bool) -> Column:
        return F.struct(F.substring(text, start + one, end - start).alias("text"), F.lit(hit).alias("match"))

    def around(span: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["e"])
        return F.array(part(before, span["s"], False), part(span["s"], span["e"], True))

    tail = part(F.coalesce(F.get(spans, size - 1)["e"], F.lit(0)), F.length(text), False)
    return F.filter(F.concat(F.flatten(F.transform(spans, around)), F.array(tail)), lambda p: p["text"] != "")


def excerpt(text: Column, spans: Column, radius: int = dims.EXCERPT_RADIUS) -> Column:
    """The text around its first hit with ellipses where it was cut; unchanged without a hit."""
    first = F.get(spans, F.lit(0))
    start = F.greatest(F.lit(0), first["s"] - radius)
    end = F.least(F.length(text), first["e"] + radius)
    cut = F.concat(
        F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "…").otherwise("")
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def best_match(items: DataFrame, query: str, lang: str = "ko") -> DataFrame:
    """Adds ``best_field`` (title, summary, target or null) and ``best_text``; here any term suffices."""
    terms = search_terms(query)
    if not terms:
        return items.withColumns({"best_field": F.lit(None).cast("string"), "best_text": F.lit(None).cast("string")})
    en = F.col("en")
    use_en = en.isNotNull() if lang == "en" else F.lit(False)

    def hit(text: Column) -> Column:
        form, some = search_form(text), F.lit(False)
        for t in terms:
            some = some | F.contains(form, F.lit(t))
        return some

    summary = F.when(use_en, en["summary"]).otherwise(F.col("summary"))
    target = F.when(use_en, en["target"]).otherwise(F.col("target"))
    title = notice_title(F.col("title"), en, lang)
    bullet = F.try_element_at(F.filter(summary, hit), F.lit(1))
    staged = items.withColumns({"_title": title, "_bullet": F.when(F.col("has_analysis"), bullet), "_target": F.when(F.col("has_analysis"), target)})
    field = F.when(hit(F.col("_title")), "title").when(F.col("_bullet").isNotNull(), "summary").when(hit(F.col("_target")), "target")
    staged = staged.withColumn("best_field", field)
    raw = F.when(F.col("best_field") == "summary", F.col("_bullet")).when(F.col("best_field") == "target", F.col("_target"))
    staged = staged.withColumn("_raw", raw)
    staged = staged.withColumn("_spans", match_spans(F.col("_raw"), terms))
    text = F.when(F.col("best_field") == "title", F.col("_title")).otherwise(excerpt(F.col("_raw"), F.col("_spans")))
    return staged.withColumn("best_text", text).drop("_title", "_bullet", "_target", "_raw", "_spans")
