"""Queries over text: search, language projection, validation of analyses, scalar text functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake import schemas
from noticelake.functions import labels, text
from noticelake.operators import analyse, search, validate
from noticelake.operators.views import stored_record
from noticelake.plans import adapters as ad
from noticelake.plans.adapters import ctes
from noticelake.plans.registry import query

WS = text.WS_CLASS
DOCS = ad.NOTICE_DOCS
CATEGORY_NAMES = {"academic": "Academic affairs", "recruitment": "Recruitment", "other": "Other"}


# --- search items: documents with one bullet per line -----------------------------------------------------

def search_items(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.notice_docs(spark, sf)
    labels_ = ad.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, "other").when(F.col("quality") == 1, "academic").otherwise("recruitment").alias("category"),
    )
    lines = F.split("original_content", "\n")
    target = F.concat(F.lit("Readers of "), "board_category", F.lit(" at "), "source")
    en = F.struct(
        F.concat(F.lit("EN "), "title").alias("title"),
        F.transform(lines, lambda x: F.concat(F.lit("Line: "), x)).alias("summary"),
        F.lit("").alias("easyExplanation"),
        F.concat(F.lit("Anyone "), "board_category").alias("target"),
        F.lit(None).cast("string").alias("eventInfo"),
    )
    out = docs.join(labels_, "id", "left").withColumns({
        "has_analysis": F.col("category").isNotNull(), "summary": lines, "target": target,
        "en": F.when(F.col("category").isNotNull() & (F.col("id") % 2 == 0), en),
    })
    return out.select("id", "title", "has_analysis", "category", "summary", "target", "en")


SEARCH_ITEMS = """search_items AS (
  SELECT n.id, title, l.doc_id IS NOT NULL AS has_analysis,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'other' WHEN quality = 1 THEN 'academic' ELSE 'recruitment' END AS category,
    string_split(original_content, chr(10)) AS summary, 'Readers of ' || board_category || ' at ' || source AS target,
    l.doc_id IS NOT NULL AND n.id % 2 = 0 AS has_en, 'EN ' || title AS en_title,
    list_transform(string_split(original_content, chr(10)), lambda x: 'Line: ' || x) AS en_summary, 'Anyone ' || board_category AS en_target
  FROM notice_docs n LEFT JOIN labels l ON l.doc_id = n.id),
fields AS (
  SELECT *, list_transform(CASE WHEN NOT has_analysis THEN [title] ELSE list_concat([title], list_concat(summary, [target, category])) END,
     lambda f: lower(regexp_replace(f, '{WS}+', '', 'g'))) AS ko,
   list_transform(CASE WHEN NOT has_analysis THEN [title]
     WHEN has_en THEN list_concat([en_title], list_concat(en_summary, [en_target, en_category]))
     ELSE list_concat([title], list_concat(summary, [target, en_category])) END,
     lambda f: lower(regexp_replace(f, '{WS}+', '', 'g'))) AS en
  FROM (SELECT *, CASE category WHEN 'academic' THEN 'Academic affairs' WHEN 'recruitment' THEN 'Recruitment' WHEN 'other' THEN 'Other' END AS en_category
        FROM search_items))""".replace("{WS}", WS)


def _has(lang: str, term: str) -> str:
    return f"len(list_filter({lang}, lambda f: contains(f, '{term}'))) > 0"


@query(
    "search_match",
    ctes(DOCS, SEARCH_ITEMS)
    + f"""SELECT 'q1' AS query_id, id FROM fields WHERE {_has('ko', 'thor')} AND {_has('ko', 'readers')}
UNION ALL SELECT 'q2', id FROM fields WHERE {_has('ko', 'eaudes')}
UNION ALL SELECT 'q3', id FROM fields
UNION ALL SELECT 'q4', id FROM fields WHERE {_has('ko', 'academic')} AND {_has('ko', 'src1')} AND {_has('ko', 'fr')}""",
)
def _(spark, sf):
    queries = {"q1": "  THOR readers ", "q2": "eauDes", "q3": " ", "q4": "academic src1 fr"}
    return search.search_many(search_items(spark, sf), queries).select("query_id", "id")


@query(
    "search_saved",
    ctes(DOCS, SEARCH_ITEMS)
    + """, saved AS (SELECT c_custkey, lower(c_mktsegment[1:3]) AS a, 'src' || (c_custkey % 20) AS b, CASE c_custkey % 3 WHEN 0 THEN 'academic' WHEN 1 THEN 'readersof' ELSE 'x' || c_custkey END AS c FROM customer),
distinct_queries AS (SELECT DISTINCT a, b, c FROM saved),
found AS (
  SELECT q.a, q.b, q.c, count(*) AS n_items, min(f.id) AS first_item FROM distinct_queries q JOIN fields f
    ON len(list_filter(ko, lambda x: contains(x, q.a))) > 0 AND len(list_filter(ko, lambda x: contains(x, q.b))) > 0 AND len(list_filter(ko, lambda x: contains(x, q.c))) > 0
  GROUP BY q.a, q.b, q.c)
SELECT c_custkey AS query_id, n_items, first_item FROM saved JOIN found USING (a, b, c)""",
)
def _(spark, sf):
    """Every customer's saved query of three terms, over all items."""
    key = F.col("c_custkey")
    third = F.when(key % 3 == 0, "Academic").when(key % 3 == 1, "READERSof").otherwise(F.concat(F.lit("x"), key.cast("string")))
    saved = ad.table(spark, sf, "customer").select(
        key.alias("query_id"), F.concat(F.substring("c_mktsegment", 1, 3), F.lit("  src"), (key % 20).cast("string"), F.lit(" "), third).alias("query"))
    # customers who ask for the same terms find the same items: these are counted once
    classes = search.query_classes(saved)
    asked = classes.select(F.col("query_class").alias("query_id"), F.col("query_class").alias("query")).distinct()
    out = search.search_many(search_items(spark, sf), asked)
    found = out.groupBy(F.col("query_id").alias("query_class")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return classes.join(found, "query_class").groupBy("query_id").agg(F.sum("n").alias("n_items"), F.min("first").alias("first_item"))


@query(
    "search_english",
    ctes(DOCS, SEARCH_ITEMS) + f"SELECT id FROM fields WHERE {_has('en', 'line:the')} AND {_has('en', 'academicaff')}",
)
def _(spark, sf):
    return search.search(search_items(spark, sf), "Line:The AcademicAff", "en", CATEGORY_NAMES).select("id")


THOR = rf"(t{WS}*h{WS}*o{WS}*r)+"


def _thor(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.notice_docs(spark, sf).select("id", F.col("original_content").alias("body"))
    return docs.withColumn("spans", search.match_spans(F.col("body"), ["thor"]))


@query(
    "search_spans",
    ctes(DOCS)
    + rf"""SELECT id, len(m) AS n, array_to_string(m, '|') AS hits
FROM (SELECT id, regexp_extract_all(original_content, '(?i){THOR}', 0) AS m FROM notice_docs)""",
)
def _(spark, sf):
    hits = F.transform("spans", lambda s: F.substring("body", s["s"] + 1, s["e"] - s["s"]))
    return _thor(spark, sf).select("id", F.size("spans").alias("n"), F.array_join(hits, "|").alias("hits"))


@query(
    "search_highlight",
    ctes(DOCS) + rf"""SELECT id, sha256(regexp_replace(original_content, '((?i){THOR})', '<b>\1</b>', 'g')) AS marked FROM notice_docs""",
)
def _(spark, sf):
    parts = search.highlight(F.col("body"), F.col("spans"))
    marked = F.transform(parts, lambda p: F.when(p["match"], F.concat(F.lit("<b>"), p["text"], F.lit("</b>"))).otherwise(p["text"]))
    return _thor(spark, sf).select("id", F.sha2(F.array_join(marked, ""), 256).alias("marked"))


@query(
    "search_excerpt",
    ctes(DOCS)
    + rf"""SELECT id, CASE WHEN m = '' THEN sha256(body) ELSE
  (CASE WHEN s > 24 THEN '…' ELSE '' END) || substr(body, greatest(0, s - 24) + 1, least(length(body), s + length(m) + 24) - greatest(0, s - 24))
  || (CASE WHEN s + length(m) + 24 < length(body) THEN '…' ELSE '' END) END AS excerpt
FROM (SELECT *, strpos(body, m) - 1 AS s FROM (SELECT id, original_content AS body, regexp_extract(original_content, '(?i){THOR}', 0) AS m FROM notice_docs))""",
)
def _(spark, sf):
    cut = search.excerpt(F.col("body"), F.col("spans"))
    return _thor(spark, sf).select("id", F.when(F.size("spans") > 0, cut).otherwise(F.sha2("body", 256)).alias("excerpt"))


@query(
    "search_best_field",
    ctes(DOCS, SEARCH_ITEMS)
    + """SELECT id, CASE WHEN contains(lower(regexp_replace(title, '{WS}+', '', 'g')), 'thor') THEN 'title'
  WHEN has_analysis AND len(list_filter(summary, lambda f: contains(lower(regexp_replace(f, '{WS}+', '', 'g')), 'thor') OR contains(lower(regexp_replace(f, '{WS}+', '', 'g')), 'atsrc7'))) > 0 THEN 'summary'
  WHEN has_analysis AND contains(lower(regexp_replace(target, '{WS}+', '', 'g')), 'atsrc7') THEN 'target' ELSE '-' END AS field FROM search_items""".replace("{WS}", WS),
)
def _(spark, sf):
    out = search.best_match(search_items(spark, sf), "thor atsrc7")
    return out.select("id", F.coalesce("best_field", F.lit("-")).alias("field"))


EITHER = f"(t{WS}*h{WS}*o{WS}*r|a{WS}*t{WS}*s{WS}*r{WS}*c{WS}*7)+"
BEST_TEXT = r"""shown AS (
  SELECT id, CASE WHEN has_en THEN en_title ELSE title END AS title, CASE WHEN NOT has_analysis THEN NULL WHEN has_en THEN en_target ELSE target END AS target,
    CASE WHEN has_analysis THEN list_filter(CASE WHEN has_en THEN en_summary ELSE summary END, lambda x: regexp_matches(x, '(?i){P}'))[1] END AS bullet
  FROM search_items),
found AS (
  SELECT *, CASE WHEN regexp_matches(title, '(?i){P}') THEN 'title' WHEN bullet IS NOT NULL THEN 'summary' WHEN regexp_matches(target, '(?i){P}') THEN 'target' END AS best_field,
    CASE WHEN bullet IS NOT NULL THEN bullet ELSE target END AS body FROM shown),
around AS (SELECT *, strpos(body, m) - 1 AS s, length(m) AS n FROM (SELECT *, regexp_extract(body, '(?i){P}', 0) AS m FROM found))""".replace("{P}", EITHER)


@query(
    "search_best_text",
    ctes(DOCS, SEARCH_ITEMS, BEST_TEXT)
    + """SELECT id, best_field, CASE WHEN best_field = 'title' THEN title ELSE (CASE WHEN s > 24 THEN '…' ELSE '' END)
  || substr(body, greatest(0, s - 24) + 1, least(length(body), s + n + 24) - greatest(0, s - 24)) || (CASE WHEN s + n + 24 < length(body) THEN '…' ELSE '' END) END AS best_text
FROM around WHERE best_field IS NOT NULL""",
)
def _(spark, sf):
    out = search.best_match(search_items(spark, sf), "thor atsrc7", "en")
    return out.select("id", "best_field", "best_text").filter("best_field is not null")


# --- language projection ------------------------------------------------------------------------------------

@query(
    "lang_projection",
    ctes(DOCS, SEARCH_ITEMS)
    + """SELECT id, title AS title_ko, CASE WHEN has_en THEN en_title ELSE title END AS title_en,
  CASE WHEN NOT has_analysis THEN '' ELSE coalesce(summary[1], '') END AS line_ko,
  CASE WHEN NOT has_analysis THEN '' WHEN has_en THEN en_summary[1] ELSE coalesce(summary[1], '') END AS line_en,
  has_analysis AND NOT has_en AS english_missing,
  CASE category WHEN 'academic' THEN 'Academic affairs' WHEN 'recruitment' THEN 'Recruitment' WHEN 'other' THEN 'Other' ELSE '-' END AS category_en
FROM search_items""",
)
def _(spark, sf):
    items = search_items(spark, sf)
    summary = F.when(F.col("has_analysis"), F.col("summary"))
    none = F.lit(None).cast("string")
    return items.select(
        "id", labels.notice_title(F.col("title"), F.col("en"), "ko").alias("title_ko"), labels.notice_title(F.col("title"), F.col("en"), "en").alias("title_en"),
        labels.summary_line(summary, none, F.col("en"), "ko").alias("line_ko"), labels.summary_line(summary, none, F.col("en"), "en").alias("line_en"),
        labels.english_missing(F.col("has_analysis"), F.col("en"), "en").alias("english_missing"),
        F.coalesce(labels.category_name(F.col("category"), "en", CATEGORY_NAMES), F.lit("-")).alias("category_en"),
    )


@query(
    "prompt_text",
    ctes(DOCS)
    + """SELECT id, sha256('제목: ' || title || chr(10) || '게시일(publication date): ' || CASE WHEN id % 6 = 0 THEN 'unknown' ELSE strftime(published_at, '%Y-%m-%d') END
  || chr(10) || '게시판 분류: ' || CASE WHEN board_category = 'de' THEN 'unknown' ELSE board_category END || chr(10) || chr(10) || '본문:' || chr(10) || original_content
  || CASE WHEN id % 4 = 0 THEN chr(10) || chr(10) || '[Not visible to you: image "poster ' || id || '.png", file "form.hwp"]' ELSE '' END) AS prompt FROM notice_docs""",
)
def _(spark, sf):
    return prompts(spark, sf).select("id", F.sha2("prompt", 256).alias("prompt"))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.notice_docs(spark, sf)

    def attachment(kind: str, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit("https://x.example.org/f").alias("url"))

    poster = F.concat(F.lit("poster "), F.col("id").cast("string"), F.lit(".png"))
    some = F.array(attachment("image", poster), attachment("file", F.lit("form.hwp")))
    none = F.array().cast(schemas.ATTACHMENTS)
    prompt = labels.prompt_text(
        F.col("title"), F.when(F.col("id") % 6 != 0, F.col("published_at")),
        F.when(F.col("board_category") != "de", F.col("board_category")), F.col("original_content"),
        F.when(F.col("id") % 4 == 0, some).otherwise(none),
    )
    return docs.withColumn("prompt", prompt)


# --- validation -----------------------------------------------------------------------------------------------

def analysed_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with an analysis struct whose quotes are cut from the text, some of them wrong."""
    n = F.col("id")
    cut = F.regexp_replace(F.substring("original_content", 5, 20), " ", "  ")
    quote = F.when(n % 4 == 0, "missing").when(n % 4 != 1, cut)

    def day(base: str, step: int) -> Column:
        moved = F.date_format(F.date_add(F.lit(base).cast("date"), (n % step).cast("int")), "yyyy-MM-dd")
        return moved

    start = F.when(n % 6 == 0, F.replace(day("2026-09-01", 30), F.lit("-"), F.lit("/"))).when(n % 6 != 5, day("2026-09-01", 30))
    end = F.when(n % 7 != 2, F.concat(day("2026-09-10", 11), F.when(n % 3 == 0, "T18:00").otherwise("")))
    due = F.when(n % 5 != 1, day("2026-09-12", 13))
    event = F.when(n % 3 != 2, day("2026-09-15", 9))
    bullets = F.split("original_content", "\n")
    fields = F.struct(
        F.when(n % 17 == 0, "bogus").otherwise("학사").alias("category"), start.alias("applicationStart"), end.alias("applicationEnd"),
        due.alias("deadline"), event.alias("eventDate"), F.col("source").alias("target"), bullets.alias("summary"), F.lit("쉬운 설명").alias("easyExplanation"),
        F.struct(*[quote.alias(f) for f in validate.DATE_FIELDS]).alias("evidence"),
        F.array(F.struct(F.lit("target").alias("field"), F.lit("inferred").alias("reason"))).alias("uncertain"),
        F.struct(
            F.col("title").alias("title"), F.when(n % 8 == 0, F.array(F.lit("one"))).otherwise(bullets).alias("summary"), F.lit("easy").alias("easyExplanation"),
            F.col("source").alias("target"), F.when(n % 10 == 0, "at the hall").alias("eventInfo"),
        ).alias("en"),
    )
    return ad.notice_docs(spark, sf).withColumn("analysis", fields)


EVIDENCE = """ev AS (
  SELECT id, source, title, original_content, category, quote, bullets, en_bullets, info,
    CASE WHEN id % 6 = 0 THEN replace(d1, '-', '/') WHEN id % 6 <> 5 THEN d1 END AS a_start,
    CASE WHEN id % 7 <> 2 THEN d2 || CASE WHEN id % 3 = 0 THEN 'T18:00' ELSE '' END END AS a_end,
    CASE WHEN id % 5 <> 1 THEN d3 END AS due, CASE WHEN id % 3 <> 2 THEN d4 END AS event
  FROM (SELECT *, CASE WHEN id % 17 = 0 THEN 'bogus' ELSE '학사' END AS category,
    CASE WHEN id % 4 = 0 THEN 'missing' WHEN id % 4 <> 1 THEN replace(substr(original_content, 5, 20), ' ', '  ') END AS quote,
    strftime(DATE '2026-09-01' + CAST(id % 30 AS INTEGER), '%Y-%m-%d') AS d1, strftime(DATE '2026-09-10' + CAST(id % 11 AS INTEGER), '%Y-%m-%d') AS d2,
    strftime(DATE '2026-09-12' + CAST(id % 13 AS INTEGER), '%Y-%m-%d') AS d3, strftime(DATE '2026-09-15' + CAST(id % 9 AS INTEGER), '%Y-%m-%d') AS d4,
    len(string_split(original_content, chr(10))) AS bullets, CASE WHEN id % 8 = 0 THEN 1 ELSE len(string_split(original_content, chr(10))) END AS en_bullets,
    CASE WHEN id % 10 = 0 THEN 'at the hall' END AS info FROM notice_docs))"""


def _evidence_sql(field: str, column: str) -> str:
    form = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2})?$'"
    return f"""CASE WHEN {column} IS NOT NULL AND NOT regexp_matches({column}, {form}) THEN '{field}="' || {column} || '" is not YYYY-MM-DD[THH:mm]' END,
  CASE WHEN {column} IS NULL THEN NULL WHEN coalesce(quote, '') = '' THEN '{field} has a date but no evidence quote'
       WHEN NOT contains(regexp_replace(original_content, '{WS}+', '', 'g'), regexp_replace(quote, '{WS}+', '', 'g'))
       THEN '{field} evidence "' || quote || '" not found verbatim in notice' END"""


@query(
    "evidence_warnings",
    ctes(DOCS, EVIDENCE)
    + "SELECT id, concat_ws(' | ', "
    + ", ".join(_evidence_sql(f, c) for f, c in zip(validate.DATE_FIELDS, ["a_start", "a_end", "due", "event"], strict=True))
    + ") AS warnings FROM ev",
)
def _(spark, sf):
    rows = analysed_docs(spark, sf)
    return rows.select("id", F.array_join(validate.evidence_warnings(F.col("analysis"), F.col("original_content")), " | ").alias("warnings"))


@query(
    "crossfield_warnings",
    ctes(DOCS, EVIDENCE)
    + """SELECT id, concat_ws(' | ', CASE WHEN a_start > a_end THEN 'applicationStart is after applicationEnd' END,
  CASE WHEN event < substr(due, 1, 10) THEN 'eventDate ' || event || ' is before the deadline ' || due || '; check which is which' END,
  CASE WHEN bullets NOT BETWEEN 3 AND 6 THEN 'summary has ' || bullets || ' bullets (expected 3-6)' END,
  CASE WHEN en_bullets <> bullets THEN 'en.summary has ' || en_bullets || ' bullets but summary has ' || bullets END,
  CASE WHEN event IS NULL AND info IS NOT NULL THEN 'en.eventInfo is set but eventDate is null' END) AS warnings FROM ev""",
)
def _(spark, sf):
    rows = analysed_docs(spark, sf)
    return rows.select("id", F.array_join(validate.crossfield_warnings(F.col("analysis")), " | ").alias("warnings"))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses as reply texts: cut off, not finished, or with a field missing or of another type."""
    n = F.col("id")
    full = F.to_json("analysis", {"ignoreNullFields": "false"})
    no_due = F.regexp_replace(full, '"deadline":("[^"]*"|null),"eventDate"', '"eventDate"')
    number = F.regexp_replace(full, '"target":"[^"]*","summary"', '"target":7,"summary"')
    bad_list = F.regexp_replace(full, '"summary":\\["', '"summary":[1,"')
    reply = (
        F.when(n % 9 == 0, F.expr("substring(full_reply, 1, length(full_reply) div 2)")).when(n % 19 == 0, no_due).when(n % 23 == 0, number)
        .when(n % 29 == 0, bad_list).otherwise(full)
    )
    rows = analysed_docs(spark, sf).select("id", "original_content", "analysis", full.alias("full_reply"))
    return rows.select("id", "original_content", reply.alias("reply"), (n % 13 != 0).alias("finished"))


@query(
    "json_contract",
    """SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN 'incomplete' WHEN doc_id % 9 = 0 THEN 'not_json'
  WHEN doc_id % 19 = 0 OR doc_id % 23 = 0 OR doc_id % 29 = 0 OR doc_id % 17 = 0 THEN 'schema' ELSE 'ok' END AS verdict FROM documents""",
)
def _(spark, sf):
    out = validate.check_contract(replies(spark, sf))
    return out.select("id", F.coalesce("error_class", F.lit("ok")).alias("verdict"))


STORED = """SELECT doc_id, lang, source, text, (doc_id % 3 = 0) AS old FROM documents JOIN labels USING (doc_id)"""


def stored_json(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses as stored text: old versions have no translation and no event evidence."""
    docs = ad.table(spark, sf, "documents").join(ad.table(spark, sf, "labels").select("doc_id"), "doc_id")
    old = F.col("doc_id") % 3 == 0
    lines = F.split("text", "\n")
    evidence = F.struct(F.col("lang").alias("deadline"), F.when(~old, F.col("source")).alias("eventDate"))
    en = F.struct(F.concat(F.lit("EN "), "source").alias("title"), lines.alias("summary"))
    return docs.select(
        F.col("doc_id").alias("id"), F.to_json(lines).alias("summary_json"), F.to_json(evidence).alias("evidence_json"),
        F.lit('[{"field":"target","reason":"inferred"}]').alias("uncertain_json"), F.lit("[]").alias("warnings_json"),
        F.when(~old, F.to_json(en)).alias("en_json"),
    )


@query(
    "analysis_decode",
    f"""SELECT doc_id AS id, len(string_split(text, chr(10))) AS bullets, string_split(text, chr(10))[1] AS first_bullet, lang AS deadline_quote,
  CASE WHEN old THEN '-' ELSE source END AS event_quote, CASE WHEN old THEN '-' ELSE 'EN ' || source END AS en_title, 'target' AS doubt, 0 AS warnings
FROM ({STORED})""",
)
def _(spark, sf):
    a = validate.decode_analysis(stored_json(spark, sf))
    return a.select(
        "id", F.size("summary").alias("bullets"), F.col("summary")[0].alias("first_bullet"), F.col("evidence.deadline").alias("deadline_quote"),
        F.coalesce("evidence.eventDate", F.lit("-")).alias("event_quote"), F.coalesce("en.title", F.lit("-")).alias("en_title"),
        F.col("uncertain")[0]["field"].alias("doubt"), F.size("warnings").alias("warnings"),
    )


@query("fn_json_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    rows = ad.table(spark, sf, "events").select("event_id", F.col("props").alias("props_json"))
    return validate.decode_json_columns(rows, {"props_json": "struct<k:bigint>"}).select("event_id", "props.k")


@query(
    "stored_record",
    ctes(ad.NOTICE_DOCS) + "SELECT source, source_notice_id, source_url, title, sha256(original_content) AS body_hash, board_category FROM notice_docs",
)
def _(spark, sf):
    out = stored_record(ad.notice_docs(spark, sf))
    return out.select("source", "source_notice_id", "source_url", "title", F.sha2("original_content", 256).alias("body_hash"), "board_category")


@query(
    "fn_squash",
    f"""SELECT doc_id, sha256(regexp_replace(text, '{WS}+', '', 'g')) AS squashed, sha256(trim(regexp_replace(text, '{WS}+', ' ', 'g'))) AS inline FROM documents""",
)
def _(spark, sf):
    docs = ad.table(spark, sf, "documents")
    return docs.select(
        "doc_id", F.sha2(text.squash(F.col("text")), 256).alias("squashed"), F.sha2(text.normalize_inline(F.col("text")), 256).alias("inline")
    )


@query(
    "fn_board_label",
    ctes(ad.BOARD_DIM) + "SELECT n.doc_id, coalesce(b.major, b.college, '본교') AS ko, coalesce(b.major, b.college, 'University') AS en FROM documents n JOIN board_dim b USING (source)",
)
def _(spark, sf):
    rows = ad.table(spark, sf, "documents").join(ad.board_dim(spark, sf), "source")
    return rows.select("doc_id", *[labels.board_label(F.col("major"), F.col("college"), lang).alias(lang) for lang in ("ko", "en")])


# --- analyser -------------------------------------------------------------------------------------------------

def stub(row: dict) -> tuple[str, bool]:
    """A deterministic analyser: fails for some rows, otherwise returns a small valid reply."""
    if row["id"] % 11 == 0:
        raise analyse.AnalyserError("overload", "busy")
    if row["id"] % 17 == 0:
        raise ValueError("unexpected")
    lines = [line for line in row["prompt"].split("\n") if line][-3:]
    none = dict.fromkeys(validate.DATE_FIELDS)
    reply = {
        "category": "기타", **none, "target": "전체", "summary": lines, "easyExplanation": "", "evidence": none, "uncertain": [],
        "en": {"title": "t", "summary": lines, "easyExplanation": "", "target": "all", "eventInfo": None},
    }
    return json.dumps(reply, ensure_ascii=False), row["id"] % 13 != 0


@query(
    "analyze_stub",
    ctes(DOCS)
    + """SELECT id, content_hash, CASE WHEN id % 11 = 0 THEN 'overload' WHEN id % 17 = 0 THEN 'failed' ELSE 'success' END AS outcome,
  CASE WHEN id % 11 <> 0 AND id % 17 <> 0 AND id % 13 = 0 THEN 'incomplete' END AS error_class,
  CASE WHEN id % 11 <> 0 AND id % 17 <> 0 AND id % 13 <> 0 THEN '' END AS warnings FROM notice_docs""",
)
def _(spark, sf):
    """Every notice through the stub analyser, then the contract check and the warnings."""
    done = analyse.analyse(prompts(spark, sf), stub)
    checked = validate.check_contract(done)
    bodies = ad.notice_docs(spark, sf).select("id", "original_content")
    out = checked.join(bodies, "id")
    warn = F.when(F.col("analysis").isNotNull(), F.array_join(validate.validation_warnings(F.col("analysis"), F.col("original_content")), " | "))
    error = F.when(F.col("outcome") == "success", F.col("error_class"))
    return out.select("id", "content_hash", "outcome", error.alias("error_class"), warn.alias("warnings"))
