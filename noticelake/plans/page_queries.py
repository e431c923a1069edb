"""Queries over landed pages and the snapshot export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import text as texts
from noticelake.operators.resolve import assign_canonical
from noticelake.operators.views import CHOICE, detail_by_copy
from noticelake.plans import adapters as ad
from noticelake.plans import store_queries as store
from noticelake.plans.adapters import ctes
from noticelake.plans.registry import query
from noticelake.session import kept, scratch_dir, shuffles_freed
from noticelake.sources import export
from noticelake.sources import pages as pg

WS = texts.WS_CLASS
URL = r"^(https://[^/]+/)[a-z]{2}/([0-9]+)(?:/|\.html)?$"
# the test pages keep their links in a menu and their text in <article>
MARKUP = pg.Markup(
    list_box=("nav", None), list_row=("li", None), list_link=("a", None), list_date=(None, None), title=("h1", None),
    body=("article", None), head=("article", None), download="/",
)


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = ad.table(spark, sf, "pages")
    return pages.withColumn("origin", F.regexp_extract(pg.canonical_url(F.col("url")), "^(https://[^/]+)", 1))


UNESCAPE = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"
NAV = rf"""anchors AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref=["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS label,
    unnest(range(1, 1 + len(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)))) - 1 AS pos,
    'https://' || regexp_extract(url, '^https?://([^/]+)', 1) AS origin FROM pages)"""


@query(
    "page_links",
    ctes(NAV) + f"""SELECT page_id, pos, substr({UNESCAPE.format('href')}, 2) AS source_notice_id,
  trim(regexp_replace({UNESCAPE.format('label')}, '{WS}+', ' ', 'g')) AS title FROM anchors""",
)
def _(spark, sf):
    """The menu of every page read as a list page; each entry is an 'article' named by its path."""
    pages = raw_pages(spark, sf).select(
        F.col("origin").alias("source"), F.col("page_id").alias("page"), "html", F.lit("^/(.+)$").alias("href_pattern"),
        F.concat("origin", F.lit("/")).alias("url_prefix"), F.lit("").alias("url_suffix"),
    )
    listed, _ = pg.listed_from_pages(pages, MARKUP)
    return listed.select(F.col("page").alias("page_id"), F.col("row").alias("pos"), "source_notice_id", "title")


@query("page_article")
def _(spark, sf):
    out = pg.articles_from_pages(raw_pages(spark, sf).select("page_id", "origin", "html"), MARKUP)
    return out.select(
        "page_id", "title", F.sha2("raw_html", 256).alias("raw_hash"), F.sha2("original_content", 256).alias("text_hash"),
        F.length("original_content").alias("chars"), F.size("attachments").alias("n_attachments"),
    )


TEXT_SQL = r"""html_text AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'),
     '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', '', 'g'), '(?i)</(p|div|li|tr|h[1-6])\s*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages)"""


@query(
    "html_to_text",
    ctes(TEXT_SQL)
    + f"""SELECT page_id, sha256(array_to_string(list_filter(list_transform(string_split(replace(t, chr(160), ' '), chr(10)),
  lambda l: regexp_replace(regexp_replace(l, '[ \\t]+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')), lambda l: l <> ''), chr(10))) AS body FROM html_text""",
)
def _(spark, sf):
    return ad.table(spark, sf, "pages").select("page_id", F.sha2(texts.html_to_text(F.col("html")), 256).alias("body"))


@query(
    "page_meta_map",
    rf"""SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, url, trim(regexp_replace({UNESCAPE.format("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")}, '{WS}+', ' ', 'g')) AS title FROM pages""",
)
def _(spark, sf):
    """Each page's language, address and title as an article head, one key stated twice."""
    h1 = F.regexp_extract("html", "(?is)<h1>(.*?)</h1>", 1)
    lang = F.regexp_extract("html", 'lang="([a-z]+)"', 1)

    def dl(key: str, value):
        return F.concat(F.lit(f"<dl class='x'><dt> {key} </dt>\n<dd>"), value, F.lit("</dd></dl>"))

    head = F.concat(dl("제목", F.lit("old")), dl("언어", lang), dl("주소", F.replace("url", F.lit("&"), F.lit("&amp;"))), dl("제목", F.concat(F.lit("<b>"), h1, F.lit("</b>"))))
    rows = ad.table(spark, sf, "pages").select("page_id", pg.metadata_map(head).alias("m"))
    return rows.select("page_id", F.col("m")["언어"].alias("lang"), F.col("m")["주소"].alias("url"), F.col("m")["제목"].alias("title"))


@query(
    "page_attachments",
    ctes(NAV)
    + f"""SELECT page_id, 'file' AS kind, trim(regexp_replace({UNESCAPE.format('label')}, '{WS}+', ' ', 'g')) AS name,
  origin || array_to_string(list_transform(string_split({UNESCAPE.format('href')}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x00-\\x7F]') THEN url_encode(c) ELSE c END), '') AS url
FROM anchors
UNION ALL
SELECT page_id, 'image', 'poster ' || page_id || '+1.png', 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) || '/files/poster%20' || page_id || '+1.png' FROM pages""",
)
def _(spark, sf):
    """Links of every page as download links, and one poster put into every body."""
    body = F.concat(F.lit('<p><img alt="" src="/files/poster%20'), F.col("page_id").cast("string"), F.lit('+1.png"></p>'))
    rows = raw_pages(spark, sf)
    return rows.select("page_id", F.inline(pg.attachments(F.col("html"), body, F.col("origin"), "/")))


@query(
    "quality_gate",
    ctes(ad.NOTICE_DOCS)
    + """SELECT id, CASE WHEN trim(title) = '' OR id % 31 = 0 THEN 'structure' WHEN length(original_content) < 30 THEN 'empty_content' ELSE '-' END AS error_class,
  CASE WHEN trim(title) = '' OR id % 31 = 0 THEN 'page structure not recognized (title=' || (trim(title) <> '') || ', body=' || (id % 31 <> 0) || ')'
       WHEN length(original_content) < 30 THEN 'body has only ' || length(original_content) || ' chars of text' ||
         CASE WHEN id % 3 > 0 THEN ' (content is probably in ' || (id % 3) || ' image/file attachment(s))' ELSE '' END ELSE '-' END AS error FROM notice_docs""",
)
def _(spark, sf):
    docs = ad.notice_docs(spark, sf).withColumns({
        "title": F.trim("title"), "raw_html": F.when(F.col("id") % 31 != 0, F.col("original_content")), "n_attachments": F.col("id") % 3,
    })
    out = pg.quality_gate(docs)
    return out.select("id", F.coalesce("error_class", F.lit("-")).alias("error_class"), F.coalesce("error", F.lit("-")).alias("error"))


CANON = r"""canon AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '^http:', 'https:'), '[?#].*$', '') AS c FROM pages),
parsed AS (SELECT *, regexp_extract(c, '^(https://[^/]+/)[a-z]{2}/([0-9]+)(/|\.html)?$', 1) AS prefix, regexp_extract(c, '^(https://[^/]+/)[a-z]{2}/([0-9]+)(/|\.html)?$', 2) AS article FROM canon)"""


@query(
    "url_canonical",
    ctes(CANON) + "SELECT page_id, c AS canonical_url, CASE WHEN article = '' THEN '-' ELSE article END AS article_id FROM parsed",
)
def _(spark, sf):
    out = pg.parse_article_url(ad.table(spark, sf, "pages"), "url", URL)
    return out.select("page_id", "canonical_url", F.coalesce("article_id", F.lit("-")).alias("article_id"))


@query(
    "url_route",
    ctes(CANON, """sites AS (SELECT prefix, min(page_id) AS ord FROM parsed WHERE prefix <> '' GROUP BY prefix HAVING count(*) > 1)""")
    + """SELECT page_id, 'site' || coalesce(s.ord, (SELECT min(ord) FROM sites)) AS source FROM parsed LEFT JOIN sites s USING (prefix)""",
)
def _(spark, sf):
    """Sites with more than one page are the boards; other pages fall to the first board."""
    parsed = pg.parse_article_url(ad.table(spark, sf, "pages").select("page_id", "url"), "url", URL)
    boards = parsed.filter("board_prefix is not null").groupBy(F.col("board_prefix").alias("url_prefix")).agg(
        F.min("page_id").alias("ord"), F.count("*").alias("n")).filter("n > 1")
    boards = boards.withColumn("source", F.concat(F.lit("site"), F.col("ord").cast("string")))
    return pg.route_urls(parsed, boards).select("page_id", "source")


@query(
    "export_json",
    ctes(*store.LIST)
    + """SELECT id, to_json({'id': id, 'title': title, 'status': status, 'boards': string_split(boards, ','), 'due': coalesce(deadline, application_end)}) AS json FROM items""",
)
def _(spark, sf):
    items = store.doc_items(spark, sf).select("id", "title", "status", "boards", F.coalesce("deadline", "application_end").alias("due"))
    return export.as_json(items, "id")


@query("export_snapshot", store.DETAIL_SQL)
def _(spark, sf):
    """Writes the whole snapshot and reads the details back."""
    path = scratch_dir(spark, "snapshot")
    notices = ad.keyed_docs(spark, sf)
    # groups and choices are kept without texts, for the list and the details
    with shuffles_freed(spark), kept(assign_canonical(notices), "assigned") as assigned:
        choice = store.latest_docs(spark, sf, assigned).select(*CHOICE, *store.ANALYSIS_COLS)
        with kept(choice, "choice") as rows:
            details = detail_by_copy(rows, rows.select("id"), store.ANALYSIS_COLS, notices, assigned)
            items = store.doc_items(spark, sf, rows, ad.grouped_docs(spark, sf, assigned.filter("dup_of IS NULL")))
            meta = items.agg(F.count("*").alias("notices"), F.max("crawled_at").alias("last_checked_at"))
            export.export_snapshot(items, details, meta, path)
    return store.detail_columns(spark.read.schema(details.schema).json(f"{path}/details"))
