"""Queries over stored notices: change capture, grouping, read views, decisions and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import text
from noticelake.operators import cdc, facets, listing, match, notice_store, resolve, runs, views
from noticelake.plans import adapters as ad
from noticelake.plans import registry
from noticelake.plans.adapters import ctes
from noticelake.plans.registry import query
from noticelake.session import scratch_dir

DOCS = ad.NOTICE_DOCS
GROUPED = (ad.NOTICE_DOCS, ad.DOC_KEYS, ad.DOC_GROUPS)
LATEST = (*GROUPED, ad.ANALYSIS_DOCS, ad.DOC_LATEST)
ANALYSIS_COLS = ["category", "prompt_version", "deadline", "application_end", "event_date"]


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def latest_docs(spark: SparkSession, sf: str, assigned: DataFrame | None = None) -> DataFrame:
    return views.with_latest_analysis(ad.grouped_docs(spark, sf, assigned), ad.analysis_docs(spark, sf), ANALYSIS_COLS)


def doc_items(spark: SparkSession, sf: str, rows: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
    return views.canonical_list(latest_docs(spark, sf) if rows is None else rows, ANALYSIS_COLS, heads=heads)


# The list view as SQL: the chosen copy by ladder, then the canonical row with that copy's analysis.
ITEMS = """ladder AS (
  SELECT group_id, id AS shown_id, status, row_number() OVER (PARTITION BY group_id ORDER BY
           CASE WHEN id = group_id AND status = 'ready' THEN 0 WHEN status = 'ready' THEN 1
                WHEN id = group_id AND status = 'stale' THEN 2 WHEN status = 'stale' THEN 3
                WHEN id = group_id THEN 4 ELSE 5 END, published_at DESC, id DESC) AS rn
  FROM latest),
group_sizes AS (SELECT group_id, count(*) AS n_copies, array_to_string(list_sort(list_distinct(list(source))), ',') AS boards
                FROM latest GROUP BY group_id),
items AS (
  SELECT c.id, c.group_id, c.title, c.source, c.published_at, l.shown_id, l.status, s.n_copies, s.boards,
         a.category, a.deadline, a.application_end, a.event_date
  FROM latest c JOIN ladder l ON l.group_id = c.id AND l.rn = 1 JOIN group_sizes s ON s.group_id = c.id
  LEFT JOIN latest a ON a.id = l.shown_id
  WHERE c.dup_of IS NULL)"""
LIST = (*LATEST, ITEMS)


@query("content_hash", ctes(DOCS) + "SELECT id, content_hash FROM notice_docs")
def _(spark, sf):
    return ad.notice_docs(spark, sf).select("id", "content_hash")


@query("dedup_key", ctes(DOCS, ad.DOC_KEYS) + "SELECT id, coalesce(dedup_key, '-') AS dedup_key FROM keyed")
def _(spark, sf):
    return ad.keyed_docs(spark, sf).select("id", F.coalesce("dedup_key", F.lit("-")).alias("dedup_key"))


@query(
    "same_pairs",
    ctes(DOCS, ad.DOC_KEYS, ad.DOC_GROUPS)
    + """SELECT k.id, count(p.other) AS n_partners, coalesce(min(p.other), -1) AS lowest_partner
FROM keyed k LEFT JOIN pairs p USING (id) GROUP BY k.id""",
)
def _(spark, sf):
    out = resolve.same_notice_partners(ad.keyed_docs(spark, sf))
    return out.select("id", "n_partners", F.coalesce("lowest_partner", F.lit(-1)).alias("lowest_partner"))


@query("canonical_groups", ctes(*GROUPED) + "SELECT id, group_id FROM grouped")
def _(spark, sf):
    out = resolve.assign_canonical(ad.keyed_docs(spark, sf))
    return out.select("id", F.coalesce("dup_of", "id").alias("group_id"))


# Edits one after the other in id order, as the store would see them. What a row meets at its turn is stated row by row;
# where it goes depends on the edits before it, which the recursion keeps in a map.
EDITED = r"""old_keys AS (
  SELECT id, source, published_at, title,
         CASE WHEN length(core) >= 6 THEN CASE WHEN grad THEN 'grad:' || core ELSE core END END AS dedup_key
  FROM (SELECT *, regexp_replace(lower(substr(title, length(tags) + 1)), '[^\p{L}\p{N}]', '', 'g') AS core,
               len(list_filter(regexp_extract_all(tags, '(\[[^\]]*\]|\([^)]*\)|【[^】]*】|<[^>]*>|★+|☆+)', 1),
                               lambda t: contains(t, '대학원') AND NOT contains(t, '학부'))) > 0 AS grad
        FROM (SELECT *, regexp_extract(title, '^(\s*(\[[^\]]*\]|\([^)]*\)|【[^】]*】|<[^>]*>|★+|☆+)\s*)+', 0) AS tags
              FROM notice_prev))),
old_parents AS (
  SELECT a.id, min(b.id) AS parent FROM old_keys a JOIN old_keys b
    ON a.dedup_key = b.dedup_key AND a.source <> b.source AND abs(a.published_at - b.published_at) <= 3 AND b.id < a.id
  GROUP BY a.id),
old_climb AS (
  SELECT id, parent AS root FROM old_parents
  UNION ALL
  SELECT c.id, p.parent FROM old_climb c JOIN old_parents p ON c.root = p.id),
old_roots AS (SELECT id, min(root) AS dup_of FROM old_climb GROUP BY id),
old_store AS (SELECT k.*, r.dup_of FROM old_keys k LEFT JOIN old_roots r USING (id)),
edits AS (
  SELECT o.id, o.source, o.published_at, o.dedup_key AS old_key, k.dedup_key AS new_key, o.dup_of, row_number() OVER (ORDER BY o.id) AS turn
  FROM old_store o JOIN keyed k USING (id) JOIN notice_docs n USING (id) WHERE o.title <> n.title),
facing AS (
  SELECT e.turn, o.id, CASE WHEN q.id IS NULL OR q.id > e.id THEN o.dedup_key ELSE q.new_key END AS key_then,
         o.source, o.published_at, o.dup_of, q.id < e.id AS moved_before
  FROM edits e JOIN old_store o ON o.id <> e.id AND o.source <> e.source AND abs(o.published_at - e.published_at) <= 3
  LEFT JOIN edits q ON q.id = o.id
  WHERE e.new_key = CASE WHEN q.id IS NULL OR q.id > e.id THEN o.dedup_key ELSE q.new_key END),
hits AS (SELECT turn, min(id) AS hit, arg_min(dup_of, id) AS hit_dup, arg_min(dup_of IS NULL, id) AS hit_root, arg_min(coalesce(moved_before, FALSE), id) AS moved FROM facing GROUP BY turn),
copies AS (SELECT e.turn, count(*) AS n FROM edits e JOIN old_store o ON o.dup_of = e.id LEFT JOIN edits q ON q.id = o.id WHERE q.id IS NULL OR q.id > e.id GROUP BY e.turn),
turns AS (
  SELECT e.turn, e.id, e.dup_of, h.hit, CASE WHEN h.hit_root THEN NULL ELSE h.hit_dup END AS hit_dup, coalesce(h.moved, FALSE) AS moved, coalesce(c.n, 0) > 0 AS has_copies
  FROM edits e LEFT JOIN hits h USING (turn) LEFT JOIN copies c USING (turn)),
sim(turn, place) AS (
  SELECT CAST(0 AS BIGINT), MAP {CAST(-1 AS BIGINT): CAST(-1 AS BIGINT)}
  UNION ALL
  SELECT t.turn, map_concat(s.place, MAP {t.id: CASE
      WHEN t.has_copies OR list_contains(map_values(s.place), t.id) THEN coalesce(t.dup_of, -1)
      WHEN t.hit IS NULL THEN -1
      WHEN t.moved THEN CASE WHEN s.place[t.hit] >= 0 THEN s.place[t.hit] ELSE t.hit END
      ELSE coalesce(t.hit_dup, t.hit) END})
  FROM sim s JOIN turns t ON t.turn = s.turn + 1),
moves AS (
  SELECT t.id, t.dup_of AS old_dup_of, nullif(f.place[t.id], -1) AS new_dup_of
  FROM turns t, (SELECT place FROM sim ORDER BY turn DESC LIMIT 1) f)"""
EDITS = (ad.NOTICE_DOCS, ad.NOTICE_PREV, ad.DOC_KEYS, EDITED)


@query("regroup_changed", ctes(*EDITS) + "SELECT id, coalesce(old_dup_of, id) AS old_group, coalesce(new_dup_of, id) AS new_group FROM moves")
def _(spark, sf):
    """Every notice whose title was edited since the last crawl, grouped again with its new key."""
    old = ad.notice_prev(spark, sf).drop("dup_of")
    store = old.withColumn("dedup_key", text.dedup_key(F.col("title")))
    store = store.join(resolve.assign_canonical(store), "id")
    now = ad.keyed_docs(spark, sf).select("id", F.col("title").alias("new_title"), F.col("dedup_key").alias("new_key"))
    changed = store.select("id", "title").join(now, "id").filter(F.col("title") != F.col("new_title"))
    out = resolve.reassign_changed(store, changed.select("id", "new_key"))
    return out.select("id", F.coalesce("old_dup_of", "id").alias("old_group"), F.coalesce("new_dup_of", "id").alias("new_group"))


@query(
    "orphan_groups",
    ctes(*GROUPED)
    + """, kept AS (SELECT * FROM grouped WHERE published_at >= DATE '2026-09-02')
SELECT k.id, CASE WHEN k.dup_of IS NOT NULL AND p.id IS NULL THEN k.id ELSE coalesce(k.dup_of, k.id) END AS group_id,
       k.dup_of IS NOT NULL AND p.id IS NULL AS is_orphan
FROM kept k LEFT JOIN kept p ON p.id = k.dup_of""",
)
def _(spark, sf):
    """Notices older than the retention day are gone, so some copies lost their canonical row."""
    kept = ad.grouped_docs(spark, sf).drop("group_id").filter("published_at >= DATE '2026-09-02'")
    return resolve.orphan_groups(kept).select("id", "group_id", "is_orphan")


@query(
    "latest_analysis",
    ctes(*LATEST) + "SELECT id, status, coalesce(category, '-') AS category, coalesce(analysis_id, -1) AS analysis_id FROM latest",
)
def _(spark, sf):
    out = views.with_latest_analysis(ad.notice_docs(spark, sf), ad.analysis_docs(spark, sf), ["category"])
    return out.select(
        "id", "status", F.coalesce("category", F.lit("-")).alias("category"),
        F.coalesce("analysis_id", F.lit(-1)).alias("analysis_id"),
    )


@query(
    "canonical_list",
    ctes(*LIST)
    + """SELECT id, title, source, strftime(published_at, '%Y-%m-%d') AS published_at, boards, n_copies, status,
       coalesce(category, 'pending') AS category, coalesce(deadline, application_end, '-') AS due,
       shown_id FROM items ORDER BY published_at DESC, id DESC""",
)
def canonical_list_query(spark, sf):
    out = doc_items(spark, sf).orderBy(F.desc("published_at"), F.desc("id"))
    return out.select(
        "id", "title", "source", _day("published_at"), F.array_join("boards", ",").alias("boards"), "n_copies", "status",
        facets.category_or_pending(F.col("category")).alias("category"),
        F.coalesce("deadline", "application_end", F.lit("-")).alias("due"), "shown_id",
    )


@query(
    "canonical_sources",
    ctes(*GROUPED, ad.BOARD_DIM)
    + """SELECT g.group_id, b.ord AS source_ord, g.id, g.source, b.kind, g.source_url FROM grouped g JOIN board_dim b USING (source)""",
)
def _(spark, sf):
    return views.group_sources(ad.grouped_docs(spark, sf), ad.board_dim(spark, sf)).drop("published_at")


DETAIL_SQL = (
    ctes(*LATEST)
    + """, ladder AS (
  SELECT group_id, id AS shown_id, status, row_number() OVER (PARTITION BY group_id ORDER BY
           CASE WHEN id = group_id AND status = 'ready' THEN 0 WHEN status = 'ready' THEN 1
                WHEN id = group_id AND status = 'stale' THEN 2 WHEN status = 'stale' THEN 3
                WHEN id = group_id THEN 4 ELSE 5 END, id) AS rn FROM latest)
SELECT q.id AS asked_id, c.id AS canonical_id, c.title, sha256(c.original_content) AS body_hash, l.status, l.shown_id,
       coalesce(a.category, '-') AS category
FROM latest q JOIN latest c ON c.id = q.group_id JOIN ladder l ON l.group_id = c.id AND l.rn = 1
LEFT JOIN latest a ON a.id = l.shown_id"""
)


def detail_columns(details: DataFrame) -> DataFrame:
    return details.select(
        "asked_id", "canonical_id", "title", F.sha2("original_content", 256).alias("body_hash"), "status", "shown_id",
        F.coalesce("category", F.lit("-")).alias("category"),
    )


@query("detail_by_copy", DETAIL_SQL)
def _(spark, sf):
    rows = latest_docs(spark, sf)
    return detail_columns(views.detail_by_copy(rows, ad.notice_docs(spark, sf).select("id"), ANALYSIS_COLS))


CURRENT = """cur AS (
  SELECT DISTINCT n.id, n.group_id, a.prompt_version FROM grouped n JOIN analysis_docs a
    ON a.notice_id = n.id AND a.content_hash = n.content_hash),
group_cur AS (SELECT group_id, min(struct_pack(c := id <> group_id, i := id)).i AS current_id FROM cur GROUP BY group_id),
group_v3 AS (SELECT DISTINCT group_id FROM cur WHERE prompt_version = 'v3')"""


@query(
    "group_current",
    ctes(*GROUPED, ad.ANALYSIS_DOCS, CURRENT)
    + """SELECT g.group_id, g.current_id, v.group_id IS NOT NULL AS from_present_version
FROM group_cur g LEFT JOIN group_v3 v USING (group_id)""",
)
def _(spark, sf):
    notices, analysis = ad.grouped_docs(spark, sf), ad.analysis_docs(spark, sf)
    v3 = views.group_current(notices, analysis, "v3").select("group_id", F.lit(True).alias("v3"))
    out = views.group_current(notices, analysis).join(v3, "group_id", "left")
    return out.select("group_id", "current_id", F.col("v3").isNotNull().alias("from_present_version"))


STATE = """group_dates AS (
  SELECT group_id, arg_max(array_to_string(list_filter([deadline, application_end, event_date], lambda d: d IS NOT NULL), ','), analysis_id) AS dates
  FROM analysis_docs a JOIN grouped n ON n.id = a.notice_id GROUP BY group_id),
state AS (
  SELECT n.source_url, n.id AS stored_id, n.published_at, coalesce(d.dates, '') AS dates
  FROM grouped n LEFT JOIN group_dates d USING (group_id))"""


@query(
    "stored_state",
    ctes(*GROUPED, ad.ANALYSIS_DOCS, STATE)
    + "SELECT source_url, stored_id, strftime(published_at, '%Y-%m-%d') AS published_at, dates FROM state",
)
def _(spark, sf):
    out = views.stored_state(ad.grouped_docs(spark, sf), ad.analysis_docs(spark, sf))
    return out.select("source_url", "stored_id", _day("published_at"), F.array_join("dates", ",").alias("dates"))


@query(
    "fetch_reason",
    ctes(*GROUPED, ad.ANALYSIS_DOCS, STATE)
    + """SELECT n.source_url, coalesce(CASE WHEN s.stored_id IS NULL THEN 'new'
       WHEN abs(s.published_at - DATE '2026-09-12') <= 7 THEN 'recent'
       WHEN len(list_filter(string_split(s.dates, ','), lambda d: substr(d, 1, 10) >= '2026-09-12')) > 0 THEN 'upcoming' END, '-') AS reason
FROM notice_docs n LEFT JOIN state s ON s.source_url = n.source_url AND s.published_at < DATE '2026-09-07'""",
)
def _(spark, sf):
    from datetime import date

    stored = views.stored_state(ad.grouped_docs(spark, sf), ad.analysis_docs(spark, sf))
    listed = ad.notice_docs(spark, sf).select("source_url", F.col("published_at").alias("listed_date"))
    out = listing.fetch_reason(listed, stored.filter(F.col("published_at") < F.lit(ad.PREV_DAY)), date(2026, 9, 12))
    return out.select("source_url", F.coalesce("reason", F.lit("-")).alias("reason"))


# --- change capture ---------------------------------------------------------------------------------

PREV = (ad.NOTICE_DOCS, ad.NOTICE_PREV)
CLASSIFIED = """classified AS (
  SELECT n.id, n.source, n.source_notice_id, p.id AS stored_id,
         CASE WHEN p.id IS NULL THEN 'new' WHEN n.content_hash <> p.content_hash OR n.title <> p.title THEN 'updated'
              ELSE 'unchanged' END AS status,
         concat_ws(',', CASE WHEN n.content_hash <> p.content_hash THEN 'content' END, CASE WHEN n.title <> p.title THEN 'title' END) AS changed
  FROM notice_docs n LEFT JOIN notice_prev p USING (source, source_notice_id))"""


@query(
    "upsert_classify",
    ctes(*PREV, CLASSIFIED) + "SELECT source, source_notice_id, coalesce(stored_id, -1) AS stored_id, status, changed FROM classified",
)
def _(spark, sf):
    out = cdc.classify_upsert(ad.notice_docs(spark, sf), ad.notice_prev(spark, sf))
    return out.select(
        "source", "source_notice_id", F.coalesce("stored_id", F.lit(-1)).alias("stored_id"), "status",
        F.array_join("changed", ",").alias("changed"),
    )


@query(
    "upsert_apply",
    ctes(*PREV, CLASSIFIED)
    + """, fresh AS (
  SELECT n.*, (SELECT max(id) FROM notice_prev) + row_number() OVER (ORDER BY n.source, n.source_notice_id) AS new_id
  FROM notice_docs n JOIN classified c USING (id) WHERE c.status = 'new')
SELECT p.id, p.source, p.source_notice_id, CASE WHEN c.status = 'updated' THEN n.title ELSE p.title END AS title,
       CASE WHEN c.status = 'updated' THEN n.content_hash ELSE p.content_hash END AS content_hash,
       CASE WHEN c.stored_id IS NOT NULL THEN '2026-09-08' ELSE '2026-09-07' END AS crawled,
       CASE WHEN c.status = 'updated' THEN '2026-09-08' ELSE '-' END AS updated
FROM notice_prev p LEFT JOIN classified c ON c.stored_id = p.id LEFT JOIN notice_docs n ON n.id = c.id
UNION ALL
SELECT new_id, source, source_notice_id, title, content_hash, '2026-09-08', '-' FROM fresh""",
)
def _(spark, sf):
    out = cdc.apply_upsert(ad.notice_docs(spark, sf), ad.notice_prev(spark, sf), [F.col("source"), F.col("source_notice_id")])
    return out.select(
        "id", "source", "source_notice_id", "title", "content_hash",
        F.date_format("crawled_at", "yyyy-MM-dd").alias("crawled"),
        F.coalesce(F.date_format("content_updated_at", "yyyy-MM-dd"), F.lit("-")).alias("updated"),
    )


def prepared_store(spark: SparkSession, sf: str, grouped: bool) -> notice_store.NoticeStore:
    """The stored notices before the crawl, in buckets."""
    prev = ad.notice_prev(spark, sf)
    store = notice_store.NoticeStore(spark, scratch_dir(spark, "notices"), prev.schema, grouped, buckets=16)
    store.seed(prev)
    return store


@query("upsert_store", registry.ORACLE["upsert_apply"])
def _(spark, sf):
    """The same change, applied to a store in buckets: only buckets of changed and new notices get files."""
    store = prepared_store(spark, sf, False)
    notice_store.upsert(store, ad.notice_docs(spark, sf), ["source", "source_notice_id"])
    return store.snapshot().select(
        "id", "source", "source_notice_id", "title", "content_hash", F.date_format("crawled_at", "yyyy-MM-dd").alias("crawled"),
        F.coalesce(F.date_format("content_updated_at", "yyyy-MM-dd"), F.lit("-")).alias("updated"),
    )


# New rows come after the edits, in the order of their ids, and join the lowest id that they meet.
GROUPED_UPSERT = """settled AS (
  SELECT o.id, o.source, o.published_at, coalesce(CASE WHEN m.id IS NOT NULL THEN k.dedup_key END, CASE WHEN m.id IS NULL THEN o.dedup_key END) AS dedup_key,
         CASE WHEN m.id IS NOT NULL THEN m.new_dup_of ELSE o.dup_of END AS dup_of
  FROM old_store o JOIN keyed k USING (id) LEFT JOIN moves m USING (id)),
fresh_rows AS (
  SELECT (SELECT max(id) FROM notice_prev) + row_number() OVER (ORDER BY n.source, n.source_notice_id) AS id, n.source, n.source_notice_id, n.title, n.published_at, k.dedup_key
  FROM notice_docs n JOIN keyed k USING (id) WHERE n.id NOT IN (SELECT id FROM notice_prev)),
everything AS (SELECT id, source, published_at, dedup_key FROM settled UNION ALL SELECT id, source, published_at, dedup_key FROM fresh_rows),
fresh_parents AS (
  SELECT a.id, min(b.id) AS parent FROM fresh_rows a JOIN everything b
    ON a.dedup_key = b.dedup_key AND a.source <> b.source AND abs(a.published_at - b.published_at) <= 3 AND b.id < a.id
  GROUP BY a.id),
fresh_climb AS (
  SELECT id, parent AS root FROM fresh_parents
  UNION ALL
  SELECT c.id, p.parent FROM fresh_climb c JOIN fresh_parents p ON c.root = p.id),
fresh_roots AS (SELECT c.id, min(c.root) AS root FROM fresh_climb c GROUP BY c.id)"""


@query(
    "upsert_grouped",
    ctes(*EDITS, CLASSIFIED, GROUPED_UPSERT)
    + """SELECT s.id, s.source, n.source_notice_id, n.title, coalesce(s.dup_of, s.id) AS group_id, '2026-09-08' AS crawled
FROM settled s JOIN notice_docs n USING (id)
UNION ALL
SELECT f.id, f.source, f.source_notice_id, f.title, coalesce(s.dup_of, r.root, f.id), '2026-09-08'
FROM fresh_rows f LEFT JOIN fresh_roots r USING (id) LEFT JOIN settled s ON s.id = r.root""",
)
def _(spark, sf):
    """A crawl applied to the store with its groups: edited titles are placed again, new posts join what is stored."""
    store = prepared_store(spark, sf, True)
    notice_store.upsert(store, ad.notice_docs(spark, sf), ["source", "source_notice_id"])
    return store.snapshot().select(
        "id", "source", "source_notice_id", "title", F.coalesce("dup_of", "id").alias("group_id"), F.date_format("crawled_at", "yyyy-MM-dd").alias("crawled"))


@query(
    "insert_if_absent",
    ctes(*PREV)
    + """SELECT n.source_notice_id, CASE WHEN p.id IS NULL THEN 'inserted' ELSE 'already stored' END AS outcome,
       coalesce(p.id, -1) AS existing_id, coalesce(n.content_hash <> p.content_hash, FALSE) AS content_changed
FROM notice_docs n LEFT JOIN notice_prev p USING (source, source_notice_id)""",
)
def _(spark, sf):
    inserts, report = cdc.insert_if_absent(ad.notice_docs(spark, sf), ad.notice_prev(spark, sf))
    new = inserts.select(
        "source_notice_id", F.lit("inserted").alias("outcome"), F.lit(-1).cast("long").alias("existing_id"),
        F.lit(False).alias("content_changed"),
    )
    old = report.select("source_notice_id", F.lit("already stored").alias("outcome"), "existing_id", "content_changed")
    return new.unionByName(old)


@query(
    "schema_backfill",
    ctes(DOCS, ad.DOC_KEYS, ad.ANALYSIS_DOCS)
    + """SELECT a.analysis_id, 'unknown' AS provider, CASE WHEN a.prompt_version = 'v2' THEN n.content_hash ELSE a.content_hash END AS content_hash,
       coalesce(k.dedup_key, '-') AS dedup_key
FROM analysis_docs a JOIN notice_docs n ON n.id = a.notice_id JOIN keyed k ON k.id = n.id""",
)
def _(spark, sf):
    """Analyses written before hashes were kept (old prompt version) and before providers were named."""
    old = ad.analysis_docs(spark, sf)
    old = old.withColumn("content_hash", F.when(F.col("prompt_version") != "v2", F.col("content_hash")))
    filled = cdc.backfill_analysis(old, ad.notice_docs(spark, sf))
    notices = cdc.evolve_schema(
        ad.notice_docs(spark, sf), {"dedup_key": "string"}, {"dedup_key": text.dedup_key(F.col("title"))}
    )
    keys = notices.select(F.col("id").alias("notice_id"), F.coalesce("dedup_key", F.lit("-")).alias("dedup_key"))
    return filled.join(keys, "notice_id").select("analysis_id", "provider", "content_hash", "dedup_key")


@query(
    "source_checks",
    """SELECT 'src' || (user_id % 20) AS source, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS checked_at FROM events GROUP BY 1""",
)
def _(spark, sf):
    out = cdc.last_checks(check_log(spark, sf))
    return out.select("source", F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss").alias("checked_at"))


def check_log(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"),
        F.col("ts").cast("timestamp").alias("checked_at"), F.col("event_id").alias("seq"),
    )


@query(
    "append_analysis",
    ctes(DOCS, ad.ANALYSIS_DOCS)
    + """SELECT n.id AS notice_id, (SELECT max(analysis_id) FROM analysis_docs) + row_number() OVER (ORDER BY n.source, n.id) AS analysis_id, n.content_hash
FROM notice_docs n WHERE n.id NOT IN (SELECT notice_id FROM analysis_docs)""",
)
def _(spark, sf):
    """A first analysis for every notice that has none yet, with ids in processing order."""
    history = ad.analysis_docs(spark, sf)
    done = history.select(F.col("notice_id").alias("id"))
    todo = ad.notice_docs(spark, sf).join(done, "id", "left_anti").select(F.col("id").alias("notice_id"), "source", "content_hash")
    out = cdc.append_analysis(history, todo, [F.col("source"), F.col("notice_id")])
    return out.select("notice_id", "analysis_id", "content_hash")


# --- board lists --------------------------------------------------------------------------------------

UNIQUE = """uniq AS (
  SELECT source, source_notice_id, min(pos) AS pos, bool_and(pinned) AS pinned, arg_min(listed_date, pos) AS listed_date
  FROM listed GROUP BY source, source_notice_id)"""


@query(
    "unique_listed",
    ctes(ad.LISTED, UNIQUE) + "SELECT source, source_notice_id, pos, pinned, strftime(listed_date, '%Y-%m-%d') AS listed_date FROM uniq",
)
def _(spark, sf):
    return listing.unique_listed(ad.listed_rows(spark, sf)).withColumn("listed_date", _day("listed_date"))


@query(
    "limit_regular",
    ctes(ad.LISTED, UNIQUE)
    + """SELECT source, source_notice_id, pos, pinned FROM (
  SELECT *, sum(CASE WHEN pinned THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY pos) AS n FROM uniq)
WHERE pinned OR n <= 25""",
)
def _(spark, sf):
    out = listing.limit_regular(listing.unique_listed(ad.listed_rows(spark, sf)), 25)
    return out.select("source", "source_notice_id", "pos", "pinned")


@query(
    "limit_per_source",
    ctes(ad.LISTED, UNIQUE)
    + """SELECT source, source_notice_id, pos, pinned FROM (
  SELECT *, sum(CASE WHEN pinned THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY pos) AS n FROM uniq)
WHERE pinned OR source = 'src0' OR n <= 10""",
)
def _(spark, sf):
    dim = ad.board_dim(spark, sf).select("source", "default_limit").collect()  # one row per board
    limits = {r["source"]: r["default_limit"] for r in dim}
    out = listing.limit_per_source(listing.unique_listed(ad.listed_rows(spark, sf)), limits)
    return out.select("source", "source_notice_id", "pos", "pinned")


@query(
    "source_select",
    ctes(DOCS, ad.BOARD_DIM)
    + """SELECT n.id, n.source, b.ord FROM notice_docs n JOIN board_dim b USING (source)
WHERE b.alias IN ('b3', 'b12') OR b.source IN ('src7')""",
)
def _(spark, sf):
    rows = ad.notice_docs(spark, sf).select("id", "source")
    return listing.select_sources(rows, ad.board_dim(spark, sf), "b3, src7,b12")


# --- run decisions --------------------------------------------------------------------------------------

PROCESSED = """processed AS (
  SELECT g.id, g.group_id, g.source, CAST(substr(g.source, 4) AS INTEGER) AS source_ord,
         CASE WHEN c.status = 'unchanged' AND g.published_at < DATE '2026-09-03' THEN 'known' ELSE c.status END AS status
  FROM grouped g JOIN classified c USING (id)),
firsts AS (SELECT group_id, min(struct_pack(o := source_ord, i := id)).i AS first_id FROM processed GROUP BY group_id),
decided AS (
  SELECT p.*, g.current_id, CASE WHEN g.current_id IS NOT NULL AND v.group_id IS NULL THEN TRUE ELSE FALSE END AS up, f.first_id,
    CASE WHEN g.current_id IS NOT NULL AND v.group_id IS NOT NULL THEN
           CASE WHEN p.status = 'known' THEN 'known-skip' WHEN g.current_id <> p.id THEN 'duplicate-skip' ELSE 'current-skip' END
         WHEN f.first_id <> p.id THEN 'duplicate-skip' ELSE 'analyse' END AS decision
  FROM processed p LEFT JOIN group_cur g USING (group_id) LEFT JOIN group_v3 v USING (group_id) JOIN firsts f USING (group_id)),
flagged AS (
  SELECT *, CASE WHEN decision IN ('known-skip', 'current-skip') THEN 'analysis is current'
              WHEN decision = 'duplicate-skip' THEN 'same notice is analysed once'
              WHEN up THEN 'upgrade' WHEN status IN ('unchanged', 'known') THEN 'pending' ELSE status END AS reason,
         decision IN ('known-skip', 'duplicate-skip') AND coalesce(current_id, -1) <> id AS is_duplicate
  FROM decided)"""
DECIDED = (*GROUPED, ad.NOTICE_PREV, CLASSIFIED, ad.ANALYSIS_DOCS, CURRENT, PROCESSED)


def decided_docs(spark: SparkSession, sf: str) -> DataFrame:
    notices, analysis = ad.grouped_docs(spark, sf), ad.analysis_docs(spark, sf)
    kinds = cdc.classify_upsert(ad.notice_docs(spark, sf), ad.notice_prev(spark, sf)).select("source", "source_notice_id", "status")
    known = (F.col("status") == "unchanged") & (F.col("published_at") < F.lit("2026-09-03").cast("date"))
    processed = (
        notices.join(kinds, ["source", "source_notice_id"])
        .withColumn("status", F.when(known, "known").otherwise(F.col("status")))
        .select("id", "group_id", "source", F.substring("source", 4, 9).cast("int").alias("source_ord"), "status")
    )
    return runs.work_decision(
        processed, views.group_current(notices, analysis), views.group_current(notices, analysis, "v3"), ["source_ord"], upgrade=True
    )


@query("work_decision", ctes(*DECIDED) + "SELECT id, group_id, status, decision, reason, is_duplicate FROM flagged")
def _(spark, sf):
    return decided_docs(spark, sf).select("id", "group_id", "status", "decision", "reason", "is_duplicate")


BUDGET = """beyond AS (
  SELECT *, CASE WHEN decision = 'analyse' AND row_number() OVER (PARTITION BY decision ORDER BY source_ord, id) > 100
                 THEN 'deferred' ELSE decision END AS own FROM flagged),
late AS (SELECT *, own = 'duplicate-skip' AND group_id IN (SELECT group_id FROM beyond WHERE own = 'deferred') AS is_late FROM beyond),
budgeted AS (SELECT * REPLACE (is_duplicate AND NOT is_late AS is_duplicate), CASE WHEN is_late THEN 'deferred' ELSE own END AS final FROM late)"""


@query("budget_cut", ctes(*DECIDED, BUDGET) + "SELECT id, final AS decision FROM budgeted")
def _(spark, sf):
    return runs.cut_budget(decided_docs(spark, sf), 100, ["source_ord"]).select("id", "decision")


@query(
    "run_stats",
    ctes(*DECIDED, BUDGET)
    + """, outcome AS (SELECT *, CASE WHEN final = 'analyse' THEN CASE WHEN id % 4 = 0 THEN 'failed' ELSE 'success' END END AS result FROM budgeted)
SELECT source, count(*) AS found, count(*) FILTER (id % 17 = 0) AS pinned, count(*) FILTER (status <> 'known') AS fetched,
  count(*) FILTER (status = 'known') AS known, count(*) FILTER (status = 'new') AS new,
  count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'unchanged') AS unchanged,
  count(*) FILTER (status = 'crawl_failed') AS crawl_failed, count(*) FILTER (result = 'success') AS analyzed,
  count(*) FILTER (result = 'failed') AS analysis_failed, count(*) FILTER (final = 'deferred') AS analysis_deferred,
  count(*) FILTER (final IN ('known-skip', 'duplicate-skip', 'current-skip')) AS analysis_skipped,
  count(*) FILTER (is_duplicate) AS duplicates
FROM outcome GROUP BY source""",
)
def _(spark, sf):
    done = runs.cut_budget(decided_docs(spark, sf), 100, ["source_ord"])
    result = F.when(F.col("decision") == "analyse", F.when(F.col("id") % 4 == 0, "failed").otherwise("success"))
    return runs.run_stats(done.withColumns({"pinned": F.col("id") % 17 == 0, "outcome": result}))


STOP = """log AS (
  SELECT user_id AS run, event_id AS pos, CASE event_type WHEN 'error' THEN 'overload' WHEN 'view' THEN 'json_error'
         WHEN 'signup' THEN CASE WHEN value > 90 THEN 'http_429' ELSE 'success' END ELSE 'success' END AS outcome FROM events),
counted AS (SELECT *, lag(outcome, 1) OVER w AS p1, lag(outcome, 2) OVER w AS p2 FROM log
            WHERE outcome IN ('overload', 'success') WINDOW w AS (PARTITION BY run ORDER BY pos)),
stops AS (SELECT run, min(pos) AS stopped_at FROM (
    SELECT run, pos FROM counted WHERE outcome = 'overload' AND p1 = 'overload' AND p2 = 'overload'
    UNION ALL SELECT run, pos FROM log WHERE outcome = 'http_429') GROUP BY run)"""


def outcome_log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = (
        F.when(kind == "error", "overload").when(kind == "view", "json_error")
        .when((kind == "signup") & (F.col("value") > 90), "http_429").otherwise("success")
    )
    return ad.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), outcome.alias("outcome"))


@query(
    "stop_policy",
    ctes(STOP)
    + """SELECT l.run, l.pos, coalesce(s.stopped_at, -1) AS stopped_at, CASE WHEN l.pos > s.stopped_at THEN 'deferred'
  WHEN l.outcome = 'success' THEN 'success' ELSE 'failed' END AS result FROM log l LEFT JOIN stops s USING (run)""",
)
def _(spark, sf):
    out = runs.stop_policy(outcome_log(spark, sf))
    return out.select("run", "pos", F.coalesce("stopped_at", F.lit(-1)).alias("stopped_at"), "result")


# --- counters and filters ---------------------------------------------------------------------------------

@query(
    "store_counts",
    ctes(*GROUPED, ad.ANALYSIS_DOCS)
    + """SELECT (SELECT count(*) FROM grouped) AS notices, (SELECT count(*) FROM analysis_docs) AS analyses,
  count(*) FILTER (ok) AS analyzed_current, count(*) FILTER (NOT ok) AS pending_analysis
FROM (SELECT n.id, n.group_id IN (SELECT m.group_id FROM grouped m JOIN analysis_docs a ON a.notice_id = m.id AND a.content_hash = m.content_hash) AS ok
      FROM grouped n)""",
)
def _(spark, sf):
    return facets.store_counts(ad.grouped_docs(spark, sf), ad.analysis_docs(spark, sf))


@query(
    "category_facets",
    ctes(*LIST)
    + """SELECT 0 AS ord, 'all' AS value, count(*) AS n FROM items
UNION ALL SELECT o, c, count(*) FROM (VALUES (1, 'academic'), (2, 'recruitment'), (3, 'event'), (4, 'other'), (5, 'pending')) t(o, c)
  JOIN items ON coalesce(category, 'pending') = c GROUP BY o, c""",
)
def _(spark, sf):
    return facets.category_facets(doc_items(spark, sf), ad.DOC_CATEGORIES)


PROFILE = {"major": "NATION_7", "college": "REGION_2"}


@query(
    "source_facets",
    ctes(*GROUPED, ad.BOARD_DIM)
    + """, per AS (SELECT b.ord, b.source, b.kind, b.college, b.major, count(DISTINCT g.group_id) AS n
   FROM board_dim b LEFT JOIN grouped g USING (source) GROUP BY ALL)
SELECT 0 AS ord, 'all' AS value, count(DISTINCT group_id) AS n FROM grouped
UNION ALL SELECT 1, 'my-major', n FROM per WHERE kind = 'department' AND major = 'NATION_7'
UNION ALL SELECT 2, 'my-college', coalesce((SELECT n FROM per WHERE kind = 'college' AND college = (SELECT r_name FROM region WHERE r_regionkey = 2) ORDER BY ord LIMIT 1), 0)
UNION ALL SELECT ord + 10, source, n FROM per""",
)
def _(spark, sf):
    region = ad.table(spark, sf, "region").filter("r_regionkey = 2").first()["r_name"]
    profile = {"major": "NATION_7", "college": region}
    return facets.source_facets(ad.grouped_docs(spark, sf), None, ad.board_dim(spark, sf), profile)


@query(
    "headline_counts",
    ctes(*LIST)
    + """SELECT count(*) AS total, count(*) FILTER (status <> 'pending') AS analyzed, count(*) FILTER (status = 'pending') AS pending,
  count(*) FILTER (CAST(coalesce(deadline, application_end) AS DATE) - DATE '2026-09-08' BETWEEN 0 AND 7) AS closing_soon FROM items""",
)
def _(spark, sf):
    return facets.headline_counts(doc_items(spark, sf), ad.TODAY_DOCS)


@query(
    "freshness",
    ctes(ad.BOARD_DIM)
    + """SELECT strftime(min(t), '%Y-%m-%d %H:%M:%S') AS last_checked_at FROM (
  SELECT max(ts) AS t FROM events JOIN board_dim b ON b.source = 'src' || (user_id % 20) GROUP BY b.source)""",
)
def _(spark, sf):
    checks = cdc.last_checks(check_log(spark, sf))
    out = facets.freshness(checks, ad.board_dim(spark, sf), ad.notice_docs(spark, sf))
    return out.select(F.date_format("last_checked_at", "yyyy-MM-dd HH:mm:ss").alias("last_checked_at"))


@query(
    "board_checks",
    ctes(ad.BOARD_DIM)
    + """SELECT b.source, b.ord, coalesce(strftime(c.t, '%Y-%m-%d %H:%M:%S'), '-') AS checked_at FROM board_dim b
LEFT JOIN (SELECT 'src' || (user_id % 20) AS source, arg_max(ts, event_id) AS t FROM events WHERE user_id % 20 <> 3 GROUP BY 1) c USING (source)""",
)
def _(spark, sf):
    """One board, src3, has not been checked yet."""
    checks = cdc.last_checks(check_log(spark, sf).filter("source <> 'src3'"))
    out = facets.board_checks(checks, ad.board_dim(spark, sf))
    return out.select("source", "ord", F.coalesce(F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("checked_at"))


@query(
    "board_units",
    ctes(*GROUPED, ad.BOARD_DIM)
    + """SELECT group_id AS id, coalesce(string_agg(DISTINCT major, '|' ORDER BY major), '') AS majors, coalesce(string_agg(DISTINCT college, '|' ORDER BY college), '') AS colleges
FROM grouped LEFT JOIN board_dim USING (source) GROUP BY group_id""",
)
def _(spark, sf):
    """Majors and colleges of all boards that a notice or a copy of it was posted on."""
    copies = ad.grouped_docs(spark, sf).select(F.col("group_id").alias("id"), "source")
    out = match.board_units(copies, ad.board_dim(spark, sf))
    return out.select("id", F.array_join("b_majors", "|").alias("majors"), F.array_join("b_colleges", "|").alias("colleges"))


@query("category_filter", ctes(*LIST) + "SELECT id, status FROM items WHERE coalesce(category, 'pending') = 'academic'")
def _(spark, sf):
    return facets.filter_category(doc_items(spark, sf), "academic").select("id", "status")


@query(
    "source_filter",
    ctes(*LIST, ad.BOARD_DIM)
    + """SELECT id FROM items WHERE id IN (SELECT group_id FROM grouped JOIN board_dim USING (source) WHERE kind = 'college')""",
)
def _(spark, sf):
    copies = ad.grouped_docs(spark, sf).select("group_id", "source")
    selected = facets.resolve_source(ad.board_dim(spark, sf), "college")
    return facets.filter_source(doc_items(spark, sf), copies, selected).select("id")


@query(
    "source_param_canonical",
    ctes(ad.BOARD_DIM)
    + """SELECT DISTINCT value, CASE WHEN value IN ('all', 'my-major', 'my-college') OR value IN (SELECT source FROM board_dim) THEN value
  WHEN value = 'main' THEN (SELECT min(source) FROM board_dim WHERE kind = 'main')
  WHEN value IN ('college', 'department') THEN value ELSE 'all' END AS canonical
FROM (SELECT CASE doc_id % 7 WHEN 0 THEN 'main' WHEN 1 THEN 'college' WHEN 2 THEN 'department' WHEN 3 THEN 'my-major'
             WHEN 4 THEN lang WHEN 5 THEN 'all' ELSE source END AS value FROM documents)""",
)
def _(spark, sf):
    pick = F.col("doc_id") % 7
    value = (
        F.when(pick == 0, "main").when(pick == 1, "college").when(pick == 2, "department").when(pick == 3, "my-major")
        .when(pick == 4, F.col("lang")).when(pick == 5, "all").otherwise(F.col("source"))
    )
    values = ad.table(spark, sf, "documents").select(value.alias("value")).distinct()
    return facets.canonical_source_param(values, ad.board_dim(spark, sf))


@query(
    "saved_filter",
    ctes(*LIST) + "SELECT id, title FROM items WHERE id IN (SELECT TRY_CAST(regexp_extract(props, '[0-9]+') AS BIGINT) FROM events WHERE event_type = 'click')",
)
def _(spark, sf):
    """Notices somebody clicked; the saved list may hold junk and repeats."""
    saved = ad.table(spark, sf, "events").filter("event_type = 'click'").select(F.regexp_extract("props", "[0-9]+", 0).alias("saved_id"))
    return facets.filter_saved(doc_items(spark, sf), saved).select("id", "title")


@query(
    "dim_lookup",
    ctes(DOCS, ad.BOARD_DIM)
    + """SELECT n.id, coalesce(b.kind, 'main') AS kind, coalesce(b.college, '-') AS college, coalesce(b.major, '-') AS major,
  coalesce(b.ord, (SELECT count(*) FROM board_dim)) AS ord, coalesce(b.major, b.college, '본교') AS label
FROM (SELECT id, CASE WHEN board_category = 'de' THEN 'gone' ELSE source END AS source FROM notice_docs) n LEFT JOIN board_dim b USING (source)""",
)
def _(spark, sf):
    from noticelake.functions.labels import board_label

    rows = ad.notice_docs(spark, sf).select("id", F.when(F.col("board_category") == "de", "gone").otherwise(F.col("source")).alias("source"))
    out = views.board_facts(rows, ad.board_dim(spark, sf))
    return out.select(
        "id", "kind", F.coalesce("college", F.lit("-")).alias("college"), F.coalesce("major", F.lit("-")).alias("major"), "ord",
        board_label(F.col("major"), F.col("college")).alias("label"),
    )


# --- stored groups, details and version rows --------------------------------------------------------------

STORED = """stored AS (
  SELECT k.* EXCLUDE (group_id), k.dup_of IS NOT NULL AND p.id IS NULL AS orphan,
         CASE WHEN p.id IS NULL THEN k.id ELSE k.dup_of END AS group_id
  FROM (SELECT * FROM grouped WHERE published_at >= DATE '2026-09-02') k
  LEFT JOIN (SELECT id FROM grouped WHERE published_at >= DATE '2026-09-02') p ON p.id = k.dup_of)"""
STORED_LATEST = ad.DOC_LATEST.replace("FROM grouped n", "FROM stored n")


def stored_docs(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the groups after the retention day, with the newest analysis."""
    kept = ad.grouped_docs(spark, sf).drop("group_id").filter("published_at >= DATE '2026-09-02'")
    return views.with_latest_analysis(kept, ad.analysis_docs(spark, sf), ANALYSIS_COLS)


@query(
    "stored_list",
    ctes(*GROUPED, STORED, ad.ANALYSIS_DOCS, STORED_LATEST, ITEMS.replace("c.dup_of IS NULL", "c.id = c.group_id"), ad.BOARD_DIM)
    + """, placed AS (SELECT group_id, array_to_string(list(source ORDER BY ord), ',') AS boards
  FROM (SELECT DISTINCT group_id, source, ord FROM latest JOIN board_dim USING (source)) GROUP BY group_id)
SELECT i.id, p.boards, i.n_copies, i.status, i.shown_id, coalesce(i.category, 'pending') AS category FROM items i JOIN placed p USING (group_id)""",
)
def _(spark, sf):
    """The list over groups of which some lost their canonical row, boards in registry order."""
    out = views.stored_list(stored_docs(spark, sf), ad.board_dim(spark, sf), ANALYSIS_COLS)
    category = facets.category_or_pending(F.col("category")).alias("category")
    return out.select("id", F.array_join("boards", ",").alias("boards"), "n_copies", "status", "shown_id", category)


@query(
    "stored_detail",
    ctes(*GROUPED, STORED.replace("CASE WHEN p.id IS NULL THEN k.id ELSE k.dup_of END", "min(k.id) OVER (PARTITION BY coalesce(k.dup_of, k.id))"), ad.ANALYSIS_DOCS, STORED_LATEST)
    + """, ladder AS (
  SELECT group_id, id AS shown_id, status, row_number() OVER (PARTITION BY group_id ORDER BY
           CASE WHEN id = group_id AND status = 'ready' THEN 0 WHEN status = 'ready' THEN 1
                WHEN id = group_id AND status = 'stale' THEN 2 WHEN status = 'stale' THEN 3
                WHEN id = group_id THEN 4 ELSE 5 END, id) AS rn FROM latest)
SELECT q.id AS asked_id, c.id AS canonical_id, CASE WHEN c.id % 5 > 0 THEN 'office ' || c.id % 7 ELSE '-' END AS author,
       CASE c.id % 3 WHEN 0 THEN '' WHEN 1 THEN 'file:"' || c.title || '".pdf' ELSE 'file:"' || c.title || '".pdf,image:2.png' END AS attachments,
       sha256(c.original_content) AS body_hash, l.status, l.shown_id
FROM latest q JOIN latest c ON c.id = q.group_id JOIN ladder l ON l.group_id = c.id AND l.rn = 1""",
)
def _(spark, sf):
    """The detail of every stored copy, with author and attachments of the row that stands for its group."""
    pdf = F.struct(F.lit("file").alias("kind"), F.concat(F.lit('"'), "title", F.lit('".pdf')).alias("name"), F.col("source_url").alias("url"))
    image = F.struct(F.lit("image").alias("kind"), F.lit("2.png").alias("name"), F.col("source_url").alias("url"))
    files = F.when(F.col("id") % 3 == 1, F.to_json(F.array(pdf))).when(F.col("id") % 3 == 2, F.to_json(F.array(pdf, image)))
    author = F.when(F.col("id") % 5 > 0, F.concat(F.lit("office "), (F.col("id") % 7).cast("string")))
    rows = stored_docs(spark, sf).withColumns({"author": author, "attachments_json": files})
    out = views.stored_detail(rows, rows.select("id"), ANALYSIS_COLS)
    named = F.array_join(F.transform("attachments", lambda x: F.concat(x["kind"], F.lit(":"), x["name"])), ",")
    return out.select(
        "asked_id", "canonical_id", F.coalesce("author", F.lit("-")).alias("author"), named.alias("attachments"),
        F.sha2("original_content", 256).alias("body_hash"), "status", "shown_id",
    )


@query(
    "append_version",
    ctes(DOCS, ad.ANALYSIS_DOCS)
    + """SELECT n.id AS notice_id, (SELECT max(analysis_id) FROM analysis_docs) + row_number() OVER (ORDER BY n.source, n.id) AS analysis_id,
       n.content_hash, 'stub' AS provider, 'stub-' || n.board_category AS model, 'v3' AS prompt_version, '2026-09-08' AS created,
       CAST(to_json([n.title, n.source]) AS VARCHAR) AS summary_json,
       CAST(to_json([{'field': 'title', 'quote': n.title}]) AS VARCHAR) AS evidence_json,
       CASE WHEN n.id % 2 = 0 THEN '["target"]' ELSE '[]' END AS uncertain_fields_json,
       CASE WHEN n.id % 3 = 0 THEN '["no date in the text"]' ELSE '[]' END AS validation_warnings_json,
       CAST(to_json({'title': n.title, 'target': CAST(NULL AS VARCHAR)}) AS VARCHAR) AS en_json,
       'reply ' || n.title AS raw_response
FROM notice_docs n WHERE n.id NOT IN (SELECT notice_id FROM analysis_docs)""",
)
def _(spark, sf):
    """The whole stored row of each new version: provider, model, prompt version, warnings and raw reply as well."""
    history = ad.analysis_docs(spark, sf)
    todo = ad.notice_docs(spark, sf).join(history.select(F.col("notice_id").alias("id")), "id", "left_anti")
    none = F.array().cast("array<string>")
    replies = todo.select(
        F.col("id").alias("notice_id"), "source", "content_hash", F.lit("stub").alias("provider"),
        F.concat(F.lit("stub-"), "board_category").alias("model"), F.array("title", "source").alias("summary"),
        F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("quote"))).alias("evidence"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("target"))).otherwise(none).alias("uncertain"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("no date in the text"))).otherwise(none).alias("validation_warnings"),
        F.struct("title", F.lit(None).cast("string").alias("target")).alias("en"), F.concat(F.lit("reply "), "title").alias("raw_response"),
    )
    rows = cdc.version_rows(replies, "v3", F.lit("2026-09-08 00:00:00").cast("timestamp"))
    out = cdc.append_analysis(history, rows, [F.col("source"), F.col("notice_id")])
    return out.withColumn("created", F.date_format("created_at", "yyyy-MM-dd")).drop("source", "created_at")
