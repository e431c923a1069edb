"""One query per operator, over its whole table, with DuckDB SQL where that can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import decontaminate, embed_lsh, hard_negatives, html_blocks, id_codes, kneser_ney, lang_kernel, line_templates, minhash, packing, secret_scan, shared_search, url_filter
from noticelake.llm.registry import query, table

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _reach(nodes: str, node: str) -> str:
    """Recursive CTE ``comp(node, component_id)``: the smallest node reachable over ``edges(a, b)``, both ways."""
    return f"""
reach(node, seen) AS (
  SELECT {node}, {node} FROM {nodes}
  UNION
  SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""


OP1_SQL = f"""
WITH RECURSIVE raw AS (SELECT vec_id, row_number() OVER () AS r, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (
  SELECT r, vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM raw
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
edges AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / a.n / b.n >= 0.95),
reach(node, seen) AS (SELECT r, r FROM raw UNION SELECT t.node, e.b FROM reach t JOIN edges e ON e.a = t.seen),
comp AS (SELECT node, min(vec_id) AS component_id FROM reach JOIN raw ON raw.r = seen GROUP BY node),
cnt AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(cnt.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM raw JOIN comp ON comp.node = r LEFT JOIN cnt ON cnt.a = r"""


@query("op1_embedding_lsh", OP1_SQL)
def op1_embedding_lsh(spark: SparkSession, sf: str) -> DataFrame:
    return embed_lsh.near_embeddings(table(spark, sf, "embeddings"))


#: The rules of the query: (host and path, verdict).
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

OP2_SQL = rf"""
WITH r AS (
  SELECT *, split_part(rule, '/', 1) AS rhost, substr(rule, instr(rule, '/')) AS rpath
  FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in URL_RULES)}) AS x(rule, verdict)),
p AS (
  SELECT page_id, row_number() OVER () AS k, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
h AS (SELECT page_id, k, {_LOWER.format("regexp_extract(u, '^[^/?#]*')")} AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC NULLS LAST) = 1"""


@query("op2_url_filter", OP2_SQL)
def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


@query("op3_language")
def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = lang_kernel.fit(docs.filter(lang_kernel.in_training(F.col("doc_id"))))
    return lang_kernel.predict(docs, model).select("doc_id", (~lang_kernel.in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


OP4_SQL = rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
occ AS (
  SELECT r, s, x.size, win.item_id
  FROM (SELECT r, size, unnest(range(1, len(w) - size + 2)) AS s, w FROM w, (SELECT DISTINCT size FROM win) WHERE len(w) >= size) x
  JOIN win ON win.size = x.size AND win.gram = array_to_string(x.w[s:s + x.size - 1], ' ')),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(s, s + size)) AS place FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(k, ',' ORDER BY k) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""


@query("op4_decontaminate", OP4_SQL)
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_kneser_ney")
def op5_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = kneser_ney.train(docs.filter(~kneser_ney.held_out(F.col("doc_id"))))
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", kneser_ney.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT r, doc_id, pos, list_filter(regexp_split_to_array(ls[pos + 1], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS u
      FROM (SELECT r, doc_id, ls, unnest(range(0, len(ls))) AS pos FROM d WHERE text IS NOT NULL)),
l AS (
  SELECT r, doc_id, pos, array_to_string(u, ' ') AS raw, list_transform(u, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m,
         CASE WHEN regexp_matches(array_to_string(m, ' '), '\p{L}') THEN m ELSE u END AS t,
         CASE WHEN len(u) >= 3 OR length(raw) >= 16 THEN 2 WHEN regexp_matches(raw, '[\p{L}\p{N}]') THEN 3 END AS need
  FROM u WHERE len(u) > 0),
same AS (SELECT raw, min(doc_id) AS first FROM l WHERE need IS NOT NULL GROUP BY raw, need HAVING count(DISTINCT coalesce(doc_id, -1)) >= need),
ll AS (SELECT r, doc_id, pos, len(t) AS n, array_to_string(t[1:2], ' ') AS head, array_to_string(t, ' ') AS s, t FROM l WHERE len(t) >= 3),
held AS (SELECT n, head, s, any_value(t) AS t, count(DISTINCT coalesce(doc_id, -1)) AS docs FROM ll GROUP BY n, head, s),
tok AS (SELECT n, head, s, docs, unnest(range(1, n + 1)) AS place, unnest(t) AS token FROM held),
sup AS (SELECT n, head, place, token FROM tok GROUP BY n, head, place, token HAVING sum(docs) >= 3),
fix AS (SELECT n, head, s, count(*) AS c, string_agg(place - 1 || ':' || token, ' ' ORDER BY place) AS g FROM tok JOIN sup USING (n, head, place, token) WHERE token <> '<*>' GROUP BY n, head, s),
tem AS (SELECT h.n, h.head, h.s, CASE WHEN coalesce(c, 0) * 100 >= h.n * 70 THEN g ELSE '=' || h.s END AS tpl FROM held h LEFT JOIN fix f ON f.n = h.n AND f.head = h.head AND f.s = h.s),
rec AS (SELECT n, head, tpl, min(doc_id) AS first FROM ll JOIN tem USING (n, head, s) GROUP BY n, head, tpl HAVING count(DISTINCT coalesce(doc_id, -1)) >= 3),
out AS (SELECT r, pos FROM ll JOIN tem USING (n, head, s) JOIN rec USING (n, head, tpl) WHERE ll.doc_id IS DISTINCT FROM rec.first
        UNION SELECT r, pos FROM l JOIN same USING (raw) WHERE l.doc_id IS DISTINCT FROM same.first),
gone AS (SELECT r, list(pos) AS gone FROM out GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)) END AS kept_text
FROM d LEFT JOIN gone USING (r)"""


@query("op6_line_templates", OP6_SQL)
def op6_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs, cleaned="kept_text", wide=True).select("doc_id", "n_lines", "n_dropped", "kept_text")


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op7_packing")
def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), TOKENIZER)


@query("op8_html_blocks")
def op8_html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return html_blocks.extract(pages, html_blocks.fit(pages))


OP9_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
edges AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
{_reach("d", "doc_id")}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp ON comp.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


@query("op9_minhash", OP9_SQL)
def op9_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


# kind, pattern, group, characters of the group at least; the first three are the contract's own words
SECRET_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 32),
]


def _kind_sql(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
SELECT k, {place} AS place, '{kind}' AS kind, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS start, length(f[i]) AS n
FROM (SELECT k, f, v, g, unnest(range(1, len(f) + 1)) AS i
      FROM (SELECT k, regexp_extract_all(text, '{pattern}', 0) AS f, regexp_extract_all(text, '{pattern}', {group}) AS v, regexp_split_to_array(text, '{pattern}') AS g
            FROM d WHERE regexp_matches(text, '{pattern}')))
WHERE length(v[i]) >= {least}"""


OP10_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_kind_sql(i, *x) for i, x in enumerate(SECRET_KINDS))}),
s AS (
  SELECT k, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, place) FILTER (place < 3) AS base,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, place) AS spans
  FROM f GROUP BY k)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (k)"""


@query("op10_secret_scan", OP10_SQL)
def op10_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf, "documents"))


OP11_SQL = """
WITH raw AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
own AS (
  SELECT r, vec_id, label, list_transform(v, lambda x: CAST(floor(256 * x) AS BIGINT)) AS q FROM raw
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS s
  FROM own a JOIN own b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, other NULLS LAST) <= 5),
neg AS (
  SELECT p.a, p.b, p.anchor_id, p.other AS positive_id, p.s AS positive_score, n.other AS negative_id, n.s AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.other NULLS LAST) AS rank
  FROM pos p JOIN pair n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op12_id_codes")
def op12_id_codes(spark: SparkSession, sf: str) -> DataFrame:
    return id_codes.read_ids(id_codes.write_ids(table(spark, sf, "documents"), TOKENIZER))


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT row_number() OVER () AS k, item_id, unnest(list_distinct(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM benchmark),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS HUGEINT) AS words FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, floor(1000 * ln((2 * (SELECT n_docs FROM c) + 2) / (2 * count(*) + 1))) AS w FROM p GROUP BY t),
s AS (
  SELECT k, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
         sum(CAST(f.w AS HUGEINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * n_docs) // words)))) AS score
  FROM i JOIN p USING (t) JOIN f USING (t) JOIN d USING (r), c GROUP BY k, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM s WHERE score > 0 QUALIFY rank <= 50"""


@query("op13_shared_search", OP13_SQL)
def op13_shared_search(spark: SparkSession, sf: str) -> DataFrame:
    return shared_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
