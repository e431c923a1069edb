"""Benchmark decontamination with DataFrame functions alone: word windows of documents against test items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm.common import ascii_lower, cut, small_side, words_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # ASCII but for digits and a-z, after lower-casing
WINDOW = 10  # words
MAX_BROADCAST = 400_000  # benchmark n-grams; more are joined by a shuffle


def normal_words(text: Column) -> Column:
    return words_of(ascii_lower(text), SEPARATORS)


def _gram(words: str, start: Column, size) -> Column:
    return F.concat_ws(" ", F.slice(F.col(words), start + 1, size))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(size, gram, item_id), distinct: every window of an item, or the whole item if it is shorter."""
    rows = items.select(F.col("item_id"), normal_words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    rows = rows.withColumn("size", F.least(F.size("w"), F.lit(window)))
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))))
    return rows.select("size", F.concat_ws(" ", F.slice("w", F.col("start") + 1, F.col("size"))).alias("gram"), "item_id").distinct()


def anchor_stride(size: int) -> tuple[int, int]:
    """(stride, anchor words) for windows of ``size`` words: any window covers a whole anchor that starts at a
    multiple of the stride, as stride + anchor = size + 1."""
    stride = (size + 1) // 2
    return stride, size + 1 - stride


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, h, start, size, item_id): each place in a document where a window of an item occurs.

    ``h`` is a hash of the text, so that rows with one doc_id but other texts stay apart. Documents are read once for
    windows of all sizes. Anchors, about half a window long, are looked up at every stride-th word of each document in
    the hash set of all anchors of the items; only around a found anchor are the windows spelt out and compared in full.
    """
    wins = cut(item_windows(items, window))
    sizes = sorted(r["size"] for r in wins.select("size").distinct().collect())  # 1 to ``window`` at most
    if not sizes:
        return wins.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("h"), F.lit(0).alias("start"), "size", "item_id").limit(0)
    steps = [F.struct(F.lit(n).alias("size"), F.lit(anchor_stride(n)[0]).alias("stride"), F.lit(anchor_stride(n)[1]).alias("length")) for n in sizes]
    size, stride, length = (F.col(f"step.{x}") for x in ("size", "stride", "length"))
    spelt = wins.withColumn("step", F.explode(F.array(*steps))).filter(size == F.col("size")).select("step", F.split("gram", " ").alias("g"))
    anchors = spelt.select(size.alias("size"), F.explode(F.transform(F.sequence(F.lit(0), size - length), lambda i: F.xxhash64(_gram("g", i, length)))).alias("anchor"))
    anchors = small_side(cut(anchors.distinct()), MAX_BROADCAST)
    words = docs.select("doc_id", F.xxhash64("text").alias("h"), normal_words(F.col("text")).alias("w"))
    scan = words.withColumn("step", F.explode(F.array(*steps))).filter(F.size("w") >= size)
    places = F.transform(F.sequence(F.lit(0), F.size("w") - length, stride), lambda p: F.xxhash64(_gram("w", p, length)))
    scan = scan.select("doc_id", "h", "w", size.alias("size"), stride.alias("stride"), length.alias("length"), F.posexplode(places).alias("k", "anchor"))
    found = scan.join(anchors, ["size", "anchor"]).withColumn("p", F.col("k") * F.col("stride"))
    first = F.greatest(F.col("p") - (F.col("size") - F.col("length")), F.lit(0))
    last = F.least(F.col("p"), F.size("w") - F.col("size"))
    near = F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("start"), _gram("w", s, F.col("size")).alias("gram")))
    near = found.filter(first <= last).select("doc_id", "h", "size", F.explode(near).alias("x")).select("doc_id", "h", "size", "x.start", "x.gram")
    return near.join(small_side(wins, MAX_BROADCAST), ["size", "gram"]).select("doc_id", "h", "start", "size", "item_id").distinct()


def _per_text(hits: DataFrame) -> DataFrame:
    """(doc_id, h, n_hit, n_items, item_list): words covered by any window, each once, and the items."""
    spans = hits.groupBy("doc_id", "h", "start").agg(F.max("size").alias("size"))
    order = Window.partitionBy("doc_id", "h").orderBy("start")
    reached = F.coalesce(F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", reached))
    covered = spans.withColumn("fresh", fresh).groupBy("doc_id", "h").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("doc_id", "h", F.col("item_id").cast("string").alias("item")).distinct()
    listed = named.groupBy("doc_id", "h").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("item_list"))
    a, b = covered.alias("a"), listed.alias("b")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.h").eqNullSafe(F.col("b.h"))).select("a.doc_id", "a.h", "n_hit", "n_items", "item_list")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, letters a-z and non-ASCII characters after lower-casing A-Z. A document word is hit if
    it lies in an occurrence of a window of ``items`` (item_id, text). Null and wordless texts have no words and no
    hits; items without words have no window; an empty benchmark hits nothing. Repeated rows and rows that share a
    doc_id are judged each by its own text. Other columns are ignored. A null item_id counts as no named item.
    """
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(_per_text(window_hits(docs.filter("text is not null"), items, window)))
    found = small_side(found).alias("f")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.size(normal_words(F.col("text"))).cast("long").alias("n_words")).alias("d")
    joined = rows.join(found, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h")), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "d.doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("item_list", F.lit("")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; columns stay as they are."""
    own = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    hit = small_side(cut(window_hits(own, items, window).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct()))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_d"]) & (F.xxhash64(docs["text"].cast("string")) == hit["_h"]), "left_anti")
