"""Line deduplication by a log-template tree, with DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm.common import BROADCAST_ROWS, cut, small_side

BLANKS = r"[\x20\x09-\x0D]+"
DEPTH = 4  # leading tokens that lead to a leaf, after the token count
WIDE_DEPTH = 2  # the same in the query and the pipeline, so that a variable field may stand further to the front
MIN_TOKENS = 3  # shorter lines are no template
MIN_DOCS = 3  # documents in which a template recurs
CONSTANT = 70  # percent of a template's tokens that are not variable, at least
ANY = "<*>"
MIN_COPIES = 2  # documents in which an exact line recurs; MIN_DOCS for a short one
LONG_CHARS = 16  # a line of fewer tokens than MIN_TOKENS is short below it; scripts without spaces have one token a line
SHINGLE = r"(?<!\S)(?=(\S+(?:\s+\S+){4}))"  # five words, from each word on
SKETCH = 128  # smallest shingle hashes by which near copies are judged
COPY = 0.65  # estimated share of the union that near copies have; 0.75 less what the estimate may be off
MAX_LEAF = 20_000  # different lines of a leaf up to which one task counts its tokens; those of larger leaves are dealt by token
MAX_PLACES = 3_000_000  # dropped lines whose places are broadcast; with more, documents and places are shuffled


def _count(text: Column, piece: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def _lines(docs: DataFrame, wide: bool) -> DataFrame:
    """(doc_id, h, pos, leaf, line, s): lines that can be a template. ``s`` has single spaces and masked tokens; ``leaf``
    and ``line`` are hashes, which only ever meet together. If ``wide``, also exact, the hash of the line before tokens
    are masked, and docs, the documents in which it recurs; lines that are too short for a template have no leaf."""
    text = F.col("text")
    raw = F.split(text, "\n")
    odd = [F.contains(text, F.lit(x)) for x in ("\t", "\x0b", "\x0c", "\r", "  ", "\n ", " \n")] + [text.startswith(" "), text.endswith(" ")]
    tidy = F.when(reduce(lambda a, b: a | b, odd), F.transform(raw, lambda x: F.trim(F.regexp_replace(x, BLANKS, " ")))).otherwise(raw)
    # each step is a pass over the array, so that nothing is worked out twice for a line
    masked = F.transform(tidy, lambda x: F.struct(_count(x, " ").alias("blanks"), x.alias("raw"), F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"[^\x20]*[0-9][^\x20]*", ANY)).alias("masked")))
    few = lambda x: _count(x["masked"], ANY) * 100 <= (x["blanks"] + 1) * (100 - CONSTANT)
    worded = lambda x: x["masked"].rlike(r"\p{L}")  # noqa: E731  a word is left that is no variable
    short = lambda x: (x["blanks"] + 1 < MIN_TOKENS) & (F.length(x["raw"]) < LONG_CHARS)
    exact = lambda x: [F.xxhash64(x["raw"]).alias("exact"), F.when(~short(x), MIN_COPIES).when(x["raw"].rlike(r"[\p{L}\p{N}]"), MIN_DOCS).alias("docs")] if wide else []
    counted = F.transform(masked, lambda x: F.struct((x["blanks"] + 1).alias("n"), F.when(worded(x) if wide else few(x), x["masked"]).otherwise(x["raw"]).alias("s"), *exact(x)))
    rows = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(counted).alias("pos", "x")).filter(F.col("x.s") != "")
    leaf = F.xxhash64("x.n", F.substring_index("x.s", " ", WIDE_DEPTH if wide else DEPTH))
    fits = F.col("x.n") >= MIN_TOKENS
    rows = rows.filter(F.col("x.docs").isNotNull()) if wide else rows.filter(fits)
    more = [F.col("x.exact").alias("exact"), F.col("x.docs").alias("docs")] if wide else []
    return rows.select("doc_id", "h", "pos", F.when(fits, leaf).alias("leaf") if wide else leaf.alias("leaf"), F.xxhash64("x.s").alias("line"), F.col("x.s").alias("s"), *more)


def _exact_places(lines: DataFrame) -> DataFrame:
    """(doc_id, h, pos) of each line that stands in another document as well, but for the first one."""
    # two documents are told by the least and the greatest id, with one row a line and task in the shuffle
    ends = lines.filter(F.col("docs") == MIN_COPIES).groupBy("exact").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    twice = ends.filter((F.col("first") != F.col("last")) | F.col("unnamed")).select("exact", "first")
    short = lines.filter(F.col("docs") > MIN_COPIES).select("exact", "docs", "doc_id").distinct()
    often = short.groupBy("exact", "docs").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter(F.col("n") >= F.col("docs"))
    recur = small_side(cut(twice.union(often.select("exact", "first")).filter("first is not null")))
    return lines.join(recur, "exact").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "h", "pos")


def _templates(one: DataFrame, head: int, together: bool) -> DataFrame:
    """(leaf, line, template) of different lines (leaf, line, s, docs).

    All lines of a leaf have its leading tokens, so these are constant where the leaf has enough lines at all, and only
    the tokens behind them are counted. Templates only ever meet in a leaf, so they are told by the hashes of the constants
    with their places. If ``together``, the lines are dealt by leaf and stay there; else their tokens are shuffled."""
    parts = F.split("s", " ")
    leading = F.size(F.filter(F.slice(parts, 1, head), lambda x: x != ANY))
    need = F.ceil(F.size(parts) * CONSTANT / 100.0) - leading  # constants behind the leading tokens that a template has
    place = lambda x, i: F.when((i >= head) & (x != ANY), F.xxhash64(i, x))
    # in two steps: beside the explode all would be worked out again for each token
    lines = one.select("leaf", "line", "docs", need.alias("need"), F.transform(parts, place).alias("keys"))
    tokens = lines.select("leaf", "line", "docs", "need", F.explode("keys").alias("key"))
    if together:
        support = F.sum("docs").over(Window.partitionBy("leaf", "key"))
        tokens = tokens.withColumn("fixed", F.when(support >= MIN_DOCS, F.col("key")))
    else:
        support = tokens.filter("key is not null").groupBy("leaf", "key").agg(F.sum("docs").alias("support")).filter(F.col("support") >= MIN_DOCS)
        tokens = tokens.join(support.select("leaf", "key", F.col("key").alias("fixed")), ["leaf", "key"], "left")
    again = F.xxhash64(F.lit("again"), "fixed")  # two sums of different hashes tell sets of constants apart
    lines = tokens.groupBy("leaf", "line").agg(F.min("need").alias("need"), F.count("fixed").alias("n"), F.bit_xor("fixed").alias("a"), F.bit_xor(F.when(F.col("fixed").isNotNull(), again)).alias("b"))
    return lines.select("leaf", "line", F.when(F.col("n") >= F.col("need"), F.xxhash64("n", "a", "b")).otherwise(F.xxhash64(F.lit("="), "line")).alias("template"))


def _recurring_places(docs: DataFrame, wide: bool) -> DataFrame:
    """(doc_id, h, pos) of each line to drop."""
    lines = _lines(docs, wide)
    narrow = cut(lines.drop("s"))
    places = None
    if wide:
        places = _exact_places(narrow)
        narrow, lines = (x.filter("leaf is not null").drop("exact", "docs") for x in (narrow, lines))
    # leaves with enough lines; each different line of theirs once, with its documents counted: hot lines shrink early
    leaves = narrow.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS).select("leaf")
    leaves = small_side(cut(leaves))
    narrow = narrow.join(leaves, "leaf", "left_semi")
    held = narrow.groupBy("leaf", "line", "doc_id").agg(F.count("*").alias("n")).groupBy("leaf", "line").agg(F.count("*").alias("docs"))
    # one copy of the text of each such line
    texts = lines.select("leaf", "line", "s").join(leaves, "leaf", "left_semi").groupBy("leaf", "line").agg(F.min("s").alias("s"))
    one = cut(texts.join(held, ["leaf", "line"]))
    head = WIDE_DEPTH if wide else DEPTH
    held_leaves = cut(one.groupBy("leaf").agg(F.sum("docs").alias("support"), F.count("*").alias("n")).filter(F.col("support") >= MIN_DOCS).select("leaf", "n"))
    one = one.join(small_side(held_leaves), "leaf")
    # lines are shuffled whole, so that all tokens of a leaf are counted where they are; only those of large leaves are shuffled
    named = _templates(one.filter(F.col("n") <= MAX_LEAF).drop("n").repartition("leaf"), head, together=True)
    if not held_leaves.filter(F.col("n") > MAX_LEAF).isEmpty():
        named = named.unionAll(_templates(one.filter(F.col("n") > MAX_LEAF).drop("n"), head, together=False))
    # documents of each template; its first document keeps it
    found = cut(narrow.join(small_side(cut(named)), ["leaf", "line"]).select("doc_id", "h", "pos", "leaf", "template"))
    per_doc = found.groupBy("leaf", "template", "doc_id").agg(F.min("pos").alias("pos"))
    recur = per_doc.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).filter(F.col("docs") >= MIN_DOCS)
    # written first, so that a template with many lines is looked up in a broadcast or in a join that can be split
    recur = small_side(cut(recur.select("leaf", "template", "first")))
    gone = found.join(recur, ["leaf", "template"]).filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "h", "pos")
    return gone.unionAll(places) if wide else gone


def drop_recurring_lines(docs: DataFrame, cleaned: str = "text", dropped: str = "n_dropped", total: str = "n_lines", wide: bool = False, group: str = "doc_id") -> DataFrame:
    """``docs`` with ``cleaned`` (text without recurring lines), ``total`` (its lines) and ``dropped`` (lines taken out).

    A line's tokens are its pieces between white space; tokens with a digit become a
    variable, unless that leaves less than 70 percent of the line. The tree has the token
    count at its first level and the first four tokens below it. In a leaf a token stays constant at its place if the
    leaf has it there in three (line, document) pairs or more, else it is variable. If at least 70 percent of a line
    are constant, its template is the constants with their places, else the line itself. A template in three
    documents or more is dropped from all of them but the one with the smallest doc_id; that one is left whole. Rows
    without doc_id count as one document, which is never the first one unless it is alone. Lines of fewer than three
    tokens, blank lines and null texts stay. Rows that share doc_id and text are treated alike. Other columns stay.

    ``wide`` is the whole job, and what the query and the pipeline do. With it, the first two tokens alone lead to a leaf, and tokens with a digit become a variable in every line that has a word
    besides them. Also, an exact line (runs of white space count as one blank) is dropped from all documents but the one
    with the smallest doc_id if two documents have it; a line of one or two tokens and under 16 characters if three have
    it and it has a letter or a digit. Lines of fewer than three tokens are in no template.

    ``group`` names the column whose value tells documents apart; rows that share it count as one document.
    """
    own = docs.select(F.col(group).alias("doc_id"), F.col("text").cast("string").alias("text"))
    drop = cut(_recurring_places(own, wide))
    places = drop.count()
    drop = drop.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("gone"))
    drop = drop.select(F.struct("doc_id", "h").alias("_key"), F.col("gone").alias("_gone"))
    drop = F.broadcast(drop) if places <= MAX_PLACES else drop
    text = F.col("d.text").cast("string")
    rows = docs.alias("d").join(drop.alias("x"), F.col("x._key").eqNullSafe(F.struct(F.col(f"d.`{group}`").alias("doc_id"), F.xxhash64(text).alias("h"))), "left")
    lines = F.split(text, "\n")
    left = F.filter(lines, lambda x, i: ~F.array_contains(F.col("x._gone"), i))
    clean = F.when(F.col("x._gone").isNull(), text).otherwise(F.concat_ws("\n", left))
    plain = [F.col(f"d.`{c}`") for c in docs.columns if c not in (cleaned, dropped, total)]
    return rows.select(
        *plain,
        clean.alias(cleaned),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(total),
        F.when(F.col("x._gone").isNull(), 0).otherwise(F.size("x._gone")).cast("long").alias(dropped),
    )


def _near_copies(docs: DataFrame) -> DataFrame:
    """(_copy, _first): documents and the smallest doc_id that they share a line with and are a near copy of.

    For each line the smallest doc_id is asked, so there are no more pairs than lines. Pairs are judged by the smallest
    hashes of their five-word shingles, an estimate of the share of their union that both have."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    lines = own.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= LONG_CHARS)
    lines = cut(lines.select("doc_id", F.xxhash64("line").alias("h")).distinct())
    first = lines.groupBy("h").agg(F.min("doc_id").alias("_first"), F.count("*").alias("n")).filter("n > 1").select("h", "_first")
    pairs = cut(lines.join(first, "h").filter("doc_id != _first").select(F.col("doc_id").alias("_copy"), "_first").distinct())
    asked = cut(pairs.select(F.col("_copy").alias("doc_id")).union(pairs.select("_first")).distinct())
    shingles = F.regexp_extract_all(F.lower("text"), F.lit(SHINGLE), F.lit(1))
    least = lambda hashes: F.slice(F.array_sort(hashes), 1, SKETCH)
    sketch = least(F.array_distinct(F.transform(shingles, lambda x: F.xxhash64(x))))
    sketches = own.join(small_side(asked), "doc_id", "left_semi").select("doc_id", sketch.alias("s")).filter(F.size("s") > 0)
    sketches = cut(sketches.dropDuplicates(["doc_id"]))
    both = pairs.join(sketches.select(F.col("doc_id").alias("_copy"), F.col("s").alias("a")), "_copy").join(sketches.select(F.col("doc_id").alias("_first"), F.col("s").alias("b")), "_first")
    both = both.withColumn("u", least(F.array_union("a", "b")))
    shared = F.size(F.array_intersect(F.array_intersect("u", "a"), "b"))
    near = cut(both.filter(shared >= COPY * F.size("u")).groupBy("_copy").agg(F.min("_first").alias("_first")))
    # a first document may be a copy itself
    above = near.select(F.col("_copy").alias("_first"), F.col("_first").alias("_above"))
    return near.join(above, "_first", "left").select("_copy", F.coalesce("_above", "_first").alias("_first"))


def line_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines taken out and n_chars counted anew; documents that held nothing else are dropped.

    Near copies that share a line (``_near_copies``) count as one document: a line that only they share does not recur,
    and what recurs elsewhere is taken out of all of them. So a later stage finds the copies whole, instead of what would
    be left of them. Rows without doc_id count as one document.
    """
    copies = cut(_near_copies(docs))
    few = copies.count() <= BROADCAST_ROWS
    own = docs.join(F.broadcast(copies) if few else copies, F.col("doc_id") == F.col("_copy"), "left")
    own = own.select(*[docs[c] for c in docs.columns], F.coalesce("_first", "doc_id").alias("_group"))
    own = own if few else cut(own)
    out = drop_recurring_lines(own, cleaned="text", dropped="_n_dropped", total="_n_lines", wide=True, group="_group")
    out = out.filter((F.col("_n_dropped") == 0) | F.col("text").rlike(r"\S"))
    n_chars = F.when(F.col("_n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)
