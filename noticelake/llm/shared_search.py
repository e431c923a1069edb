"""Ranked lexical search for many items at once: term sets that items share are scored once for each document."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm.common import LOWER, ascii_lower, cut, give_back, slices, utf8
from noticelake.session import ship_package

TOP = 50
SLOTS = 100_000  # terms of all items, with repeats, that are searched in one pass; a longer item has a pass of its own
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CELLS = 1 << 21  # numbers of accumulators that a task holds
SALT = 32  # parts of an item's candidates that are thinned before they meet

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


# ---- the query-sharing DAG -------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """Nodes 0 .. len(terms)-1 are terms; node len(terms)+i is the sum of the two nodes sums[i]. ``parts`` holds the nodes
    of each item end to end, ``first`` where each begins; items without a term are left out of ``items``."""

    terms: list[str]
    sums: np.ndarray
    items: np.ndarray
    parts: np.ndarray
    first: np.ndarray

    def levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(node, left, right) of sums whose operands are ready, level by level."""
        n = len(self.terms)
        depth = np.zeros(n + len(self.sums), np.int64)
        for i, (a, b) in enumerate(self.sums.tolist()):
            depth[n + i] = max(depth[a], depth[b]) + 1
        own = depth[n:]
        return [(n + at, self.sums[at, 0], self.sums[at, 1]) for d in range(1, int(own.max(initial=0)) + 1) for at in [np.flatnonzero(own == d)]]


def plan(term_sets: list[list[str]]) -> Plan:
    """Mine term sets that items share: terms that stand in exactly the same items are summed first, then again and
    again the two nodes that the most items hold together become one node, as long as two items hold both."""
    terms = sorted({t for s in term_sets for t in s})
    number = {t: i for i, t in enumerate(terms)}
    holders: dict[int, frozenset[int]] = {}
    by_term = defaultdict(set)
    for item, s in enumerate(term_sets):
        for t in s:
            by_term[number[t]].add(item)
    sums: list[tuple[int, int]] = []

    def joined(a: int, b: int) -> int:
        sums.append((a, b))
        return len(terms) + len(sums) - 1

    classes = defaultdict(list)
    for t, items in sorted(by_term.items()):
        classes[frozenset(items)].append(t)
    for items, members in classes.items():
        if len(items) > 1:
            while len(members) > 1:  # a balanced tree
                members = [joined(*members[i : i + 2]) if i + 1 < len(members) else members[i] for i in range(0, len(members), 2)]
        for node in members:
            holders[node] = items
    own = [set() for _ in term_sets]
    for node, items in holders.items():
        for i in items:
            own[i].add(node)
    shared = [[n for n in s if len(holders[n]) > 1] for s in own]
    together: Counter = Counter()
    for s in shared:
        s.sort()
        together.update((a, b) for x, a in enumerate(s) for b in s[x + 1 :])
    heap = [(-c, pair) for pair, c in together.items() if c > 1]
    heapq.heapify(heap)
    live = {n: set(i) for n, i in holders.items() if len(i) > 1}
    while heap:
        count, (a, b) = heapq.heappop(heap)
        both = live.get(a, set()) & live.get(b, set())
        if len(both) < 2:
            continue
        if len(both) < -count:  # counted before other sums took items away
            heapq.heappush(heap, (-len(both), (a, b)))
            continue
        node = joined(a, b)
        near: Counter = Counter()
        for i in both:
            own[i] -= {a, b}
            near.update(n for n in own[i] if n in live)
            own[i].add(node)
        live[a] -= both
        live[b] -= both
        live[node] = both
        for other, c in near.items():
            if c > 1:
                heapq.heappush(heap, (-c, (other, node)))
    items = [i for i, s in enumerate(own) if s]
    sizes = [len(own[i]) for i in items]
    parts = np.array([n for i in items for n in sorted(own[i])], np.int64)
    return Plan(terms, np.array(sums, np.int64).reshape(-1, 2), np.array(items, np.int64), parts, (np.cumsum(sizes) - sizes).astype(np.int64))


# ---- postings and statistics ---------------------------------------------------------------------


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the rows as one string array, and the row of each; a term ends with its row."""
    inside = _INSIDE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(LOWER[data[inside]])])
    return words, np.searchsorted(offsets, starts, side="right") - 1


_POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"


def _posting(terms: list[str]):
    """Rows (doc_id, n, terms, counts): a document's number of terms, and those of the items with their occurrences."""
    names = pa.array(terms, pa.string())

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets, 1 << 22):
                n = hi - lo
                words, row = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found = pc.index_in(words, value_set=names)
                known = found.is_valid().to_numpy(zero_copy_only=False)
                code = row[known] * len(terms) + found.drop_null().to_numpy().astype(np.int64)
                code, count = np.unique(code, return_counts=True)
                at = np.searchsorted(code, np.arange(n + 1) * len(terms)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (code % max(1, len(terms)), count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(np.bincount(row, minlength=n).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])
        give_back()

    return run


def _counting(n_terms: int):
    """Rows (term, n): documents that hold the term; -1: documents with any term, -2: all terms of all documents."""

    def run(batches):
        df, docs, words = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            docs += int((own > 0).sum())
            words += int(own.sum())
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[docs, words], df[at]]))], names=["term", "n"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, w: np.ndarray, n: np.ndarray, n_docs: int, words: int) -> np.ndarray:
    """w * ((1000000000 * tf) div (1000 * tf + 20 * m)) with m = 50 + ((50 * n * N) div L)."""
    if 50 * int(n.max(initial=0)) * n_docs < 2**63:
        m = 50 + 50 * n * n_docs // words
    else:
        m = np.array([50 + 50 * int(x) * n_docs // words for x in n], np.int64)
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


# ---- evaluation ------------------------------------------------------------------------------------


class _Best:
    """The best documents of every item, as batches of scores stream by."""

    def __init__(self, items: int, top: int):
        self.top, self.bar = top, np.ones(items, np.int64)
        self.held, self.n = [], 0

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.bar[:, None])
        if len(item):
            self.held.append((item, scores[item, at], doc[at], null[at]))
            self.n += len(item)
        if self.n > 4 * self.top * len(self.bar) + (1 << 16):
            self.thin()

    def thin(self) -> None:
        item, score, doc, null = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.top]
        self.held = [(item[rank < self.top], score[keep], doc[keep], null[keep])]
        self.n = len(keep)
        full = np.flatnonzero(rank == self.top - 1)
        self.bar[item[full]] = score[order[full]]


def _searching(shared: Plan, weights: np.ndarray, n_docs: int, words: int, top: int):
    """Postings in, the best documents of each item out: every node of the DAG is summed once for a document."""

    def run(batches):
        levels, n_terms = shared.levels(), len(shared.terms)
        nodes = n_terms + len(shared.sums)
        best = _Best(len(shared.items), top)
        step = max(1, CELLS // max(1, nodes))
        for batch in batches:
            docs, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ends = np.asarray(part.column(2).offsets)
                term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(ends))
                sums = np.zeros((nodes, part.num_rows), np.int64)
                sums[term, row] = impacts(tf, weights[term], part.column(1).to_numpy()[row], n_docs, words)
                for node, a, b in levels:
                    sums[node] = sums[a] + sums[b]
                scores = np.add.reduceat(sums[shared.parts], shared.first, axis=0)
                best.add(scores, docs[lo : lo + step], null[lo : lo + step])
        if best.held:
            best.thin()
            item, score, doc, null = best.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(shared.items[item]), pa.array(doc, mask=null), pa.array(score)], names=["item", "doc_id", "score"])
        give_back()

    return run


def _block(docs: DataFrame, items: list[tuple], top: int) -> DataFrame:
    """The rows of one bounded block of (item_id, terms)."""
    spark = docs.sparkSession
    shared = plan([t for _, t in items])
    postings = cut(docs.mapInArrow(_posting(shared.terms), _POSTINGS))
    counted = postings.select("n", "terms").mapInArrow(_counting(len(shared.terms)), "term long, n long")
    counts = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row per term of the block
    n_docs, words = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([weight(n_docs, counts.get(i, 0)) for i in range(len(shared.terms))], np.int64)
    found = postings.mapInArrow(_searching(shared, weights, n_docs, max(1, words), top), "item long, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(items)], "item long, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, slots: int = SLOTS) -> DataFrame:
    """The ``top`` documents of every item: item_id, rank (from 1), doc_id, score.

    ``docs`` has doc_id and text, ``items`` has item_id and text. Terms are runs of digits, letters and characters beyond
    ASCII, A-Z lower-cased; null or empty text has none. With N documents that hold a term, L terms in all, n terms of
    the document, df documents that hold the term and tf occurrences, the score sums over the item's different terms
    floor(1000 ln((2N+2)/(2df+1))) * ((10^9 tf) div (1000 tf + 20 m)), m = 50 + ((50 n N) div L), in integers. Scores of
    0 are left out. Equal scores are ordered by doc_id, null ids last; a repeated document or item counts each time.
    Items without a term, and empty tables, give no rows. Other columns are ignored.

    Items come to the driver in blocks of at most ``slots`` terms (a longer item alone), one block at a time. For a
    block the term sets that items share are mined into a DAG of sums. The documents' counts of the block's terms are
    written once; tasks sum each node of the DAG once for a document and keep the best documents of each item, so
    neither postings nor accumulators are shuffled.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), terms.alias("terms")).filter(F.size("terms") > 0)
    out, block, held = [], [], 0
    for row in asked.toLocalIterator():
        if block and held + len(row["terms"]) > slots:
            out.append(cut(_block(texts, block, top)))
            block, held = [], 0
        block.append((row["item_id"], row["terms"]))
        held += len(row["terms"])
    if block:
        out.append(_block(texts, block, top))
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionAll(more)
    return result
