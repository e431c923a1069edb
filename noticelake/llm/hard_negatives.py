"""Hard negatives by angular triangle filtering: angles to reference directions bound every integer score from both sides."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm.common import cut, give_back
from noticelake.session import ship_package

SCALE = 256  # components are floor(SCALE * x)
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score that a negative may have
REFERENCES = 16  # directions whose angles are stored
ANCHORS = 4096  # anchors that a task holds
ROWS = 16384  # rows that are dealt to a task for each block of anchors; they stream through it
TILE = 64, 2048  # anchors and rows whose bounds are worked out together
ANGLE_SLACK = 1e-6  # radians; rounding moves an angle by less than 1e-7
SCORE_SLACK = 1e-9  # share of the product of the norms; rounding moves a product by less than 1e-14 of it
LEAST, MOST = -(2**63), 2**63 - 1


# ---- vectors as integers, norms and angles -------------------------------------------------------


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row offsets of a list column."""
    offsets = np.asarray(column.offsets)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def angles(x: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the rows of ``x`` and their angles to unit ``directions``; a zero row has angles 0, which its norm cancels."""
    top = np.abs(x).max(axis=1, initial=0.0)
    scaled = x / np.where(top > 0, top, 1.0)[:, None]
    size = np.sqrt((scaled * scaled).sum(axis=1))
    unit = scaled / np.where(size > 0, size, 1.0)[:, None]
    return size * top, np.where(size[:, None] > 0, np.arccos(np.clip(unit @ directions.T, -1.0, 1.0)), 0.0)


def _references(own: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By dimension, unit directions of the ``n`` different vectors with the smallest hashes: at most ``n`` rows come here."""
    picked = own.select(F.xxhash64("q").alias("h")).distinct().orderBy("h").limit(n)
    hashes = [r["h"] for r in picked.collect()]
    rows = own.select("q", F.xxhash64("q").alias("h")).filter(F.col("h").isin(hashes)).dropDuplicates(["h"]).orderBy("h").collect() if hashes else []
    out: dict[int, list] = {}
    for r in rows:
        v = np.array(r["q"], np.float64)
        if v.any():
            v = v / np.abs(v).max()
            out.setdefault(len(v), []).append(v / np.sqrt(v @ v))
    return {d: np.array(v) for d, v in out.items()}


def _with_angles(references: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            flat, offsets = _matrix(batch.column(batch.schema.get_field_index("q")))
            sizes = np.diff(offsets)
            norm, angle = np.zeros(len(sizes)), [None] * len(sizes)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = flat[offsets[at][:, None] + np.arange(dim)].astype(np.float64)
                norm[at], found = angles(x, references.get(dim, np.zeros((0, dim))))
                for i, a in zip(at.tolist(), found, strict=True):
                    angle[i] = a
            cols = [*batch.columns, pa.array(norm), pa.array(angle, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "norm", "angles"])
        give_back()

    return run


# ---- bounds and scores ---------------------------------------------------------------------------


def bounds(a_norm, a_angles, x_norm, x_angles) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that no score of anchor and row lies beyond. The angle between two vectors is at least the difference of
    their angles to any direction, and at most their sum or what the sum lacks to a full turn."""
    n, m = len(a_norm), len(x_norm)
    near, far = np.zeros((n, m)), np.full((n, m), np.pi)
    for r in range(a_angles.shape[1]):
        a, x = a_angles[:, r, None], x_angles[None, :, r]
        np.maximum(near, np.abs(a - x), out=near)
        total = a + x
        np.minimum(far, np.minimum(total, 2 * np.pi - total), out=far)
    size = a_norm[:, None] * x_norm[None, :]
    slack = size * SCORE_SLACK + 1.0
    high = size * np.cos(np.maximum(near - ANGLE_SLACK, 0.0)) + slack
    low = size * np.cos(np.minimum(far + ANGLE_SLACK, np.pi)) - slack
    return np.clip(low, LEAST, MOST), np.clip(high, LEAST, MOST)  # scores stay at these limits too


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of int64 rows; beyond 64 bits they stay at the limit."""
    top = int(max(abs(int(a.min(initial=0))), int(a.max(initial=0)))) * int(max(abs(int(x.min(initial=0))), int(x.max(initial=0)))) * max(1, a.shape[1])
    if top < 2**53:  # every partial sum is an exact double
        return (a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if top < 2**63:
        return a @ x.T
    exact = a.astype(object) @ x.T.astype(object)
    return np.array(np.clip(exact, LEAST, MOST), dtype=np.int64).reshape(len(a), len(x))


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """floor or ceil of percent * score / 100 without a product beyond 64 bits."""
    whole, rest = score // 100, score % 100 * percent
    return whole * percent + (-(-rest // 100) if up else rest // 100)


def windows(positive_scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest negative score for each positive's; least > largest where no score fits."""
    return _share(positive_scores, low, True), _share(positive_scores, high, False)


@dataclass
class _Search:
    """The best ``k`` rows of every window of a block of anchors, as rows stream by."""

    k: int
    same: bool  # rows of the anchor's label, or all others
    rid: np.ndarray
    label: np.ndarray
    q: np.ndarray
    norm: np.ndarray
    angle: np.ndarray
    owner: np.ndarray  # of each window, its anchor
    slot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    held: list = field(default_factory=list)
    n_held: int = 0

    def __post_init__(self):
        order = np.argsort(self.owner, kind="stable")
        self.owner, self.slot, self.low, self.high = self.owner[order], self.slot[order], self.low[order].copy(), self.high[order]
        self.first = np.searchsorted(self.owner, np.arange(len(self.rid) + 1))

    def add(self, rid, vec_id, null, label, q, norm, angle) -> None:
        for lo in range(0, len(self.rid), TILE[0]):
            a = slice(lo, min(lo + TILE[0], len(self.rid)))
            w = slice(self.first[a.start], self.first[a.stop])
            if w.start == w.stop:
                continue
            owner = self.owner[w] - lo
            for at in range(0, len(rid), TILE[1]):
                x = slice(at, at + TILE[1])
                fits = (self.label[a, None] == label[None, x]) == self.same
                fits &= self.rid[a, None] != rid[None, x]
                least, most = bounds(self.norm[a], self.angle[a], norm[x], angle[x])
                # k rows that surely lie in a window keep out all that surely score less
                sure = np.where(fits[owner] & (least[owner] >= self.low[w, None]) & (most[owner] <= self.high[w, None]), least[owner], -np.inf)
                if sure.shape[1] >= self.k:
                    floor = np.partition(sure, -self.k, axis=1)[:, -self.k]
                    up = np.isfinite(floor)
                    self.low[w][up] = np.maximum(self.low[w][up], np.ceil(np.minimum(floor[up], 2.0**63 - 1024)).astype(np.int64))
                open_ = fits[owner] & (most[owner] >= self.low[w, None]) & (least[owner] <= self.high[w, None])
                some = np.flatnonzero(open_.any(axis=0))
                if not len(some):
                    continue
                wanted = np.unique(owner[open_.any(axis=1)])
                place = np.zeros(a.stop - lo, np.int64)
                place[wanted] = np.arange(len(wanted))
                exact = scores(self.q[a][wanted], q[x][some])
                for v in np.flatnonzero(open_.any(axis=1)).tolist():
                    got = exact[place[owner[v]]]
                    hit = np.flatnonzero(open_[v, some] & (got >= self.low[w.start + v]) & (got <= self.high[w.start + v]))
                    if len(hit):
                        rows = at + some[hit]
                        self.held.append((np.full(len(hit), w.start + v), got[hit], vec_id[rows], null[rows], rid[rows]))
                        self.n_held += len(hit)
            if self.n_held > 4 * self.k * len(self.owner) + (1 << 18):
                self.thin()
        self.thin()

    def thin(self) -> None:
        """Keep the best of each window; its worst one is the bar for later rows."""
        if not self.held:
            return
        window, score, vec_id, null, rid = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((rid, vec_id, null, ~score, window))
        window = window[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        keep = order[rank < self.k]
        self.held = [(window[rank < self.k], score[keep], vec_id[keep], null[keep], rid[keep])]
        self.n_held = len(keep)
        full = np.flatnonzero(rank == self.k - 1)
        self.low[window[full]] = np.maximum(self.low[window[full]], score[order[full]])

    def found(self) -> pa.RecordBatch | None:
        self.thin()
        if not self.held:
            return None
        window, score, vec_id, null, rid = self.held[0]
        cols = [pa.array(self.rid[self.owner[window]]), pa.array(self.slot[window]), pa.array(rid), pa.array(vec_id, mask=null), pa.array(score)]
        return pa.RecordBatch.from_arrays(cols, names=["anchor", "slot", "rid", "vec_id", "score"])


_FOUND = "anchor long, slot long, rid long, vec_id long, score long"


def _runs(batches, keys: int):
    """(keys, batch) of record batches cut where one of the leading columns changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.ones(batch.num_rows, bool)
        change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        starts = np.flatnonzero(change).tolist()
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield tuple(int(c[lo]) for c in cols), batch.slice(lo, hi - lo)


def _columns(batch: pa.RecordBatch) -> dict:
    col = {n: batch.column(n) for n in ("rid", "vec_id", "label", "q", "norm", "angles")}
    flat, at = _matrix(col["q"])
    turn, turn_at = _matrix(col["angles"])
    dim, directions = int(at[1] - at[0]), int(turn_at[1] - turn_at[0])  # equal in all rows of a block
    return {
        "rid": col["rid"].to_numpy(), "vec_id": col["vec_id"].fill_null(0).to_numpy(), "null": col["vec_id"].is_null().to_numpy(zero_copy_only=False), "label": col["label"].to_numpy(),
        "q": flat.reshape(batch.num_rows, dim), "norm": col["norm"].to_numpy(), "angle": turn.reshape(batch.num_rows, directions),
    }


def _searching(k: int, same: bool, low: int, high: int):
    """Rows sorted by (dim, i, j, side): the anchors of a block (side 0), then the rows that they meet."""

    def run(batches):
        key, anchors, search = None, [], None
        for now, part in _runs(batches, 4):
            if now[:3] != key:
                if search and (out := search.found()):
                    yield out
                key, anchors, search = now[:3], [], None
            if now[3] == 0:
                anchors.append(part)
                continue
            if not anchors:
                continue
            if search is None:
                block = pa.Table.from_batches(anchors).combine_chunks().to_batches()[0]
                a = _columns(block)
                bars = [b or [] for b in block.column("bars").to_pylist()]
                owner = np.repeat(np.arange(len(bars)), [len(b) for b in bars])
                slot = np.concatenate([np.arange(len(b)) for b in bars]).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
                marks = np.array([x for b in bars for x in b], np.int64)
                least, most = (np.full(len(marks), LEAST), np.full(len(marks), MOST)) if same else windows(marks, low, high)
                search = _Search(k, same, a["rid"], a["label"], a["q"], a["norm"], a["angle"], owner, slot, least, most)
            r = _columns(part)
            search.add(r["rid"], r["vec_id"], r["null"], r["label"], r["q"], r["norm"], r["angle"])
        if search and (out := search.found()):
            yield out
        give_back()

    return run


def _meet(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, k: int, same: bool, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The best ``k`` rows of each anchor's windows. Anchors and rows are dealt into blocks by a hash, whatever their
    label; each block of anchors meets each block of rows in one group, through which the rows stream."""
    i, j = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    rest = ["rid", "vec_id", "label", "q", "norm", "angles", "bars"]
    dim = F.size("q").alias("dim")
    left = anchors.select(dim, every(i).alias("i"), block(j).alias("j"), F.lit(0).alias("side"), *rest)
    right = rows.withColumn("bars", F.lit(None).cast("array<long>")).select(dim, block(i).alias("i"), every(j).alias("j"), F.lit(1).alias("side"), *rest)
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.unionAll(right).repartition(parts, "dim", "i", "j").sortWithinPartitions("dim", "i", "j", "side")
    found = met.mapInArrow(_searching(k, same, low, high), _FOUND)
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "rid")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE, references: int = REFERENCES
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; ``anchor`` is a condition on its columns (null: no anchor). Components
    become floor(scale * x), at the limits of 64 bits where they pass them, and a score is the integer inner product,
    at those limits likewise. Scores are descending, ties by smaller vec_id, null ids last. An anchor's positives are
    its first ``positives`` other rows of its label; each gets the first ``negatives`` rows of other labels whose score
    lies between ``low`` and ``high`` percent of the positive's (none, if that is negative). Rows with a null label, a
    null vector, or a null or non-finite component take no part; vectors of unequal length never meet, empty ones score
    0. A repeated row is another row, and rows that share a vec_id are anchors each. Other columns are ignored, an
    empty table gives no rows.

    Every row stores its norm and its angles to ``references`` directions, vectors of the table itself. A task bounds
    all scores of a block of anchors and a block of rows by these, tile by tile, and multiplies integers only for
    rows whose interval overlaps an open window; a window closes from below as better rows are found.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    own = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("v"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.filter(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    own = own.select("vec_id", "label", "anchor", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("q"))
    fields = "rid long, vec_id long, label long, anchor boolean, q array<long>"
    nodes = own.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "anchor", "q")
    nodes = cut(nodes.mapInArrow(_with_angles(_references(own, references)), fields + ", norm double, angles array<double>"))
    sizes = nodes.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    anchors = nodes.filter("anchor").drop("anchor")
    rows = nodes.drop("anchor")

    open_ = anchors.withColumn("bars", F.array(F.lit(0).cast("long")))
    best = cut(_meet(open_, rows, sizes["a"], sizes["n"], positives, True).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).cast("long").alias("slot")))
    bars = best.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("bars"))
    barred = anchors.join(bars.withColumnRenamed("anchor", "rid"), "rid")
    found = _meet(barred, rows, sizes["a"], sizes["n"], negatives, False, low, high)
    names = anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = found.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(best, ["anchor", "slot"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
