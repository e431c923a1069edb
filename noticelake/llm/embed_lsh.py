"""Near-duplicate embeddings: quantised random projections (p-stable hashing) in several tables, then exact cosines."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import cut, mix64
from noticelake.llm.components import connected
from noticelake.session import ship_package

COSINE = 0.95
TABLES = 64
PROJECTIONS = 18  # a table
WIDTH = 2.0  # of a quantised projection; unit vectors at cosine 0.95 are 0.316 apart and agree with a chance of 0.87
BLOCK = 1024  # rows of a bucket that are compared in one task
CELLS = 1 << 22  # numbers that a task holds of the blocks it works out together
SEED = 11


@functools.lru_cache(maxsize=4)
def _projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def bucket_keys(unit: np.ndarray) -> np.ndarray:
    """The bucket of each unit vector in each table, as one 64-bit number."""
    lines, shift = _projections(unit.shape[1])
    cells = np.floor((unit @ lines + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, PROJECTIONS)
    keys = np.broadcast_to(mix64(np.arange(1, TABLES + 1, dtype=np.uint64) + np.uint64(unit.shape[1]) * np.uint64(1_000_003)), (len(unit), TABLES)).copy()
    for j in range(PROJECTIONS):
        keys = mix64(keys ^ (cells[:, :, j] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)))
    return keys.view(np.int64)


def _unit(batches):
    """Rows (node, copies, v): the vectors at length one, scaled first so that no square overflows or vanishes."""
    for batch in batches:
        column = batch.column(2)
        sizes = np.diff(np.asarray(column.offsets))
        flat = column.flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), starts), sizes)
        flat /= np.repeat(np.sqrt(np.add.reduceat(flat * flat, starts)), sizes)
        ends = np.append(starts, len(flat)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "copies", "unit"])


def _hash(batches):
    """Rows (node, unit): a row (key, node) for every table."""
    for batch in batches:
        nodes, units = batch.column(0).to_numpy(), batch.column(1)
        sizes = np.diff(np.asarray(units.offsets))
        flat = units.flatten().to_numpy()
        ends = np.cumsum(sizes)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            for lo in range(0, len(at), 2048):
                some = at[lo : lo + 2048]
                keys = bucket_keys(flat[(ends[some] - dim)[:, None] + np.arange(dim)])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(nodes[some], TABLES))], names=["key", "node"])


_FOUND = "node long, other long, links long"


def _complete(batches, keys: int):
    """Record batches joined so that no group of equal leading ``keys`` columns is cut: many small groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        if held and any(c[0] != held[-1].column(i)[-1].as_py() for i, c in enumerate(cols)):
            yield pa.Table.from_batches(held)
            held = []
        same = np.logical_and.reduce([c == c[-1] for c in cols])
        last = batch.num_rows - int(same[::-1].argmin()) if not same.all() else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _first_met(keys: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the rows a and b of ``keys`` share no table before ``table``, pair by pair."""
    out = np.empty(len(a), bool)
    for lo in range(0, len(a), 1 << 16):
        some = slice(lo, lo + (1 << 16))
        out[some] = (keys[a[some]] == keys[b[some]]).argmax(axis=1) == table[some]
    return out


def _links(x: np.ndarray, key: np.ndarray, cross: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Links (group, row, row) that were first met in these groups of equal size: x (group, row, component)."""
    groups, n, dim = x.shape
    near = x @ x.transpose(0, 2, 1) >= COSINE
    near[:, np.arange(n), np.arange(n)] = False
    near &= ~cross[:, None, None] | (side[:, :, None] != side[:, None, :])
    rows = np.flatnonzero(near.any(axis=2))
    if not len(rows):
        return near
    keys = np.concatenate([bucket_keys(x.reshape(-1, dim)[rows[lo : lo + 2048]]) for lo in range(0, len(rows), 2048)])
    place = np.zeros(groups * n, np.int64)
    place[rows] = np.arange(len(rows))
    table = np.zeros(groups, np.int64)
    of = rows // n
    table[of] = (keys == key[of][:, None]).argmax(axis=1)
    g, i, j = np.nonzero(np.triu(near))
    met = _first_met(keys, place[g * n + i], place[g * n + j], table[g])
    near[:] = False
    near[g[met], i[met], j[met]] = True
    return near | near.transpose(0, 2, 1)


def _lowest(near: np.ndarray) -> np.ndarray:
    """For every row of every group the first row that its links lead to."""
    groups, n, _ = near.shape
    low = np.broadcast_to(np.arange(n), (groups, n)).copy()
    while True:
        best = np.minimum(low, np.where(near, low[:, None, :], n).min(axis=2))
        best = np.take_along_axis(best, best, axis=1)
        if (best == low).all():
            return low
        low = best


def _compare(batches):
    """Rows (key, i, j, node, side, copies, unit) sorted by block: for each node the links that were first met here,
    and the first node of the block that its links lead to. Blocks of equal size are worked out together."""
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])
    for part in _complete(batches, 3):
        key, one, two, nodes, side, copies = (part.column(i).to_numpy() for i in range(6))
        units = part.column(6).combine_chunks()
        ends = np.asarray(units.offsets)
        dims = np.diff(ends)
        flat, base = units.flatten().to_numpy(), ends[:-1] - ends[0]
        # rows of unequal length only meet in a bucket by a hash collision; they are groups of their own
        order = np.lexsort((dims, two, one, key))
        change = np.ones(len(key), bool)
        change[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (key, one, two, dims)])
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(key)))
        shapes = np.stack([sizes, dims[order[starts]]], axis=1)
        for n, dim in np.unique(shapes[sizes > 1], axis=0).tolist():
            which = starts[(shapes == (n, dim)).all(axis=1)]
            step = max(1, CELLS // (n * (n + dim)))
            for lo in range(0, len(which), step):
                first = which[lo : lo + step]
                at = order[first[:, None] + np.arange(n)]
                lead = at[:, 0]
                near = _links(flat[base[at][:, :, None] + np.arange(dim)], key[lead], one[lead] != two[lead], side[at])
                g, r = np.nonzero(near.any(axis=2))
                if not len(g):
                    continue
                links = (near @ copies[at][:, :, None].astype(np.float64))[g, r, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at[g, r]]), pa.array(nodes[at[g, _lowest(near)[g, r]]]), pa.array(links)], schema=schema)


def near_embeddings(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors link at a cosine of 0.95 or more, computed in double precision. Null vectors, empty ones, zero vectors and
    those with a null, NaN or infinite component link with nothing. Equal vectors are one node from the start, whose
    copies are counted. Each node is hashed into 64 tables of 18 projections. A bucket is compared in blocks, so that a
    task holds at most two blocks of it; a linked pair is counted in the first table in which it meets, and a block
    returns one number per node and the edges of a spanning forest, never its pairs. A pair at the limit shares no
    table with a chance below one percent, closer pairs with far less.

    Rows that share a vec_id and vector are copies; rows without vec_id count as copies of others but have component_id
    null and kept true. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    valid = F.coalesce(finite & (top > 0), F.lit(False))
    own = own.select("vec_id", F.when(valid, F.col("v")).alias("v"))
    classes = own.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # a class without any vec_id is named by a number that no vec_id can have been given: its hash, made negative and odd
    classes = cut(classes.select("v", "copies", F.col("first").isNull().alias("unnamed"), F.coalesce("first", F.xxhash64("v")).alias("node")))
    nodes = cut(classes.select("node", "copies", "v").mapInArrow(_unit, "node long, copies long, unit array<double>"))
    rows = cut(nodes.select("node", "unit").mapInArrow(_hash, "key long, node long"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = rows.join(buckets, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("side", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "side")
    blocks = members.join(nodes, "node").select("key", "i", "j", "node", "side", "copies", "unit")
    blocks = blocks.repartition(shuffled, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = cut(blocks.mapInArrow(_compare, _FOUND))
    comp = connected(found.filter("node != other"), "node", "other")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.join(links, "node", "left").join(comp, "node", "left")
    # a component is named by its smallest vec_id; unnamed classes may not name one
    named = placed.select("v", "node", "unnamed", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    name = named.filter("not unnamed").groupBy("component").agg(F.min("node").alias("component_id"))
    look = named.join(name, "component", "left").select("v", "n_links", "component_id")
    out = own.join(look, "v", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
