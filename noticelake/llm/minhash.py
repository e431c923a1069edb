"""Near-duplicate documents: b-bit MinHash over word shingles, candidates by bands, links confirmed on full sets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import LOWER, cut, give_back, hash_words, mix64, slices, small_side, utf8, word_spans
from noticelake.llm.components import connected
from noticelake.session import ship_package

WORDS = 5  # words a shingle
LINK = 75  # percent of the union that two sets share at least
MINIMA = 128
BAND_ROWS = 4  # 32 bands of 4: a pair at 0.75 shares none with a chance of 5e-6
BITS = 4  # bits kept of each minimum
SLACK = 0.17  # below the link limit, 4 standard deviations of the estimate
PIVOT_SHARE = 400  # members that one task compares with a pivot's set
BLOCK = 1500  # rows of a bucket that are compared in one task

_SEED = np.random.default_rng(7_331)
_XOR = _SEED.integers(0, 2**63, MINIMA, dtype=np.uint64)
_MUL = _SEED.integers(0, 2**62, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _SEED.integers(0, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BANDS = MINIMA // BAND_ROWS
PLANES = BITS * MINIMA // 64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, an empty one none."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    words = hash_words(data, starts, ends)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= k:
        m = len(words) - k + 1
        grams = np.zeros(m, np.uint64)
        for j in range(k):
            grams += words[j : j + m] * _STEP[j]
        grams = mix64(grams)
    out = []
    for i in range(n):
        c, at = int(counts[i]), int(first[i])
        if c >= k:
            out.append(np.unique(grams[at : at + c - k + 1]))
        elif c:
            short = (words[at : at + c] * _STEP[:c]).sum(dtype=np.uint64) + np.uint64(c)
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (from the full minima) and the low bits of the minima, packed by bit plane."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        part = items[at : at + 2048]
        np.minimum(low, ((part[:, None] ^ _XOR) * _MUL).min(axis=0), out=low)
    low = mix64(low)
    grouped = low.reshape(BANDS, BAND_ROWS)
    bands = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP[9]
    for j in range(BAND_ROWS):
        bands = mix64(bands ^ grouped[:, j])
    planes = np.concatenate([np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for b in range(BITS)])
    return bands.view(np.int64), planes.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def _sign(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for lo, hi in slices(offsets):
            ids, sizes, h1, h2, bits, bands = batch.column(0).slice(lo, hi - lo), [], [], [], [], []
            for items in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                sizes.append(len(items))
                h1.append(mix64(items + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64) if len(items) else 0)
                h2.append(mix64(items ^ _XOR[0]).sum(dtype=np.uint64).astype(np.int64) if len(items) else 0)
                b, p = signature(items) if len(items) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                bands.append(b)
                bits.append(p)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], schema=_SIGNED)
    give_back()


def linked(a: np.ndarray, b: np.ndarray, percent: int = LINK) -> bool:
    """Whether two sorted sets share at least ``percent`` of their union."""
    small, big = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(big):
        return False
    at = np.searchsorted(big, small)
    at[at == len(big)] = 0
    common = int((big[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def estimate(matches, bits: int = BITS, minima: int = MINIMA):
    """Similarity from the number of equal b-bit values: chance collisions are taken out."""
    chance = 1.0 / (1 << bits)
    return (matches / float(minima) - chance) / (1.0 - chance)


def _matches(x: str, y: str):
    words = MINIMA // 64
    differ = [reduce(lambda p, q: p.bitwiseOR(q), [F.col(x)[b * words + w].bitwiseXOR(F.col(y)[b * words + w]) for b in range(BITS)]) for w in range(words)]
    return F.lit(MINIMA) - reduce(lambda p, q: p + q, [F.bit_count(d) for d in differ])


def _runs(*keys: np.ndarray):
    """Ranges of equal keys in sorted arrays."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(change).tolist() + [len(keys[0])]
    return zip(at[:-1], at[1:], strict=True)


def _groups(batches, keys: int):
    """Tables of the rows with equal leading ``keys`` columns, from batches sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        for lo, hi in _runs(*cols):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _check_pivots(batches):
    """Rows (pivot, part, role, doc_id, text), the pivot's own text first: links of the pivot."""
    for group in _groups(batches, 2):
        pivot = group.column(0)[0].as_py()
        own, found = None, []
        for piece in group.to_batches():
            data, offsets = utf8(piece.column(4))
            roles, ids = piece.column(2).to_pylist(), piece.column(3).to_pylist()
            for lo, hi in slices(offsets):
                for i, items in enumerate(shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), lo):
                    if roles[i] == 0:
                        own = items if own is None else own
                    elif own is not None and linked(own, items):
                        found.append(ids[i])
        yield pa.RecordBatch.from_arrays([pa.array([pivot] * len(found), pa.int64()), pa.array(found, pa.int64())], schema=_EDGE)
    give_back()


def _near(bits: np.ndarray, bands: np.ndarray, comp: np.ndarray, side: np.ndarray, key: int, least: float):
    """Pairs (i, j), i < j, of a bucket that may link: other components, estimate high enough, and this bucket is the
    first one that they share. If both sides of a block pair are present, only pairs across them."""
    words = MINIMA // 64
    n = len(bits)
    for lo in range(0, n, 128):
        hi = min(n, lo + 128)
        differ = np.zeros((hi - lo, n, words), np.uint64)
        for b in range(BITS):
            differ |= bits[lo:hi, None, b * words : (b + 1) * words] ^ bits[None, :, b * words : (b + 1) * words]
        close = estimate(MINIMA - np.bitwise_count(differ).sum(axis=2)) >= least
        close &= comp[lo:hi, None] != comp[None, :]
        close &= np.arange(lo, hi)[:, None] < np.arange(n)[None, :]
        if side.min() != side.max():
            close &= side[lo:hi, None] != side[None, :]
        i, j = np.nonzero(close)
        if len(i):
            same = bands[i + lo] == bands[j]
            at = same.argmax(axis=1)
            first = same.any(axis=1) & (bands[i + lo, at] == key)
            yield from zip((i[first] + lo).tolist(), j[first].tolist(), strict=True)


def _matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


_NEED = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("doc_id", pa.int64()), ("comp", pa.int64()), ("side", pa.int32())])


def _screen(batches):
    """Rows (key, i, j, doc_id, comp, side, bits, bands): those that may link to a row of another component."""
    least = LINK / 100 - SLACK
    for group in _groups(batches, 3):
        comp, side = group.column(4).to_numpy(), group.column(5).to_numpy()
        need = np.zeros(len(comp), bool)
        if comp.min() != comp.max():
            bits, bands = _matrix(group.column(6), PLANES).view(np.uint64), _matrix(group.column(7), BANDS)
            for i, j in _near(bits, bands, comp, side, group.column(0)[0].as_py(), least):
                need[[i, j]] = True
        if need.any():
            yield from group.select(range(6)).filter(pa.array(need)).cast(_NEED).combine_chunks().to_batches()


def _check_blocks(batches):
    """Rows (key, i, j, doc_id, comp, side, text): links between components that the block holds, none twice."""
    least = LINK / 100 - SLACK
    for group in _groups(batches, 3):
        ids, comp, side = group.column(3).to_numpy(), group.column(4).to_numpy(), group.column(5).to_numpy()
        sets: list[np.ndarray] = []
        for piece in group.to_batches():
            data, offsets = utf8(piece.column(6))
            for lo, hi in slices(offsets):
                sets += shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        signed = [signature(s) for s in sets]
        bands, bits = np.array([x[0] for x in signed]), np.array([x[1] for x in signed]).view(np.uint64)
        root = {int(c): int(c) for c in comp}

        def find(x, root=root):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for i, j in _near(bits, bands, comp, side, group.column(0)[0].as_py(), least):
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b and linked(sets[i], sets[j]):
                root[max(a, b)] = min(a, b)
                found.append((int(ids[i]), int(ids[j])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=_EDGE)
    give_back()


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, ...) with the texts; unwanted texts are not shuffled if the wanted ids are few."""
    return docs.join(small_side(wanted), "doc_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs without white space after lower-casing A-Z; a document's set are its distinct five-word
    shingles (all words of a shorter one). Documents link if they share 75 percent of their union at least.

    1. Each task signs its texts. Equal sets (two 64-bit sums) are one class from here on, whatever their number.
    2. Bands of the full minima give buckets. Each class in a bucket is compared with the bucket's smallest class:
       first by the estimate from b-bit values, then on full sets. This merges large groups in linear work.
    3. Buckets that still hold several components are compared in blocks by their packed values. Only rows with a
       possible partner in another component are checked on full sets, and pairs that are already joined are skipped.
    4. Components of all links are found with joins; each row looks up the component of its set.

    Null or empty texts have no set: n_shingles 0, linked with nothing. Rows without doc_id cannot be named by
    others: component_id null, kept true. Rows that share a doc_id are one node. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(docs.mapInArrow(_sign, "doc_id long, n_shingles long, h1 long, h2 long, bits array<long>, bands array<long>"))
    named = signed.filter("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    reps = cut(named.join(classes, ["h1", "h2", "doc_id"]).select("doc_id", "bits", "bands").dropDuplicates(["doc_id"]))

    rows = reps.select(F.explode("bands").alias("key"), "doc_id")
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    members = cut(rows.join(buckets, "key"))
    bits = reps.select("doc_id", "bits")
    pairs = members.filter("doc_id != pivot").select("pivot", "doc_id").distinct()
    pairs = pairs.join(bits, "doc_id").join(bits.select(F.col("doc_id").alias("pivot"), F.col("bits").alias("own")), "pivot")
    pairs = cut(pairs.filter(estimate(_matches("bits", "own")) >= LINK / 100 - SLACK).select("pivot", "doc_id"))
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PIVOT_SHARE).cast("int").alias("parts"))
    asked = pairs.join(sizes, "pivot").select("doc_id", "pivot", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), F.lit(1).alias("role"))
    own = sizes.select(F.col("pivot").alias("doc_id"), "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs, cut(asked.union(own))).select("pivot", "part", "role", "doc_id", "text")
    stars = texts.repartition(shuffled, "pivot", "part").sortWithinPartitions("pivot", "part", "role").mapInArrow(_check_pivots, "a long, b long")
    stars = cut(stars)

    comp = connected(stars)
    placed = members.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("key", "n", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    open_rows = placed.join(mixed, "key", "left_semi").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    open_rows = open_rows.withColumn("side", F.pmod(F.xxhash64("doc_id", F.lit(3)), "blocks").cast("int"))
    open_rows = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_rows = open_rows.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "doc_id", "comp", "side")
    blocks = open_rows.join(reps, "doc_id").select("key", "i", "j", "doc_id", "comp", "side", "bits", "bands")
    need = cut(blocks.repartition(shuffled, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_screen, "key long, i int, j int, doc_id long, comp long, side int"))
    full = _texts(docs, need).select("key", "i", "j", "doc_id", "comp", "side", "text")
    across = cut(full.repartition(shuffled, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_check_blocks, "a long, b long"))

    if across.count():  # on from the groups that the stars gave
        found = comp.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        comp = connected(found.union(across))
    sets = classes.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("h1", "h2", F.coalesce("component", "doc_id").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("h1")).alias("h1"), "h2").join(sets, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` plus _id: doc_id, or where that is null or has several texts, a number from 2^62 on made of its hash.

    Rows that repeat _id and text are dropped but for one. Where all doc_ids are different, nothing is moved."""
    text = F.col("text").cast("string")
    ids = docs.select(F.col("doc_id").cast("long").alias("_odd"), F.xxhash64(text).alias("h"))
    odd = ids.groupBy("_odd").agg(F.count("*").alias("n"), (F.col("_odd").isNull() | (F.min("h") != F.max("h"))).alias("_many")).filter("n > 1 or _odd is null")
    odd = cut(odd.select("_odd", "_many"))
    own = F.col("doc_id").cast("long")
    if odd.isEmpty():
        return docs.withColumn("_id", own)
    rows = docs.join(small_side(odd), own.eqNullSafe(F.col("_odd")), "left")
    made = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 62))
    rows = rows.withColumns({"_id": F.when(F.coalesce("_many", F.lit(False)), made).otherwise(own), "_h": F.xxhash64(text)})
    alone = rows.filter("_many is null")
    return alone.unionAll(rows.filter("_many is not null").dropDuplicates(["_id", "_h"])).select(*[F.col(f"`{c}`") for c in docs.columns], "_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the first of their group; columns stay as they are.

    Of rows that share doc_id and text one stays. Rows without doc_id, and rows whose doc_id has several texts, are
    documents of their own, which stay behind others of their group. Null and empty texts are in no group.
    """
    rows = _one_of_each(docs)
    gone = near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text")).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    gone = small_side(cut(gone))
    whole = rows.select("_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # its columns may have any names
    return whole.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
