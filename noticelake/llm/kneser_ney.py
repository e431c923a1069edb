"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted arrays that workers map into memory."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import LOWER, cut, hash_words, mix64, slices, utf8, word_spans
from noticelake.session import scratch_dir, ship_package

RANGE_TOKENS = 3_000_000  # training tokens whose word pairs one task merges
HELD = 3_000_000  # different entries that a counting task holds before it hands them on
END = np.uint64(0x5E9D_0F7E_0D0C_0B0A)  # stands for the end of a text among word hashes


# ---- arrays in the shared folder ---------------------------------------------------------------


def _place(root: str, name: str):
    uri = f"file://{root[5:]}" if root.startswith("file:/") and not root.startswith("file://") else root
    where, path = pafs.FileSystem.from_uri(uri)
    return where, f"{path}/{name}"


def write_array(root: str, name: str, values: np.ndarray) -> None:
    """One array as one file. It appears under its name at once, so a task that runs twice does no harm."""
    where, path = _place(root, name)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    where.move(own, path)


_MAPPED: dict[tuple[str, str], np.ndarray] = {}


def mapped(root: str, name: str, dtype) -> np.ndarray:
    """The array, mapped into memory; from a folder that is no mounted file system, through an unnamed local file."""
    if len(_MAPPED) > 4000 or (_MAPPED and next(iter(_MAPPED))[0] != root):
        _MAPPED.clear()
    if (root, name) not in _MAPPED:
        where, path = _place(root, name)
        info = where.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.size == 0:
            _MAPPED[root, name] = np.zeros(0, dtype)
        elif isinstance(where, pafs.LocalFileSystem):
            _MAPPED[root, name] = np.memmap(path, dtype, "r")
        else:
            with tempfile.TemporaryFile() as own, where.open_input_stream(path) as stream:
                while block := stream.read(1 << 24):
                    own.write(block)
                own.flush()
                _MAPPED[root, name] = np.memmap(own, dtype, "r")
    return _MAPPED[root, name]


# ---- counting ------------------------------------------------------------------------------------


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


class _Counter:
    """Counts of 64-bit keys, merged now and then; ``drain`` hands on what is held."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, key: np.ndarray, n: np.ndarray) -> bool:
        self.keys.append(key)
        self.counts.append(n.astype(np.int64))
        self.held += len(key)
        if self.held > HELD:
            key, n = _merged(self.keys, self.counts)
            self.keys, self.counts, self.held = [key], [n], len(key)
        return self.held > HELD // 2

    def drain(self):
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = _merged(self.keys, self.counts)
        self.__init__()
        return out


_BLOB = "shard long, keys binary, counts binary"


def _blobs(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray, dtype) -> pa.RecordBatch:
    """One row per shard; ``shard`` is in order."""
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(shard)) if len(shard) else at
    own, n = keys.astype(keys.dtype, copy=False), counts.astype(dtype)
    pieces = [(int(shard[a]), own[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(at, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pieces], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["shard", "keys", "counts"])


def _tokens(column: pa.Array):
    """For slices of the texts: first row, rows, hashes of the words, row of each word, tokens of each row."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, rows = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, hash_words(part, starts, ends), rows, np.bincount(rows, minlength=hi - lo) + 1


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all workers need."""

    root: str
    bases: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first id of each vocabulary shard, then V
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # first context id of each range of pairs
    splits: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # shards of the range: more for a frequent context
    tokens: int = 0
    texts: int = 0
    pair_discounts: tuple = (0.0, 0.0, 0.0)
    word_discounts: tuple = (0.0, 0.0, 0.0)
    kinds: int = 0  # different pairs
    spare: float = 1.0  # share of the uniform distribution in the lowest order

    @property
    def words(self) -> int:
        return int(self.bases[-1])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of hashes that are in order; -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        n = len(self.bases) - 1
        lows = np.array([((s << 32) + n - 1) // n << 32 for s in range(n)], dtype=np.uint64)
        at = np.append(np.searchsorted(hashes, lows), len(hashes))
        for s in range(n):
            if at[s] < at[s + 1] and self.bases[s] < self.bases[s + 1]:
                own, asked = mapped(self.root, f"words-{s}", np.uint64), hashes[at[s] : at[s + 1]]
                k = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                out[at[s] : at[s + 1]] = np.where(own[k] == asked, self.bases[s] + k, -1)
        return out

    def by_id(self, ids: np.ndarray, name: str, dtype) -> np.ndarray:
        """Values of a vocabulary array for ids in order; 0 for id -1."""
        out = np.zeros(len(ids), np.int64)
        at = np.searchsorted(ids, self.bases)
        for s in range(len(self.bases) - 1):
            if at[s] < at[s + 1]:
                out[at[s] : at[s + 1]] = mapped(self.root, f"{name}-{s}", dtype)[ids[at[s] : at[s + 1]] - self.bases[s]]
        return out

    def shards(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The shard of each pair: by its context, and by its word too where the context is a frequent one."""
        first = np.cumsum(self.splits) - self.splits
        place = np.searchsorted(self.cuts, context, side="right") - 1
        return first[place] + (mix64(word.astype(np.uint64)) % self.splits[place].astype(np.uint64)).astype(np.int64)


def _sequence(model: Model, hashes: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens, text after text with their ends; the ids before them; and the row of each."""
    distinct, where = np.unique(np.append(hashes, END), return_inverse=True)
    ids = model.ids(distinct)[where]
    token = np.full(int(sizes.sum()), ids[-1], np.int64)
    token[np.arange(len(hashes)) + rows] = ids[:-1]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(sizes) - sizes] = model.words  # the start of a text has the first id that no word has
    return token, before, np.repeat(np.arange(len(sizes)), sizes)


def _count_words(shards: int):
    def run(batches):
        held = _Counter()

        def out():
            keys, n = held.drain()
            return _blobs(((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32), keys, n, np.int64)

        for batch in batches:
            for lo, hi, hashes, _, _ in _tokens(batch.column(0)):
                keys, n = np.unique(hashes, return_counts=True)
                full = held.add(np.append(keys, END), np.append(n, hi - lo))
                if full:
                    yield out()
        yield out()

    return run


def _vocabulary(root: str, range_tokens: int):
    def run(table):
        shard = table.column("shard")[0].as_py()
        keys, n = _merged([np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()], [np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist()])
        write_array(root, f"words-{shard}", keys)
        write_array(root, f"counts-{shard}", n)
        hot = n > range_tokens
        group = np.cumsum(np.where(hot, 0, n)) // range_tokens
        change = np.concatenate([[True], (group[1:] != group[:-1]) | hot[1:] | hot[:-1]])
        cuts = np.flatnonzero(change)
        splits = np.where(hot[cuts], -(-n[cuts] // range_tokens), 1)
        return pa.table({"shard": [shard], "words": [len(keys)], "tokens": [int(n.sum())], "cuts": [cuts.tolist()], "splits": [splits.tolist()]}, schema=_VOCABULARY)

    return run


_VOCABULARY = pa.schema([("shard", pa.int64()), ("words", pa.int64()), ("tokens", pa.int64()), ("cuts", pa.list_(pa.int64())), ("splits", pa.list_(pa.int64()))])


def _count_pairs(model: Model):
    def run(batches):
        held = _Counter()

        def out():
            keys, n = held.drain()
            shard = model.shards((keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF))
            order = np.argsort(shard, kind="stable")
            return _blobs(shard[order], keys[order], n[order], np.uint32)

        for batch in batches:
            for _, _, hashes, rows, sizes in _tokens(batch.column(0)):
                token, before, _ = _sequence(model, hashes, rows, sizes)
                keys, n = np.unique((before.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64), return_counts=True)
                if held.add(keys, n):
                    yield out()
        yield out()

    return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal values, and which run each value is in."""
    first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    return np.flatnonzero(first), np.cumsum(first) - 1


_PAIRS = pa.schema([("shard", pa.int64()), ("ones", pa.list_(pa.int64())), ("keys", pa.binary()), ("counts", pa.binary())])


def _merge_pairs(model: Model):
    """Writes the pairs of a shard; returns its counts of counts (shard -1) and, for each vocabulary shard, words with
    the number of their different contexts here."""

    def run(table):
        shard = table.column("shard")[0].as_py()
        keys, n = _merged([np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()], [np.frombuffer(b, np.uint32).astype(np.int64) for b in table.column("counts").to_pylist()])
        write_array(model.root, f"pairs-{shard}", keys)
        write_array(model.root, f"pair_counts-{shard}", np.minimum(n, 2**32 - 1).astype(np.uint32))
        at, run_of = _runs(keys >> np.uint64(32))
        kinds = np.stack([np.bincount(run_of[n == 1], minlength=len(at)), np.bincount(run_of[n == 2], minlength=len(at)), np.bincount(run_of[n > 2], minlength=len(at))], axis=1)
        write_array(model.root, f"contexts-{shard}", (keys[at] >> np.uint64(32)).astype(np.uint32))
        write_array(model.root, f"context_kinds-{shard}", kinds.astype(np.uint32))
        words, contexts = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        blobs = _blobs(np.searchsorted(model.bases, words.astype(np.int64), side="right") - 1, words.astype(np.uint32), contexts, np.uint32)
        ones = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(n)]
        return pa.table([pa.array([-1, *blobs.column(0).to_pylist()], pa.int64()), pa.array([ones] + [None] * blobs.num_rows, pa.list_(pa.int64())), pa.array([b"", *blobs.column(1).to_pylist()], pa.binary()), pa.array([b"", *blobs.column(2).to_pylist()], pa.binary())], schema=_PAIRS)

    return run


def _continuations(model: Model):
    def run(table):
        shard = table.column("shard")[0].as_py()
        n = np.zeros(int(model.bases[shard + 1] - model.bases[shard]), np.int64)
        for keys, counts in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
            n[np.frombuffer(keys, np.uint32).astype(np.int64) - model.bases[shard]] += np.frombuffer(counts, np.uint32)
        write_array(model.root, f"continuations-{shard}", n.astype(np.uint32))
        return pa.table({"ones": [[int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n > 2).sum())]]}, schema=pa.schema([("ones", pa.list_(pa.int64()))]))

    return run


def discounts(ones: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (float(x) for x in ones[:4])
    if not n1:
        return 0.0, 0.0, 0.0
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.0), k) for d, k in zip(raw, (1.0, 2.0, 3.0), strict=True))


def train(docs: DataFrame, range_tokens: int = RANGE_TOKENS) -> Model:
    """A model of the texts of ``docs`` (text), in a folder beside the checkpoints.

    1. Tasks count words in blocks and hand on one row of arrays per shard of hashes; a shard's merged words, in order,
       are the vocabulary, a word's place in it is its id. Frequent words are summed before they are moved.
    2. Pairs of ids are counted likewise. A shard holds the pairs of a range of contexts with about ``range_tokens``
       tokens; a context with more is split over several shards, so no shard grows with the most frequent word.
    3. Each shard gives, per word, the number of its different contexts; these meet in the word's vocabulary shard.

    Only sizes, range limits and counts of counts come to the driver. No text, or only null texts: an empty model.
    """
    spark = docs.sparkSession
    ship_package(spark)
    root = scratch_dir(spark, "kneser-ney")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    shards = max(1, texts.rdd.getNumPartitions())
    counted = texts.mapInArrow(_count_words(shards), _BLOB)
    made = counted.groupBy("shard").applyInArrow(_vocabulary(root, range_tokens), "shard long, words long, tokens long, cuts array<long>, splits array<long>").collect()
    if not made:
        return Model(root)
    by = {r["shard"]: r for r in made}
    sizes = [by[s]["words"] if s in by else 0 for s in range(shards)]
    bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if bases[-1] >= 2**32 - 1:
        raise ValueError("the vocabulary needs 64-bit ids")
    total = texts.count()
    cuts = np.array([bases[s] + c for s in sorted(by) for c in by[s]["cuts"]] + [bases[-1]], np.int64)
    splits = np.array([k for s in sorted(by) for k in by[s]["splits"]] + [-(-total // range_tokens)], np.int64)
    model = Model(root, bases, cuts, splits, sum(r["tokens"] for r in made), total)
    pairs = texts.mapInArrow(_count_pairs(model), _BLOB)
    pairs = cut(pairs.groupBy("shard").applyInArrow(_merge_pairs(model), "shard long, ones array<long>, keys binary, counts binary"))
    ones = pairs.filter("shard < 0").select(F.array(*[F.sum(F.col("ones")[k]) for k in range(5)]).alias("n")).first()["n"]
    low = pairs.filter("shard >= 0").groupBy("shard").applyInArrow(_continuations(model), "ones array<long>")
    lows = low.select(F.array(*[F.sum(F.col("ones")[k]) for k in range(5)]).alias("n")).first()["n"]
    model.pair_discounts, model.word_discounts, model.kinds = discounts(ones), discounts(lows), ones[4]
    d = model.word_discounts
    model.spare = (d[0] * lows[0] + d[1] * lows[1] + d[2] * lows[4]) / model.kinds
    return model


# ---- scoring --------------------------------------------------------------------------------------


def _less(n: np.ndarray, d: tuple) -> np.ndarray:
    """Counts after their discounts; 0 stays."""
    return n - np.where(n == 0, 0.0, np.where(n == 1, d[0], np.where(n == 2, d[1], d[2])))


def _log_probabilities(model: Model, token: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token after the one before it, and its count as a single word."""
    words, word_at = np.unique(token, return_inverse=True)
    uniform = 1.0 / (model.words + 1)
    single = model.by_id(words, "counts", np.int64)
    low = np.full(len(words), uniform)
    if model.kinds:
        low = _less(model.by_id(words, "continuations", np.uint32).astype(float), model.word_discounts) / model.kinds + model.spare * uniform
    if not model.kinds:
        return np.log10(low)[word_at], single[word_at]
    contexts, context_at = np.unique(before, return_inverse=True)
    seen = model.by_id(contexts, "counts", np.int64).astype(float)
    seen[contexts == model.words] = model.texts
    first = np.cumsum(model.splits) - model.splits
    place = np.searchsorted(model.cuts, contexts, side="right") - 1
    kinds = np.zeros((len(contexts), 3))
    for r in np.unique(place[contexts >= 0]).tolist():
        mine = np.flatnonzero((place == r) & (contexts >= 0))
        for s in range(int(first[r]), int(first[r] + model.splits[r])):
            try:
                own = mapped(model.root, f"contexts-{s}", np.uint32)
            except FileNotFoundError:
                continue  # no pair fell into this shard
            k = np.minimum(np.searchsorted(own, contexts[mine].astype(np.uint32)), max(len(own) - 1, 0))
            if len(own):
                here = own[k] == contexts[mine]
                kinds[mine[here]] += mapped(model.root, f"context_kinds-{s}", np.uint32).reshape(-1, 3)[k[here]]
    known = seen > 0
    back = np.where(known, (kinds @ np.array(model.pair_discounts)) / np.maximum(seen, 1), 1.0)
    both = (token >= 0) & (before >= 0)
    keys, key_at = np.unique((before[both].astype(np.uint64) << np.uint64(32)) | token[both].astype(np.uint64), return_inverse=True)
    shard = model.shards((keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF))
    n = np.zeros(len(keys))
    order = np.argsort(shard, kind="stable")
    ends = np.flatnonzero(np.concatenate([shard[order][1:] != shard[order][:-1], [True]])) + 1 if len(keys) else []
    lo = 0
    for hi in ends:
        mine = order[lo:hi]
        lo = hi
        try:
            own = mapped(model.root, f"pairs-{shard[mine[0]]}", np.uint64)
        except FileNotFoundError:
            continue
        if len(own):
            k = np.minimum(np.searchsorted(own, keys[mine]), len(own) - 1)
            n[mine] = np.where(own[k] == keys[mine], mapped(model.root, f"pair_counts-{shard[mine[0]]}", np.uint32)[k], 0)
    high = np.zeros(len(token))
    high[both] = _less(n, model.pair_discounts)[key_at]
    p = high / np.maximum(seen, 1)[context_at] + back[context_at] * low[word_at]
    return np.log10(p), single[word_at]


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, base_score, score.

    Tokens are runs without white space, A-Z lower-cased, then one end. ``score`` is the log10 probability of the text:
    P(w|v) = (c(vw) - D) / c(v) + b(v) P(w), and P(w) = (contexts of w - D') / pairs + b' / (V + 1); an unknown word has
    the last term alone, behind an unknown word P(w) holds. ``base_score`` is the add-one unigram log10 probability. A
    null or empty text is its end alone. Repeated rows get equal results; other columns are ignored.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi, hashes, rows, sizes in _tokens(batch.column(1)):
                token, before, row = _sequence(model, hashes, rows, sizes)
                logs, single = _log_probabilities(model, token, before)
                base = np.log10((single + 1.0) / (model.tokens + model.words + 1.0))
                total = lambda x: np.bincount(row, weights=x, minlength=hi - lo)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(total(single > 0).astype(np.int64)), pa.array(total(base)), pa.array(total(logs))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
