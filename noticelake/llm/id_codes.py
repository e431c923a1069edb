"""Token ids in directly addressable codes: byte chunks in levels, continuation bitmaps and rank directories, in binary files.

A file holds whole documents in order. All numbers are little-endian, every section starts at a multiple of eight bytes:

    8 bytes       b"DACIDS01"
    3 x uint64    tokens, documents, levels
    levels x 4 x uint64   chunks of the level, place of its chunks, of its bitmap, of its rank directory
    documents x int64     doc_id (0 where null), then documents x uint8: 1 where null
    (documents + 1) x uint64   first token of each document in this file, and the number of tokens

Level 0 holds the low byte of every id, level 1 the next byte of the ids that have one, and so on. A level's bitmap has
a one for each chunk that goes on in the next level (the last level has none); its rank directory holds the number of ones
before every 512 bits. So token i is read with one byte a level, one directory entry and the bits since that entry.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm.common import cut, give_back
from noticelake.llm.encoding import encoder
from noticelake.session import scratch_dir, ship_package

MAGIC = b"DACIDS01"
END = 2  # id after each document
FILE_TOKENS = 4_000_000  # a file is closed after the document that reaches this number
RANK = 512  # bits for each entry of a rank directory
READ_TOKENS = 1_000_000  # tokens that a reader decodes at a time


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, bitmap) of each level; the last bitmap is empty, the others fill whole ranges of the rank directory."""
    levels = []
    rest = ids.astype(np.uint32, copy=False)
    while True:
        more = rest > 0xFF
        chunks = (rest & np.uint32(0xFF)).astype(np.uint8)
        if not more.any():
            levels.append((chunks, np.zeros(0, np.uint8)))
            return levels
        bits = np.packbits(more, bitorder="little")
        levels.append((chunks, np.concatenate([bits, np.zeros(-len(bits) % (RANK // 8), np.uint8)])))
        rest = rest[more] >> np.uint32(8)


def file_bytes(docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file of these documents; ``ids`` are theirs end to end."""
    levels = encode_levels(ids)
    head = 8 + 24 + 32 * len(levels)
    own = np.array([d or 0 for d in docs], "<i8").tobytes() + _padded(bytes(d is None for d in docs)) + np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()
    parts, table, at = [own], [], head + len(own)
    for chunks, bits in levels:
        ones = np.bitwise_count(bits.view("<u8")).reshape(-1, RANK // 64).sum(axis=1, dtype=np.uint64)
        rank = (np.cumsum(ones, dtype=np.uint64) - ones).astype("<u8")
        entry = [len(chunks)]
        for raw in (chunks.tobytes(), bits.tobytes(), rank.tobytes()):
            entry.append(at)
            parts.append(_padded(raw))
            at += len(parts[-1])
        table.append(entry)
    numbers = np.array([len(ids), len(docs), len(levels), *np.array(table).ravel()], "<u8")
    return b"".join([MAGIC, numbers.tobytes(), *parts])


class CodeFile:
    """A file, mapped into memory where its folder is mounted: ids of any places, a range or a document."""

    def __init__(self, raw):
        self.raw = np.frombuffer(raw, np.uint8)
        if self.raw[:8].tobytes() != MAGIC:
            raise ValueError("not a file of token ids")
        self.tokens, self.documents, levels = (int(x) for x in self._numbers(8, 3))
        at = 32 + 32 * levels
        self.doc_ids = self._numbers(at, self.documents, "<i8")
        at += 8 * self.documents
        self.nulls = self.raw[at : at + self.documents].astype(bool)
        at += self.documents + -self.documents % 8
        self.starts = self._numbers(at, self.documents + 1).astype(np.int64)
        self.levels = []
        for n, chunks, bits, rank in self._numbers(32, 4 * levels).reshape(-1, 4).astype(np.int64).tolist():
            words = (rank - bits) // 8
            self.levels.append((self.raw[chunks : chunks + n], self._numbers(bits, words), self._numbers(rank, words // (RANK // 64))))

    def _numbers(self, at: int, n: int, kind: str = "<u8") -> np.ndarray:
        return self.raw[at : at + 8 * n].view(kind)

    @staticmethod
    def _rank(level, at: np.ndarray) -> np.ndarray:
        """Ones of the level's bitmap before each place."""
        _, words, rank = level
        word, entry = at // 64, at // RANK
        whole = entry < len(rank)
        out = np.where(whole, rank[np.minimum(entry, len(rank) - 1)], 0).astype(np.int64)
        for step in range(RANK // 64):
            k = entry * (RANK // 64) + step
            some = (k <= word) & (k < len(words))
            bits = words[np.where(some, k, 0)]
            part = np.where(k == word, bits & ((np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1)), bits)
            out += np.where(some, np.bitwise_count(part), 0)
        if not whole.all():  # behind the last entry: all ones
            total = int(rank[-1]) + int(np.bitwise_count(words[-(RANK // 64) :]).sum())
            out[~whole] = total
        return out

    def at(self, places) -> np.ndarray:
        """Ids of single tokens, in any order: one byte a level, no block is decoded."""
        at = np.asarray(places, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.tokens):
            raise IndexError("no such token")
        out = np.zeros(len(at), np.uint32)
        left = np.arange(len(at))
        for shift, level in enumerate(self.levels):
            chunks, words, _ = level
            out[left] |= chunks[at].astype(np.uint32) << np.uint32(8 * shift)
            if not len(words) or not len(at):
                break
            more = (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            at, left = self._rank(level, at[more]), left[more]
        return out

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop``: one rank a level, then its chunks in a row."""
        out = np.zeros(stop - start, np.uint32)
        where = None
        for shift, level in enumerate(self.levels):
            chunks, words, _ = level
            part = chunks[start:stop].astype(np.uint32) << np.uint32(8 * shift)
            if where is None:
                out |= part
            else:
                out[where] |= part
            if not len(words) or start == stop:
                break
            low = start // 8
            bits = np.unpackbits(words.view(np.uint8)[low : -(-stop // 8)], bitorder="little")[start - 8 * low : stop - 8 * low]
            places = np.flatnonzero(bits)
            start = int(self._rank(level, np.array([start]))[0])
            stop = start + len(places)
            where = places if where is None else where[places]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))


# ---- files in the shared folder ----------------------------------------------------------------


def _place(path: str):
    return pafs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path)


def _store(folder: str, name: str, content: bytes) -> str:
    """Write a file that appears under its name at once; the name is new on each try, so a lost task leaves nothing half."""
    where, path = _place(folder)
    where.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}.dac"
    with where.open_output_stream(f"{path}/.{name}") as out:
        out.write(content)
    where.move(f"{path}/.{name}", f"{path}/{name}")
    return f"{folder}/{name}"


def open_codes(path: str) -> CodeFile:
    where, own = _place(path)
    if isinstance(where, pafs.LocalFileSystem):
        return CodeFile(np.memmap(own, np.uint8, "r"))
    with where.open_input_stream(own) as stream:
        return CodeFile(stream.read())


_FILES = "path string, part int, seq int, documents long, tokens long"


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; one row per file: path, part, seq, documents,
    tokens, first_token (tokens of all files before it).

    A document is the ids of its whole text and then ``end``; null or empty text is ``end`` alone. Rows with a null
    doc_id come first, rows that share a doc_id in the order of a hash of their text; each row is a document. Texts are
    range-partitioned by both, so repeated doc_ids do not meet in one task. A task writes its range as files of about
    ``file_tokens`` tokens; a document is never cut, so a longer one makes a longer file. The rows returned are
    checkpointed and name exactly the files that count: a file of a lost or repeated try is in none of them. No
    documents give no files.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or scratch_dir(spark, "token-ids")

    def run(batches):
        part = TaskContext.get().partitionId()
        names: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = seq = 0

        def close():
            nonlocal names, lengths, ids, held, seq
            path = _store(folder, f"part-{part:05d}-{seq:05d}", file_bytes(names, np.concatenate(lengths), np.concatenate(ids)))
            row = pa.RecordBatch.from_pylist([{"path": path, "part": part, "seq": seq, "documents": len(names), "tokens": held}], schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())]))
            names, lengths, ids, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            own = batch.column(0).to_pylist()
            for lo, flat, n in encoder(tokenizer).encode(batch.column(1)):
                stops = np.cumsum(n)
                with_end = np.insert(flat, stops, end)
                n, stops = n + 1, stops + np.arange(1, len(n) + 1)
                done = 0
                while done < len(n):
                    before = int(stops[done - 1]) if done else 0
                    upto = min(len(n), int(np.searchsorted(stops, before + file_tokens - held)) + 1)
                    names += own[lo + done : lo + upto]
                    lengths.append(n[done:upto])
                    ids.append(with_end[before : stops[upto - 1]])
                    held += int(stops[upto - 1]) - before
                    done = upto
                    if held >= file_tokens:
                        yield close()
        if names:
            yield close()
        give_back()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    own = own.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    files = cut(own.mapInArrow(run, _FILES))
    # one row per range partition goes to one task, then the files of a partition are summed on their own
    sums = files.groupBy("part").agg(F.sum("tokens").alias("all"))
    base = sums.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    files = files.join(base, "part")
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    return cut(files.select("path", "part", "seq", "documents", "tokens", (F.col("base") + inside).alias("first_token")))


def read_ids(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (and ids, if asked), read from the files.

    ``files`` is what ``write_ids`` returned. ``start`` counts the ids of all documents before it. ``ids_crc32`` is the
    unsigned crc32 of the ids as little-endian unsigned 32-bit integers. A task maps one file at a time and decodes
    bounded ranges of it.
    """
    ship_package(files.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])]

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = open_codes(path)
                lo = 0
                while lo < codes.documents:
                    hi = max(lo + 1, int(np.searchsorted(codes.starts, codes.starts[lo] + READ_TOKENS, side="right")) - 1)
                    begin, crcs, ids = int(codes.starts[lo]), [], []
                    if hi == lo + 1:  # may be one long document
                        crc = 0
                        for a in range(begin, int(codes.starts[hi]), READ_TOKENS):
                            crc = zlib.crc32(codes.span(a, min(a + READ_TOKENS, int(codes.starts[hi]))).astype("<u4").tobytes(), crc)
                        crcs = [crc]
                        ids = [codes.document(lo)] if with_ids else []
                    else:
                        flat = codes.span(begin, int(codes.starts[hi])).astype("<u4", copy=False)
                        raw = memoryview(flat.tobytes())
                        at = (4 * (codes.starts[lo : hi + 1] - begin)).tolist()
                        crcs = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                        ids = np.split(flat, codes.starts[lo + 1 : hi] - begin) if with_ids else []
                    starts = codes.starts[lo : hi + 1]
                    cols = [pa.array(codes.doc_ids[lo:hi], mask=codes.nulls[lo:hi]), pa.array(first + starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))
                    lo = hi
        give_back()

    spark = files.sparkSession
    dealt = files.select("path", "first_token").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def ids_at(files: DataFrame, places: DataFrame, step: int = FILE_TOKENS) -> DataFrame:
    """Rows (place, id) for each row of ``places`` (place: a token's number over all files), read by direct access.

    Places that are null or that no file holds are left out; repeated ones come as often as they are asked for. Places
    meet their file by an equality join on ranges of ``step`` tokens.
    """
    ship_package(files.sparkSession)

    def run(batches):
        for batch in batches:
            paths, firsts, asked = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            names = np.array(paths, object)
            for path in dict.fromkeys(paths):
                here = names == path
                ids = open_codes(path).at(asked[here] - firsts[here])
                yield pa.RecordBatch.from_arrays([pa.array(asked[here]), pa.array(ids.astype(np.int64))], names=["place", "id"])

    last = F.col("first_token") + F.col("tokens") - 1
    ranges = files.filter("tokens > 0").select("path", "first_token", last.alias("last"), F.explode(F.sequence(F.floor(F.col("first_token") / step), F.floor(last / step))).alias("range"))
    asked = places.select(F.col("place").cast("long").alias("place")).filter("place >= 0").withColumn("range", F.floor(F.col("place") / step))
    met = asked.join(ranges, "range").filter("place between first_token and last").select("path", "first_token", "place")
    return met.sortWithinPartitions("path").mapInArrow(run, "place long, id long")
