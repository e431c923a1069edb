"""Packing of tokenised documents into training sequences: vector bin packing with a dot-product heuristic."""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import give_back
from noticelake.llm.encoding import encoder
from noticelake.session import ship_package

TOKENS = 2048  # most tokens of a sequence
SEGMENTS = 128  # most pieces of a sequence
LOSS = 2048  # most loss-bearing tokens of a sequence
END = 1  # id after each document
POOL = 256  # pieces that wait for a sequence in a task, of each group
POOLED = 4_096  # the same of all groups together
CACHE = 1_000_000  # encodings of pieces of text that a worker keeps, about 200 bytes each; fewer take more time, with the same result
STEP = 512  # rows of a batch that join the pool at once


@dataclass(slots=True)
class Piece:
    doc: object
    start: int
    ids: bytes  # little-endian unsigned 32-bit
    loss: int
    total: int
    length: int = field(init=False)

    def __post_init__(self):
        self.length = len(self.ids) // 4

    def split(self, at: int) -> tuple[Piece, Piece]:
        """The first ``at`` ids and the rest; prompt ids, which bear no loss, come first in a piece."""
        free = self.length - self.loss
        head = max(0, at - free)
        return Piece(self.doc, self.start, self.ids[: 4 * at], head, self.total), Piece(self.doc, self.start + at, self.ids[4 * at :], self.loss - head, self.total)


# ---- packing ----------------------------------------------------------------------------------


def fill(pool: list[Piece], tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS) -> tuple[list[Piece], list[Piece]]:
    """One sequence from the pool, and the pieces that are left.

    The piece with the largest dot product of its shares of the three limits and the room that is left goes in, as long
    as one fits. Then the largest piece is cut to fill the token gap. A sequence that meets another limit first is
    cut back to a power of two, so that it needs no padding.
    """
    n = np.array([p.length for p in pool], dtype=np.int64)
    bears = np.array([p.loss for p in pool], dtype=np.int64)
    here = np.ones(len(pool), bool)
    room = [tokens, segments, loss]
    long, bearing = n / tokens, bears / loss
    chosen: list[Piece] = []
    while room[1] > 0:
        fits = here & (n <= room[0]) & (bears <= room[2])
        if not fits.any():
            break
        value = np.where(fits, long * (room[0] / tokens) + (1 / segments) * (room[1] / segments) + bearing * (room[2] / loss), -1.0)
        k = int(value.argmax())
        chosen.append(pool[k])
        here[k] = False
        room = [room[0] - pool[k].length, room[1] - 1, room[2] - pool[k].loss]
    left = [p for p, h in zip(pool, here, strict=True) if h]
    if room[0] and room[1] and left:
        k = int(n[here].argmax())
        fit = min(room[0], left[k].length - left[k].loss + room[2])
        if 0 < fit < left[k].length:
            head, rest = left[k].split(fit)
            chosen.append(head)
            left[k] = rest
            room[0] -= fit
    total = tokens - room[0]
    if room[0] and total & (total - 1):
        over = total - (1 << (total.bit_length() - 1))
        while over:
            last = chosen.pop()
            if last.length > over:
                head, last = last.split(last.length - over)
                chosen.append(head)
            left.append(last)
            over -= last.length
    return chosen, left


def _pieces(doc, ids: bytes, prompt: int, tokens: int, loss: int):
    """Pieces of at most ``tokens`` ids and ``loss`` loss-bearing ids; the first ``prompt`` ids bear no loss."""
    total = len(ids) // 4
    rest = Piece(doc, 0, ids, max(0, total - prompt), total)
    while rest.length > tokens or rest.loss > loss:
        at = min(tokens, rest.length - rest.loss + loss)
        head, rest = rest.split(at)
        yield head
    yield rest


def _encoded(batch: pa.RecordBatch, path: str, end: bytes, cache: int):
    """(doc_id, ids and ``end`` as bytes, prompt) of each row; texts are encoded a slice at a time."""
    names, prompts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
    for lo, ids, n in encoder(path).encode(batch.column(1), cache):
        raw, at = ids.astype("<u4", copy=False).tobytes(), 0
        for k, stop in enumerate((4 * np.cumsum(n)).tolist(), lo):
            yield names[k], raw[at:stop] + end, int(prompts[k] or 0)
            at = stop


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _rows(sequences: list[tuple[int, list[Piece]]], with_ids: bool) -> pa.RecordBatch:
    rows = []
    for sequence, pieces in sequences:
        offset = 0
        for p in pieces:
            rows.append((p.doc, p.start, p.length, zlib.crc32(p.ids), p.total, sequence, offset))
            offset += p.length
    arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
    if with_ids:
        ids = [np.frombuffer(p.ids, dtype="<u4").astype(np.int64) for _, pieces in sequences for p in pieces]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.list_(pa.int64()))], names=[*_FIELDS, "ids"])
    return pa.RecordBatch.from_arrays(arrays, names=_FIELDS)


def pack_documents(
    docs: DataFrame, tokenizer: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, end: int = END, prompt: str | None = None, with_ids: bool = False, cache: int = CACHE, group: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked).

    ``docs`` has doc_id and text; ``tokenizer`` is the path of a byte-level vocabulary on every worker. Each document
    is its ids and then ``end``; null or empty text is ``end`` alone. ``prompt`` names a column with the number of
    leading ids that bear no loss (null: none). A sequence holds at most ``tokens`` ids, ``segments`` pieces and
    ``loss`` loss-bearing ids. Every id of every row, repeated rows too, lies in exactly one piece.

    Each task packs the rows of its partition, so nothing is shuffled and no document is looked at by two tasks. A task
    keeps a bounded pool of pieces. Its last sequences are cut to powers of two instead of padding them. Sequence ids
    hold the task's partition number, so a task that is run again gives the same rows. Other columns are ignored.

    ``group`` names a column, such as the language: a sequence then holds documents of one of its values (null is one).
    Each value has a pool in a task; with very many values the largest pools are emptied early, by sequences cut to powers
    of two.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        made = 0
        pools: dict[str, list[Piece]] = {}

        def last(pool):
            """A sequence of a pool that gets no more pieces."""
            total = sum(p.length for p in pool)
            return fill(pool, tokens if total >= tokens else 1 << (total.bit_length() - 1), segments, loss)

        for batch in batches:
            groups = iter(batch.column(3).to_pylist())
            rows = _encoded(batch, tokenizer, int(end).to_bytes(4, "little"), cache)
            while part := list(itertools.islice(rows, STEP)):
                done = []
                for (name, ids, free), value in zip(part, groups, strict=False):
                    pool = pools.setdefault(value, [])
                    for piece in _pieces(name, ids, free, tokens, loss):
                        if piece.length == tokens:
                            done.append((first + made, [piece]))
                            made += 1
                        else:
                            pool.append(piece)
                held = sum(map(len, pools.values()))
                for value, pool in sorted(pools.items(), key=lambda x: -len(x[1])):
                    while len(pool) > POOL or pool and held > POOLED:
                        before = len(pool)
                        chosen, pool = fill(pool, tokens, segments, loss) if before > POOL else last(pool)
                        held += len(pool) - before
                        done.append((first + made, chosen))
                        made += 1
                    pools[value] = pool
                pools = {value: pool for value, pool in pools.items() if pool}
                if done:
                    yield _rows(done, with_ids)
        done = []
        for pool in pools.values():
            while pool:
                chosen, pool = last(pool)
                done.append((first + made, chosen))
                made += 1
        if done:
            yield _rows(done, with_ids)
        give_back()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(prompt).cast("long") if prompt else F.lit(0).cast("long")).alias("prompt"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("group"))
    return own.mapInArrow(run, _OUT + (", ids array<long>" if with_ids else ""))
