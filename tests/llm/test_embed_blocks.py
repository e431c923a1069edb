"""Blocks of embedding buckets against all pairs, without Spark."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from noticelake.llm import embed_lsh


def _vectors(seed: int, groups: int, each: int, dim: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.standard_normal((groups, dim)), each, axis=0) + 0.2 * rng.standard_normal((groups * each, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def _rows(x: np.ndarray, first: int, blocks: int) -> list[tuple]:
    keys = embed_lsh.bucket_keys(x)
    out = []
    for node in range(len(x)):
        side = node % blocks
        for key in keys[node].tolist():
            out += [(key, min(side, o), max(side, o), first + node, side, 1 + node % 3, x[node].tolist()) for o in range(blocks)]
    return out


def _batches(rows: list[tuple], size: int):
    names = ["key", "i", "j", "node", "side", "copies", "unit"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
    rows = sorted(rows)
    for lo in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[lo : lo + size]], t) for c, t in enumerate(types)], names=names)


def test_blocks_count_each_link_once_and_span_the_components():
    wide, narrow = _vectors(1, 9, 7, 16), _vectors(2, 5, 4, 8)
    for blocks in (1, 3):
        for size in (13, 5000):
            rows = _rows(wide, 0, blocks) + _rows(narrow, 1000, blocks)
            links, edges = Counter(), set()
            for batch in embed_lsh._compare(_batches(rows, size)):
                for row in batch.to_pylist():
                    links[row["node"]] += row["links"]
                    edges.add((row["node"], row["other"]))
            want, low = Counter(), {}
            for x, first in ((wide, 0), (narrow, 1000)):
                same = (embed_lsh.bucket_keys(x)[:, None] == embed_lsh.bucket_keys(x)[None]).any(axis=2)
                near = (x @ x.T >= embed_lsh.COSINE) & same & ~np.eye(len(x), dtype=bool)
                for i, j in zip(*np.nonzero(near), strict=True):
                    want[first + int(i)] += 1 + int(j) % 3
                reach = near | np.eye(len(x), dtype=bool)
                for _ in range(8):
                    reach = (reach.astype(int) @ reach.astype(int)) > 0
                low.update({first + i: first + int(reach[i].argmax()) for i in range(len(x))})
            assert sum(want.values()) > 50
            assert links == want
            got = {n: n for n in low}
            for _ in range(len(got)):
                for a, b in edges:
                    got[a] = got[b] = min(got[a], got[b])
            assert got == low


def test_collision_of_lengths_and_lone_rows_give_nothing():
    rows = [(5, 0, 0, 1, 0, 1, [1.0, 0.0]), (5, 0, 0, 2, 0, 1, [1.0, 0.0, 0.0]), (6, 0, 0, 3, 0, 1, [1.0, 0.0])]
    assert [b.num_rows for b in embed_lsh._compare(_batches(rows, 2))] == []
    assert list(embed_lsh._compare(iter([]))) == []
