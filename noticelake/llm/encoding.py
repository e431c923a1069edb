"""Token ids of text batches with a byte-level vocabulary: pieces between spaces are looked up, new ones encoded together."""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa

from noticelake.llm.common import slices, utf8

PIECES = 1_000_000  # encodings that a worker keeps, and ids of them; new ones beyond either serve one slice, with the same result
MOST_IDS = 8_000_000
JOINED = 1 << 16  # bytes of new pieces that are encoded in one call

_SPACE_RUN = re.compile(r" (?!\S)")
_BEFORE = np.zeros(256, dtype=bool)  # bytes behind a space that may begin more white space
_BEFORE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_GRAPH = np.zeros(256, dtype=bool)  # ASCII characters that are no white space
_GRAPH[33:127] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = _GRAPH & ~_LETTER
_SIGN[48:58] = False


class Encoder:
    """Ids as the tokenizer gives them for whole texts without added tokens.

    The byte-level vocabulary never joins a character with the single space behind it, so a text is cut before its
    spaces and each different piece is encoded once. If the vocabulary splits words by the usual byte-level pattern, which
    ends a run of letters at a sign and any run at a line end, a text is cut between ASCII letters and signs and before
    line ends as well. Texts in which more white space or the end follows a space, and those that spell an added token,
    are encoded as a whole. The bytes of a token are the characters of its name, which tells where the ids of joined
    pieces part; if the lengths do not add up, the pieces are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(names.values(), default=-1) + 1, np.int64)
        for name, i in names.items():
            self.size[i] = len(name)
        rules = json.loads(self.tokenizer.to_str())
        self.fine = rules["normalizer"] is None and (rules["pre_tokenizer"] or {}).get("type") == "ByteLevel" and bool(rules["pre_tokenizer"].get("use_regex", True))
        self.added = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.slots: dict[bytes, int] = {}
        self.starts, self.lengths, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.held = 0

    def _one_by_one(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, end to end, and the number of ids of each."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that all begin with a space, or with a line end if all end in a character that is no white space."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = []
        for lo, hi in slices(np.concatenate([[0], np.cumsum(sizes)]), JOINED):
            ids = np.asarray(self.tokenizer.encode_batch_fast([b"".join(pieces[lo:hi]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends, marks = np.cumsum(self.size[ids]), np.cumsum(sizes[lo:hi])
            at = np.searchsorted(ends, marks)
            if not len(ends) or ends[-1] != marks[-1] or not np.array_equal(ends[np.minimum(at, len(ends) - 1)], marks):
                out.append(self._one_by_one(pieces[lo:hi]))
            else:
                out.append((ids, np.diff(at + 1, prepend=0)))
        ids, lengths = zip(*out, strict=True) if out else ([np.zeros(0, np.uint32)], [np.zeros(0, np.int64)])
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, pieces: list[bytes]) -> None:
        spaced, lines, heads = [], [], []
        for p in pieces:
            (spaced if p[0] == 32 else lines if p[0] == 10 and len(p) > 1 and _GRAPH[p[1]] and _GRAPH[p[-1]] and self.fine else heads).append(p)
        for some, (ids, lengths) in ((spaced, self._joined(spaced)), (lines, self._joined(lines)), (heads, self._one_by_one(heads))):
            n = len(self.slots)
            while n + len(some) > len(self.starts):
                self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
            while self.held + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, self.ids])
            self.slots.update(zip(some, range(n, n + len(some)), strict=True))
            self.starts[n : n + len(some)] = self.held + np.cumsum(lengths) - lengths
            self.lengths[n : n + len(some)] = lengths
            self.ids[self.held : self.held + len(ids)] = ids
            self.held += len(ids)

    def _keep(self, most: int) -> None:
        """Forget the encodings learnt last, so that ``most`` are left, and no more than ``MOST_IDS`` of their ids."""
        n = min(most, len(self.slots), int(np.searchsorted((self.starts + self.lengths)[: len(self.slots)], MOST_IDS, side="right")))
        for p in list(itertools.islice(reversed(self.slots), len(self.slots) - n)):
            del self.slots[p]
        self.held = int(self.starts[n - 1] + self.lengths[n - 1]) if n else 0

    def _cut(self, raw: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, end to end, and the number of ids of each row; no row holds a space before white space or an
        added token."""
        edge = raw == 32
        if self.fine:
            edge[1:] |= (_LETTER[raw[:-1]] & _SIGN[raw[1:]]) | (_GRAPH[raw[:-1]] & (raw[1:] == 10))
        edge[at[:-1][at[:-1] < len(raw)]] = True
        first = np.flatnonzero(edge).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, np.int32(len(raw)))), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._learn([p for p in names if p not in self.slots])
        slot = np.fromiter(map(self.slots.__getitem__, names), np.int64, len(names))[index]
        starts, lengths = self.starts[slot], self.lengths[slot]
        ends = np.cumsum(lengths)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]
        if len(self.slots) > most or self.held > MOST_IDS:
            self._keep(most)
        row_ends = np.concatenate([[0], ends])[np.searchsorted(first, at)]
        return ids, np.diff(row_ends)

    def encode(self, texts: pa.Array, most: int = PIECES):
        """(row, ids end to end, number of ids of each row) of slices of rows in order; null is empty. ``most`` encodings
        are kept."""
        data, offsets = utf8(texts)
        for lo, hi in slices(offsets, 1 << 22):
            raw, at = np.ascontiguousarray(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
            if not len(raw):
                yield lo, np.zeros(0, np.uint32), np.zeros(hi - lo, np.int64)
                continue
            space = np.flatnonzero(raw == 32)
            after = np.append(raw[1:], np.uint8(32))[space]
            odd = _BEFORE[after]
            odd |= np.isin(space + 1, at)  # a space at the end of a row
            rows = np.unique(np.searchsorted(at, space[odd], side="right") - 1)
            whole = [r for r in rows.tolist() if _SPACE_RUN.search(raw[at[r] : at[r + 1]].tobytes().decode())]
            text = raw.tobytes()
            if any(token in text for token in self.added):
                whole = sorted({*whole, *(r for r in range(hi - lo) if any(token in text[at[r] : at[r + 1]] for token in self.added))})
            if not whole:
                yield lo, *self._cut(raw, at, most)
                continue
            keep = np.ones(hi - lo, bool)
            keep[whole] = False
            sizes = np.where(keep, np.diff(at), 0)
            ids, counts = self._cut(raw[np.repeat(keep, np.diff(at))], np.concatenate([[0], np.cumsum(sizes)]), most)
            alone, lengths = self._one_by_one([raw[at[r] : at[r + 1]].tobytes() for r in whole])
            parts, done = [], 0
            ends = np.cumsum(counts)
            for r, own in zip(whole, np.split(alone, np.cumsum(lengths)[:-1]), strict=True):
                parts += [ids[done : ends[r]], own]
                done = ends[r]
            counts[whole] = lengths
            yield lo, np.concatenate([*parts, ids[done:]]), counts


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
