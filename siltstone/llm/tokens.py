"""Token ids of whole texts by a tokenizer file, with each distinct piece encoded once.

The tokenizer splits texts before it merges, so a text's ids are those of its pieces in a row.
Pieces are found in numpy, gathered by 64-bit hash within a batch, and looked up in a memo of
bounded size; only pieces the memo lacks reach the tokenizer, joined by its special token. Equal
hashes prove nothing: every piece is compared with the bytes its ids were made from, and one that
differs is encoded by itself. A long text goes through in blocks, cut where no piece is parted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from siltstone.llm.words import blocks, range_hashes, raw, same_ranges, word_ranges
from siltstone.llm.worker import held

#: Pieces that a worker remembers (about 50 bytes each) before it starts afresh.
MEMO_PIECES = 2_500_000
#: White space beyond ASCII may merge with its neighbours in the byte-level pattern.
_WIDE_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def encoder(path: str) -> "PieceEncoder":
    """The worker's encoder of this file; kept between tasks."""
    return held(("tokens", path), lambda: PieceEncoder(path))


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # their strings in a text are ordinary text
        self.marked = Tokenizer.from_file(path)
        added = sorted(self.marked.get_added_tokens_decoder().items())
        self.mark_id, self.mark = added[-1][0], added[-1][1].content
        self.byte_level = self.plain.normalizer is None
        self.dtype = np.uint16 if self.plain.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(0, self.dtype)
        # The bytes of each remembered piece.
        self.text = np.zeros(0, np.uint8)
        self.text_at = np.zeros(0, np.int64)
        self.text_size = np.zeros(0, np.int32)

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, of = word_ranges(data, bounds)
        if not self.byte_level:
            return starts, ends, of
        # Byte level: a word takes one space before it; any other white space before a word is a
        # piece of its own, and so is the run before that; a run that ends a text is one piece.
        flag = np.zeros(len(data), bool)
        gap = np.zeros(len(starts), np.int64)
        if len(starts):
            gap[1:] = ends[:-1]
            firsts = of[:-1][of[1:] > of[:-1]]
            gap[firsts] = bounds[:-1][of[1:] > of[:-1]]
            before = starts - gap
            spaced = (before > 0) & (data[starts - 1] == 0x20)
            flag[starts - spaced] = True
            flag[(starts - 1)[(before > 0) & ~spaced]] = True
            flag[gap[before > 1]] = True
        full = bounds[1:] > bounds[:-1]
        tail = np.where(of[1:] > of[:-1], ends[np.maximum(of[1:] - 1, 0)] if len(ends) else 0, bounds[:-1])
        flag[tail[full & (tail < bounds[1:])]] = True
        starts = np.flatnonzero(flag)
        return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, bounds)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these pieces in a row, and the number of each one's."""
        odd = np.array([b"<|" in p for p in pieces])
        sizes = np.zeros(len(pieces), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(pieces)
        clear = np.flatnonzero(~odd)
        for at in range(0, len(clear), 4096):
            some = clear[at : at + 4096]
            got = self.marked.encode_batch_fast([self.mark.join([pieces[i].decode() for i in some])], add_special_tokens=False)[0]
            flat = np.array(got.ids, np.int64)
            cuts = np.flatnonzero(flat == self.mark_id)
            if len(cuts) != len(some) - 1:
                raise ValueError("the tokenizer did not keep the marks between pieces")
            sizes[some] = np.diff(np.concatenate([[-1], cuts, [len(flat)]])) - 1
            whole, to = flat[flat != self.mark_id].astype(self.dtype), np.cumsum(sizes[some])
            for i, b in zip(some, to):
                parts[i] = whole[b - sizes[i] : b]
        for i in np.flatnonzero(odd):
            parts[i] = np.array(self.plain.encode(pieces[i].decode(), add_special_tokens=False).ids, self.dtype)
            sizes[i] = len(parts[i])
        return np.concatenate(parts) if parts else np.zeros(0, self.dtype), sizes

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Remembers pieces of ascending new keys."""
        flat, sizes = self._encoded(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        # Both key lists are sorted: merge them in place of sorting all again.
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, len(self.pool) + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, where, sizes)
        self.text_at = np.insert(self.text_at, where, len(self.text) + np.cumsum(lengths) - lengths)
        self.text_size = np.insert(self.text_size, where, lengths)
        self.pool = np.concatenate([self.pool, flat])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(pieces), np.uint8)])

    def _slice(self, arr: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = raw(arr)
        if len(self.keys) > MEMO_PIECES:
            self._clear()
        starts, ends, of = self._pieces(data, bounds)
        lengths = ends - starts
        keys, first, where = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            flat = data.tobytes()
            self._learn(keys[new], [flat[starts[i] : ends[i]] for i in first[new]])
            at = np.searchsorted(self.keys, keys)
        if len(keys):
            at = at[where]
            source, size = self.at[at], self.size[at].astype(np.int64)
            true = self.text_size[at] == lengths
            true[true] = same_ranges(data, starts[true], self.text, self.text_at[at[true]], lengths[true])
            pool = self.pool
            if not true.all():  # another piece has this hash
                others = np.flatnonzero(~true)
                more, size[others] = self._encoded([data[starts[i] : ends[i]].tobytes() for i in others])
                source[others] = len(pool) + np.cumsum(size[others]) - size[others]
                pool = np.concatenate([pool, more])
        else:
            source, size, pool = np.zeros(0, np.int64), np.zeros(0, np.int64), self.pool
        # Each text's ids are followed by its end id, a piece of its own.
        source = np.insert(source, of[1:], len(pool))
        size = np.insert(size, of[1:], 1)
        pool = np.append(pool, self.dtype(end_id))
        done = np.cumsum(size)
        ids = pool[np.repeat(source - (done - size), size) + np.arange(done[-1] if len(done) else 0)]
        return ids, np.append(0, done[of[1:] + np.arange(len(arr))])

    def _exact(self, part: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice, those of texts with wide white space by the tokenizer itself."""
        ids, bounds = self._slice(part, end_id)
        if self.byte_level:
            data, _ = raw(part)
            texts = part.to_pylist() if len(data) and data.max() >= 0x80 else []
            texts = [t.decode() if isinstance(t, bytes) else t for t in texts]
            odd = {i: t for i, t in enumerate(texts) if t and not t.isascii() and _WIDE_SPACE.search(t)}
            if odd:
                rows = np.split(ids, bounds[1:-1])
                for i, text in odd.items():
                    rows[i] = np.array([*self.plain.encode(text, add_special_tokens=False).ids, end_id], self.dtype)
                ids, bounds = np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))
        return ids, bounds

    def encode(self, arr: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of the array: first row, all ids in a row, and the n+1 bounds of the rows' ids."""
        begun: list[np.ndarray] = []
        for at, part, more in blocks(arr, 3 << 20):
            ids, bounds = self._exact(part, end_id)
            if more:
                begun.append(ids[:-1])
                continue
            if begun:
                ids = np.concatenate([*begun, ids])
                bounds, begun = np.array([0, len(ids)]), []
            yield at, ids, bounds
