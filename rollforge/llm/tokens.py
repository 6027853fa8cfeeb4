"""Exact ids of a word-ended BPE vocabulary, fast on natural text.

The vocabulary's own library gives the ids; most texts repeat their words, so ids are kept by white-space chunk. A
chunk that was not met before and has only common Latin characters is merged here in numpy, many chunks at once, by
the vocabulary's merge ranks. All other chunks go to the library. Both give the same ids (tests compare them).
"""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np
import regex
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
# The pre-tokeniser's pattern, as the vocabulary file states it.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Printable ASCII without "<" (it opens special tokens) and Latin letters whose lower case is one stable letter.
PLAIN = re.compile("[\x21-\x3b\x3d-\x7e¡-¬®-įı-ňŊ-ž]+")
#: Chunks and pieces that a worker remembers: about 100 bytes each, and up to twice as many chunks.
KEPT = 400_000
#: Longer chunks go to the library, whose work does not grow with the square of a word's length.
LONG = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordBpe:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str | None = None):
        self.path = path = vocabulary or default_vocabulary()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.made_by_rank = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = 19
        self.slot_keys, self.slot_ranks = self._slots(np.array([(vocab[a] << 17) | vocab[b] for a, b in pairs], np.int64))
        self.piece_ids: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """Loaded when a chunk first needs it."""
        return Tokenizer.from_file(self.path)

    def _slot_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing over the pairs: -1 where a slot is free; probes go on to the next slot."""
        table, ranks = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int32)
        for rank, (h, key) in enumerate(zip(self._slot_of(keys).tolist(), keys.tolist(), strict=True)):
            while table[h] >= 0:
                h += 1
            table[h], ranks[h] = key, rank
        return table, ranks

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; a very high one for pairs that never merge."""
        keys = (left.astype(np.int64) << 17) | right
        slot = self._slot_of(keys)
        found = self.slot_keys[slot]
        out = np.where(found == keys, self.slot_ranks[slot], np.int32(1 << 30))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] += 1
            found = self.slot_keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokenised pieces: in each step every piece merges its pair of lowest rank, leftmost first."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        i = 0
        while i < len(order):
            width = int(sizes[order[i]])
            limit = max(8, width + (width >> 2))
            j = min(int(np.searchsorted(sizes[order], limit, "right")), i + max(64, 400_000 // limit))
            rows = order[i:j]
            i = j
            self._merge_rows(rows, [pieces[r] for r in rows.tolist()], sizes[rows], out)
        return out

    def _merge_rows(self, rows: np.ndarray, pieces: list[bytes], sizes: np.ndarray, out: list[bytes]) -> None:
        """ids[j] and rank[j] hold, for all pieces at once, the j-th id and the rank of its pair with the next one."""
        n, width, far = len(rows), int(sizes.max()), np.int32(1 << 30)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        inside = np.arange(width)[None, :] < sizes[:, None]
        first = np.full((n, width + 1), -1, np.int32)
        first[:, :width][inside] = self.inner[flat]
        first[np.arange(n), sizes - 1] = self.final[flat[np.cumsum(sizes) - 1]]
        ids = np.ascontiguousarray(first.T)
        rank = np.full((width + 1, n), far, np.int32)
        both = np.ascontiguousarray(inside.T)[1:]
        rank[: width - 1][both] = self._rank(ids[: width - 1][both], ids[1:width][both])
        length, who = sizes.copy(), rows
        while True:
            lowest, best = rank[0].copy(), np.zeros(len(who), np.int32)
            for j in range(1, width):
                less = rank[j] < lowest
                np.copyto(lowest, rank[j], where=less)
                best[less] = j
            live = lowest < far
            here = np.flatnonzero(live)
            if len(here) < 0.7 * len(live) or not len(here):
                done = np.flatnonzero(~live)
                block, stride = np.ascontiguousarray(ids[:, done].T).astype("<u4").tobytes(), 4 * (width + 1)
                for k, (row, size) in enumerate(zip(who[done].tolist(), length[done].tolist(), strict=True)):
                    out[row] = block[k * stride : k * stride + 4 * size]
                if not len(here):
                    return
                width = int(length[here].max())
                ids, rank, length, who = ids[: width + 1, here], rank[: width + 1, here], length[here], who[here]
                lowest, best, here = lowest[here], best[here], np.arange(len(here))
            else:
                best[~live] = width
            b = best[here]
            made = self.made_by_rank[lowest[here]]
            for j in range(width):
                after = best < j
                np.copyto(ids[j], ids[j + 1], where=after)
                np.copyto(rank[j], rank[j + 1], where=after)
            ids[b, here] = made
            length[here] -= 1
            left = b > 0
            h, k = here[left], b[left]
            rank[k - 1, h] = self._rank(ids[k - 1, h], made[left])
            more = b + 1 < length[here]
            h, k = here[more], b[more]
            rank[b[~more], here[~more]] = far
            rank[k, h] = self._rank(made[more], ids[k + 1, h])

    def _learn(self, chunks: list[str]) -> None:
        if len(self.piece_ids) > KEPT:
            self.piece_ids = {}
        ids, known, is_plain = self.piece_ids, self.known, PLAIN.fullmatch
        words, mixed, hard = [], [], []
        for chunk in chunks:
            if len(chunk) > LONG or not is_plain(chunk):
                hard.append(chunk)
            else:  # letters alone are one piece
                (words if chunk.isalpha() else mixed).append(chunk)
        low = [w.lower() for w in words]
        pieces = [PIECES.findall(c.lower()) for c in mixed]
        fresh = list(set().union(low, *pieces).difference(ids))
        ids.update(zip(fresh, self.merged([p.encode() for p in fresh]), strict=True))
        known.update(zip(words, map(ids.__getitem__, low), strict=True))
        known.update((c, b"".join([ids[p] for p in found])) for c, found in zip(mixed, pieces, strict=True))
        if hard:
            for chunk, coded in zip(hard, self.library.encode_batch(hard, add_special_tokens=False), strict=True):
                known[chunk] = np.array(coded.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > KEPT:
            self.older, self.known = self.known, {"": b""}
        known, older = self.known, self.older
        new: set[str] = set()
        for chunks in split:
            new.update(set(chunks).difference(known))
        fresh = []
        for chunk in new:
            kept = older.get(chunk)
            if kept is None:
                fresh.append(chunk)
            else:
                known[chunk] = kept
        if fresh:
            self._learn(fresh)
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


_MADE: dict[str, WordBpe] = {}


def word_bpe(vocabulary: str | None = None) -> WordBpe:
    """One encoder for each vocabulary and Python worker."""
    key = vocabulary or default_vocabulary()
    if key not in _MADE:
        _MADE[key] = WordBpe(key)
    return _MADE[key]
