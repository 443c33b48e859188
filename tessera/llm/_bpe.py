"""Byte-pair merges of many words at once.

The merge table is that of a tokenizer's file; each round merges, in every word
that has one, the adjacent pair of the lowest rank.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(2**31 - 1)


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.inner = np.array([vocab[c] for c in _byte_chars()], np.uint32)
        self.last = np.array([vocab[c + end] for c in _byte_chars()], np.uint32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.levels = []
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        ranks = np.arange(len(keys), dtype=np.int32)
        bits, times = 19, 0x9E3779B1
        while len(keys):  # keys that meet another in a slot go to the next level
            slot = self._slot(keys, times, bits)
            _, first = np.unique(slot, return_index=True)
            has, rank = np.full(1 << bits, 0xFFFFFFFF, np.uint32), np.full(1 << bits, _NONE)
            has[slot[first]], rank[slot[first]] = keys[first], ranks[first]
            self.levels.append((times, bits, has, rank))
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, ranks, bits, times = keys[rest], ranks[rest], 16, (times * 0x85EBCA6B | 1) & 0xFFFFFFFF

    @staticmethod
    def _slot(keys: np.ndarray, times: int, bits: int) -> np.ndarray:
        return (keys * np.uint32(times)) >> np.uint32(32 - bits)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), _NONE)
        for times, bits, has, rank in self.levels:
            slot = self._slot(keys, times, bits)
            hit = has[slot] == keys
            out[hit] = rank[slot[hit]]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (not empty, one unit of the tokenizer's splitting) as little-endian uint32."""
        out: list[bytes] = []
        for at in range(0, len(words), 20_000):
            out += self._some(words[at : at + 20_000])
        return out

    def _some(self, words: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        ends = np.cumsum(size)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            starts = np.cumsum(size) - size
            rank = np.full(len(sym), _NONE)
            rank[:-1] = self.ranks(sym[:-1] << np.uint32(16) | sym[1:])
            rank[starts + size - 1] = _NONE
            least = np.minimum.reduceat(rank, starts)
            more = least < _NONE
            owner = np.repeat(np.arange(len(size)), size)
            if not more.all():
                keep = more[owner]
                done.append((word[~more], size[~more], sym[~keep]))
                word, least, sym, rank = word[more], least[more], sym[keep], rank[keep]
                size = size[more]
                if not len(word):
                    break
                owner = np.repeat(np.arange(len(size)), size)
            join = rank == least[owner]
            twice = np.flatnonzero(join[1:] & join[:-1])
            for i in twice.tolist():  # of a run of equal symbols every other pair
                if join[i]:
                    join[i + 1] = False
            sym[join] = self.merged[rank[join]]
            gone = np.zeros(len(sym), bool)
            gone[1:] = join[:-1]
            sym = sym[~gone]
            size = size - np.bincount(owner[join], minlength=len(size))
        ids = [b""] * len(words)
        for w, n, s in done:
            raw, start = s.astype("<u4").tobytes(), 0
            for k, m in zip(w.tolist(), (4 * n).tolist(), strict=True):
                ids[k] = raw[start : start + m]
                start += m
        return ids
