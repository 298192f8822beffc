"""Byte-pair merges of many short strings at once, as array rounds."""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np

NO_RANK = np.iinfo(np.int32).max


class PairTable:
    """(left id, right id) -> (rank, merged id), a two-level hash in arrays."""

    def __init__(self, left, right, merged):
        self.shift = 20
        key = (np.asarray(left, np.uint64) << np.uint64(self.shift)) | np.asarray(right, np.uint64)
        self.merged = np.asarray(merged, np.int32)
        self.pairs = {int(k): i for i, k in enumerate(key)}
        order = np.arange(len(key))
        self.levels = []
        for bits in (21, 18, 18, 18):
            at = (key[order] * np.uint64(0x9E3779B97F4A7C15 + 2 * bits * (len(self.levels) + 1))) >> np.uint64(64 - bits)
            table = np.full(1 << bits, -1, np.int32)
            table[at] = order
            self.levels.append((bits, table))
            order = order[table[at] != order]
        self.key = np.append(key, np.uint64(2**64 - 1))
        assert not len(order), "pair table has unresolved collisions"

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(self.shift)) | right.astype(np.uint64)
        out = np.full(len(key), NO_RANK, np.int32)
        for n, (bits, table) in enumerate(self.levels):
            found = table[(key * np.uint64(0x9E3779B97F4A7C15 + 2 * bits * (n + 1))) >> np.uint64(64 - bits)]
            ok = self.key[found] == key
            out[ok] = found[ok]
        return out


def merge_all(sym: np.ndarray, lens: np.ndarray, table: PairTable) -> np.ndarray:
    """Number of tokens of each string; ``sym`` holds the strings' symbols one after the other.

    Each round takes, in every string, all places of its best-ranked pair, left to right. A merge
    only makes pairs of later rank (ranks are the order in which merges were learned), so this
    is the order of one merge at a time.
    """
    counts = lens.astype(np.int64).copy()
    word = np.repeat(np.arange(len(lens)), lens)
    sym = sym.astype(np.int32)
    while len(sym) > 1:
        rank = np.full(len(sym), NO_RANK, np.int32)
        same = word[1:] == word[:-1]
        rank[:-1][same] = table.rank(sym[:-1][same], sym[1:][same])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        best = np.minimum.reduceat(rank, first)
        n = np.diff(np.append(first, len(sym)))
        live = np.repeat(best != NO_RANK, n)
        if not live.any():
            break
        p = np.flatnonzero((rank == np.repeat(best, n)) & live)
        run = np.concatenate([[True], np.diff(p) != 1])
        start = np.maximum.accumulate(np.where(run, np.arange(len(p)), 0))
        p = p[(np.arange(len(p)) - start) % 2 == 0]
        np.subtract.at(counts, word[p], 1)
        sym[p] = table.merged[rank[p]]
        live[p + 1] = False
        sym, word = sym[live], word[live]
    return counts


def merge_one(sym: list[int], table: PairTable) -> list[int]:
    """One string by a heap of pairs: for strings so long that rounds would not pay."""
    nxt, prv, alive = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1)), [True] * len(sym)
    heap = []

    def push(i):
        j = nxt[i]
        if j < len(sym):
            r = table.pairs.get((sym[i] << table.shift) | sym[j])
            if r is not None:
                heapq.heappush(heap, (r, i, sym[i], sym[j]))

    for i in range(len(sym)):
        push(i)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i] if alive[i] else len(sym)
        if j >= len(sym) or sym[i] != a or sym[j] != b:
            continue
        sym[i], alive[j], nxt[i] = int(table.merged[r]), False, nxt[j]
        if nxt[i] < len(sym):
            prv[nxt[i]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    return [s for s, a in zip(sym, alive) if a]


@lru_cache
def byte_symbols() -> tuple[str, ...]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return tuple(out[b] for b in range(256))


@lru_cache
def load_json(path: str) -> tuple[np.ndarray, PairTable, tuple[str, ...]]:
    """Ids of the bytes, merges in order, special strings, of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    vocab = j["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
    table = PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], [vocab[a + b] for a, b in merges])
    made: dict[str, int] = {}
    for r, (a, b) in enumerate(merges):
        # ``merge_all`` relies on it: what a merge joins was made by earlier ones
        if max(made.get(a, -1), made.get(b, -1)) >= r:
            raise ValueError(f"merge {r} of {path} joins a piece that a later merge makes")
        made.setdefault(a + b, r)
    return np.array([vocab[c] for c in byte_symbols()], np.int32), table, tuple(t["content"] for t in j["added_tokens"])


# Classes of characters for the pre-tokenizer.
LETTER, ONE, R, V, L, E, NUMBER, OTHER, QUOTE, BLANK, WHITE, SEP, CONT = range(13)
#: Code points of White_Space in Unicode.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache
def char_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = WHITE
    for c, k in ((" ", BLANK), ("'", QUOTE), *((c, ONE) for c in "stmd"), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[ord(c)] = k
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each character at its first byte, CONT at the others."""
    table = char_classes()
    cls = table[data]
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        cls[high] = CONT
        lead = high[data[high] >= 0xC0]
        wide = np.append(data, np.zeros(3, np.uint8))
        b = [wide[lead + k].astype(np.int64) for k in range(4)]
        two, three, four = (((b[0] & 31) << 6) | (b[1] & 63)), (((b[0] & 15) << 12) | ((b[1] & 63) << 6) | (b[2] & 63)), (((b[0] & 7) << 18) | ((b[1] & 63) << 12) | ((b[2] & 63) << 6) | (b[3] & 63))
        cp = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))
        cls[lead] = table[np.minimum(cp, 0x10FFFF)]
    return cls
