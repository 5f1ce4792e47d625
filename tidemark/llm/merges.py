"""Byte-pair merging on numpy arrays.

``MergeTable.encode`` is rank-synchronous: a batch of symbol sequences is one ragged array, and in every step each
sequence's lowest-rank pair is merged at all its places at once, until no sequence has a pair left.
``MergeTable.encode_long`` is tree concatenation: leaves of a long sequence are encoded together, then neighbours are
joined pairwise; a window of symbols around the join is encoded anew and grows until its outermost tokens are those
that the two sides have there. Each adjacent pair of tokens of the result then stands in a correct encoding, which
makes the whole correct: an encoding is the right one just when every two adjacent tokens encode to themselves.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.int64(1) << 40
LEAF = 1024


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + self.suffix] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        bits = 19
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full((1 << bits) + 64, -1, np.int64)
        self.slot_rank = np.full((1 << bits) + 64, NONE, np.int64)
        self.depth = 1
        rank = order[np.r_[True, key[order][1:] != key[order][:-1]]]  # of a pair that is listed twice the first counts
        at = self._slot(key[rank])
        self.depth = 0
        while len(rank):  # each free slot takes the first pair that wants it; the others try the next slot
            self.depth += 1
            free = np.flatnonzero(self.slot_key[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slot_key[at[put]], self.slot_rank[at[put]] = key[rank[put]], rank[put]
            rest = np.ones(len(rank), bool)
            rest[put] = False
            rank, at = rank[rest], at[rest] + 1
        self.merged = merged
        self.symbols_of = None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the table has no such pair."""
        key = left.astype(np.int64) << 20 | right
        at = self._slot(key)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_rank[at], NONE)
        rest = np.flatnonzero((found != key) & (found >= 0))
        for step in range(1, self.depth):
            if not len(rest):
                break
            found = self.slot_key[at[rest] + step]
            hit = found == key[rest]
            out[rest[hit]] = self.slot_rank[at[rest[hit]] + step]
            rest = rest[~hit & (found >= 0)]
        return out

    def symbols(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First symbols of sequences of bytes; the last byte of each gets the end-of-word form."""
        out = self.inner[raw]
        if self.suffix:
            last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
            out[last] = self.final[raw[last]]
        return out

    def encode(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all sequences and their offsets; long sequences are to go to ``encode_long``."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        sym, row = symbols.astype(np.int32), np.repeat(np.arange(n), sizes)
        done_sym, done_row = [], []
        rank = np.full(len(sym), NONE, np.int64)
        if len(sym) > 1:
            inner = np.flatnonzero(row[1:] == row[:-1])
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(sym)])
            live = least < NONE
            if not live.all():
                stay = np.repeat(live, counts)
                done_sym.append(sym[~stay])
                done_row.append(row[~stay])
                sym, row, rank = sym[stay], row[stay], rank[stay]
                least, counts = least[live], counts[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, counts))
            touching = np.flatnonzero(at[1:] == at[:-1] + 1)
            if len(touching):  # a pair of equal symbols overlaps itself: from the left, every other place
                fresh = np.r_[True, at[1:] != at[:-1] + 1]
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            sym, row, rank = sym[keep], row[keep], rank[keep]
            changed = np.zeros(len(sym), bool)
            changed[new] = True
            changed[new[new > 0] - 1] = True
            fix = np.flatnonzero(changed)
            rank[fix] = NONE
            fix = fix[fix < len(sym) - 1]
            fix = fix[row[fix] == row[fix + 1]]
            rank[fix] = self.ranks(sym[fix], sym[fix + 1])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        sym, row = np.concatenate(done_sym), np.concatenate(done_row)
        order = np.argsort(row, kind="stable")
        return sym[order], np.searchsorted(row[order], np.arange(n + 1))

    def sizes(self) -> np.ndarray:
        """How many first symbols each token spans."""
        if self.symbols_of is None:
            ends = len(self.suffix)
            self.symbols_of = np.array([max(1, len(t) - ends if ends and t.endswith(self.suffix) and len(t) > ends else len(t)) for t in self.tokens], np.int64)
        return self.symbols_of

    def encode_long(self, symbols: np.ndarray, leaf: int = LEAF) -> np.ndarray:
        """Tokens of one sequence of any length."""
        if len(symbols) <= leaf:
            return self.encode(symbols, np.array([0, len(symbols)]))[0]
        cuts = np.r_[np.arange(0, len(symbols), leaf), len(symbols)]
        tokens, at = self.encode(symbols, cuts)
        return self.join_all([tokens[at[i] : at[i + 1]] for i in range(len(cuts) - 1)], [symbols[cuts[i] : cuts[i + 1]] for i in range(len(cuts) - 1)])

    def join_all(self, nodes: list[np.ndarray], symbols: list[np.ndarray]) -> np.ndarray:
        """Encoding of neighbouring pieces from the pieces' own encodings, as a balanced tree of joins."""
        while len(nodes) > 1:
            pairs = range(0, len(nodes) - 1, 2)
            odd = len(nodes) % 2
            joined = [self._join(nodes[i], nodes[i + 1], symbols[i], symbols[i + 1]) for i in pairs]
            both = [np.concatenate(symbols[i : i + 2]) for i in pairs]
            nodes, symbols = joined + nodes[len(nodes) - odd :], both + symbols[len(symbols) - odd :]
        return nodes[0] if nodes else np.zeros(0, np.int32)

    def _join(self, left: np.ndarray, right: np.ndarray, left_symbols: np.ndarray, right_symbols: np.ndarray) -> np.ndarray:
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        size, k_left, k_right = self.sizes(), 4, 4
        while True:
            k_left, k_right = min(k_left, len(left)), min(k_right, len(right))
            a, b = int(size[left[len(left) - k_left :]].sum()), int(size[right[:k_right]].sum())
            window = np.concatenate([left_symbols[len(left_symbols) - a :], right_symbols[:b]])
            # at most a few windows are long; those are trees of their own, strictly smaller than this one
            whole = k_left == len(left) and k_right == len(right)
            again = self.encode(window, np.array([0, len(window)]))[0] if whole or len(window) <= 4 * LEAF else self.encode_long(window)
            good_left = k_left == len(left) or again[0] == left[len(left) - k_left]
            good_right = k_right == len(right) or again[-1] == right[k_right - 1]
            if good_left and good_right:
                return np.concatenate([left[: len(left) - k_left], again, right[k_right:]])
            k_left, k_right = (k_left if good_left else 2 * k_left), (k_right if good_right else 2 * k_right)
