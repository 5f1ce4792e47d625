"""Suffix-array deduplication with a logarithmic family of indexes.

Removes each byte covered by a string of ``window`` bytes that also starts in a document with a smaller doc_id.
Strings that may recur meet in shards (see ``windows``). In a shard, texts come in batches of ascending doc_id. A new
batch gets a suffix array, by prefix doubling up to the window; it is merge-scanned against each existing level for
strings already there, and the suffixes that no level has become a level. Levels are positions in their text; those of
about equal size merge, so sizes grow geometrically and there are logarithmically many.

Equal runs are combined before they are sent and again in the shard: each distinct run is judged once, with its smallest
document, and the other documents that have the run inherit that it stands earlier. Of the distinct runs' strings those
whose hash no other has stand nowhere else (equal strings have equal hashes), so they get no place in suffix arrays: the
index compares the others on their bytes.

Cases: null text is empty; a null doc_id counts as larger than all others; rows that repeat a doc_id are one document
to each other; texts shorter than the window lose nothing; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textnp, windows

BATCH = 1 << 17
MARKS = 1 << 22
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_ranks(text: np.ndarray, window: int) -> np.ndarray:
    """For each position a rank of the ``window`` bytes from it: in order, and equal exactly for equal bytes."""
    depth = min(8, window)
    _, rank = np.unique(eights(text)[: len(text)] >> np.uint64(64 - 8 * depth), return_inverse=True)
    while depth < window:
        step, most = min(depth, window - depth), len(text) + 1
        both = rank * most
        both[: len(text) - step] += rank[step:] + 1
        _, rank = np.unique(both, return_inverse=True)
        depth += step
    return rank


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number in their order; a text ends in zeros."""
    return np.ndarray(len(text) + 1, ">u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))


class Level:
    """A text and the positions of strings in it, sorted by the strings, which are distinct."""

    def __init__(self, text: np.ndarray, at: np.ndarray, window: int):
        self.text, self.at, self.window = text, at, window
        self.eight = eights(text)
        self.first = self.eight[at].astype(np.uint64)

    def places(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each of other's strings how many of these come before it, and whether it is among these.

        Both are sorted: the first bytes are merged, and only where they agree the strings are compared on.
        """
        lo, hi = np.searchsorted(self.first, other.first), np.searchsorted(self.first, other.first, "right")
        todo = np.flatnonzero(lo < hi)
        low, high = lo.copy(), hi.copy()
        while len(todo):
            middle = (low[todo] + high[todo]) // 2
            less, _ = self._compare(self.at[middle], other, other.at[todo])
            low[todo] = np.where(less, middle + 1, low[todo])
            high[todo] = np.where(less, high[todo], middle)
            todo = todo[low[todo] < high[todo]]
        same = np.zeros(len(lo), bool)
        todo = np.flatnonzero(low < hi)
        same[todo] = self._compare(self.at[low[todo]], other, other.at[todo])[1]
        return low, same

    def _compare(self, mine: np.ndarray, other: Level, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether strings are less than, and whether they are equal to, others that have the same first bytes."""
        less, open_ = np.zeros(len(mine), bool), np.ones(len(mine), bool)
        for k in [*range(8, self.window - 7, 8), self.window - 8] if self.window > 8 else []:
            live = np.flatnonzero(open_)
            a, b = self.eight[mine[live] + k], other.eight[theirs[live] + k]
            less[live] = a < b
            open_[live] = a == b
        return less, open_

    def merged(self, other: Level) -> Level:
        """Both levels in one; they have no string in common."""
        at = np.insert(self.at, self.places(other)[0], other.at + len(self.text))
        return Level(np.concatenate([self.text, other.text]), at, self.window)


class LevelIndex:
    """Levels of distinct strings, the newest and smallest last."""

    def __init__(self, window: int):
        self.window = window
        self.levels: list[Level] = []

    def add(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which strings, at sorted and distinct places of the text, a level has; the others become a level.

        It is merged with older ones while those are no more than twice as large.
        """
        new, hit = Level(text, at, self.window), np.zeros(len(at), bool)
        for level in self.levels:
            hit |= level.places(new)[1]
        if not hit.all():
            new = Level(text, at[~hit], self.window)
            while self.levels and len(self.levels[-1].at) <= 2 * len(new.at):
                new = self.levels.pop().merged(new)
            self.levels.append(new)
        return hit


def shared(text: np.ndarray, begin: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """For each string of each piece whether another may be equal: false only where no other has its hash."""
    order = np.argsort(begin)
    at = windows.spread(begin[order], counts[order])
    hashes, room = np.empty(len(at), np.uint64), windows.room_for(window)
    for lo in range(0, len(text) - window + 1, windows.STEP):
        a, b = np.searchsorted(at, [lo, lo + windows.STEP])
        hashes[a:b] = windows.gram_keys(text[lo : lo + windows.STEP + window - 1], window, room)[at[a:b] - lo]
    ranked = np.sort(hashes)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    marks = np.zeros(MARKS, bool)  # most are told apart here, the others by search
    marks[twice & np.uint64(MARKS - 1)] = True
    found = np.flatnonzero(marks[hashes & np.uint64(MARKS - 1)])
    found = found[twice[np.minimum(np.searchsorted(twice, hashes[found]), len(twice) - 1)] == hashes[found]]
    out = np.zeros(len(at), bool)
    out[windows.spread((np.cumsum(counts) - counts)[order], counts[order])[found]] = True
    return out


def judge(raw: bytes, begin: np.ndarray, end: np.ndarray, counts: np.ndarray, docs: np.ndarray, window: int, batch: int = BATCH) -> np.ndarray:
    """For each string of each piece whether a piece of a smaller document has it. Pieces come by document."""
    _, first = windows.equal_spans(raw, begin, end)
    start = np.cumsum(counts) - counts
    text, alike = np.frombuffer(raw, np.uint8), first == np.arange(len(first))
    mine, copies = np.flatnonzero(alike), np.flatnonzero(~alike)
    found = np.zeros(int(counts.sum()), bool)
    found[windows.spread(start[copies], counts[copies])] = True
    chosen = np.flatnonzero(shared(text, begin[mine], counts[mine], window))
    piece = np.repeat(mine, counts[mine])[chosen]
    place = windows.spread(start[mine], counts[mine])[chosen]  # in found
    doc, index, lo = docs[piece], LevelIndex(window), 0
    while lo < len(chosen):
        hi = int(np.searchsorted(doc, doc[min(lo + batch, len(doc)) - 1], "right"))  # a document stays in one batch
        fresh = np.r_[True, piece[lo + 1 : hi] != piece[lo : hi - 1]]
        part = piece[lo:hi][fresh]
        size = end[part] - begin[part]
        own = text[windows.spread(begin[part], size)]
        at = (np.cumsum(size) - size - start[part])[np.cumsum(fresh) - 1] + place[lo:hi]
        rank = suffix_ranks(own, window)[at]
        suffixes = np.argsort(rank, kind="stable")  # ties stay in order of doc_id
        ranked = rank[suffixes]
        fresh = np.r_[True, ranked[1:] != ranked[:-1]]
        group = np.cumsum(fresh) - 1
        smallest = doc[lo:hi][suffixes][fresh]
        hit = np.empty(len(at), bool)
        hit[suffixes] = index.add(own, at[suffixes][fresh])[group] | (smallest[group] < doc[lo:hi][suffixes])
        found[place[lo:hi]] = hit
        lo = hi
    same = copies[docs[copies] == docs[first[copies]]]  # rows that repeat a doc_id
    found[windows.spread(start[same], counts[same])] = found[windows.spread(start[first[same]], counts[same])]
    return found


def _finish(ids, text, raw, offsets, covered) -> pa.Table:
    rises, falls, begins = covered.copy(), covered.copy(), offsets[:-1][offsets[:-1] < len(covered)]
    rises[1:] &= ~covered[:-1]
    rises[begins] |= covered[begins]
    falls[:-1] &= ~covered[1:] | rises[1:]
    first, last = np.flatnonzero(rises), np.flatnonzero(falls)
    spans = np.searchsorted(first, offsets)
    n_spans, n_removed = np.diff(spans), np.diff(np.r_[0, np.cumsum(last - first + 1)][spans])
    kept = ~covered
    sha = []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        sha.append(hashlib.sha256(raw[a:b][kept[a:b]] if n_removed[k] else raw[a:b]).hexdigest())
    return pa.table({"doc_id": ids.cast(pa.int64()), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def byte_content(column) -> tuple[bytes, None]:
    return textnp.utf8(column)[0].tobytes(), None


def dedup(docs: DataFrame, window: int = 50, gram: int = 20, hot: int = windows.HOT, batch: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    plan = windows.Plan(window, gram, False, True, textnp.utf8, byte_content, partial(judge, batch=batch), _finish, SCHEMA, hot)
    return windows.run(docs, plan)


def _finish_text(ids, text, raw, offsets, covered) -> pa.Table:
    kept = [raw[a:b][~covered[a:b]].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.table({"doc_id": ids.cast(pa.int64()), "kept": pa.array(kept, pa.string())})


def kept_texts(docs: DataFrame, window: int = 50, gram: int = 20) -> DataFrame:
    """doc_id and the text that is left; a character of which a part was removed becomes U+FFFD."""
    plan = windows.Plan(window, gram, False, True, textnp.utf8, byte_content, judge, _finish_text, "doc_id long, kept string")
    return windows.run(docs, plan)
