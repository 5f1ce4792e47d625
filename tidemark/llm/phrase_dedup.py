"""Substring deduplication by repeated-phrase automata.

Removes each word covered by a window of ``window`` words whose words also start earlier (in a smaller doc_id, or
earlier in the document). Passages that may recur meet in shards (see ``windows``), those of a key over the whole corpus
in one, so a window that stands twice in a shard is confirmed to recur. A shard compiles its confirmed windows into an
Aho-Corasick automaton, and the passages of all documents stream through the automata of their shards, which locate
every occurrence; all but the first are hits. Words are compared as bytes.

Cases: null text has no words; a null doc_id counts as larger than all others; rows that repeat a doc_id come in the
order of their texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textnp, windows

PHRASE = 5
BITS = 6
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_symbols(column) -> tuple[np.ndarray, np.ndarray]:
    raw, at = textnp.utf8(column)
    hashes, offsets = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for lo, hi in textnp.slices(at):
        part = raw[at[lo] : at[hi]]
        starts, stops, rows = textnp.word_spans(part, at[lo : hi + 1] - at[lo])
        hashes.append(textnp.word_hashes(part, starts, stops))
        offsets.append(rows[1:] + offsets[-1][-1])
    return np.concatenate(hashes), np.concatenate(offsets)


def word_content(column) -> tuple[bytes, np.ndarray]:
    """The words of all rows, a space behind each, and where they begin."""
    raw, at = textnp.utf8(column)
    parts, cuts = [], [np.zeros(1, np.int64)]
    for lo, hi in textnp.slices(at):
        part, rows = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        joined, places = textnp.joined_words(part, rows, *textnp.word_spans(part, rows)[:2])
        parts.append(joined.tobytes())
        cuts.append(places[1:] + cuts[-1][-1])
    return b"".join(parts), np.concatenate(cuts)


def recurring(grams: np.ndarray, at: np.ndarray, reach: int, step: int) -> np.ndarray:
    """Places, one of each, at which windows begin that begin at several places of ``at``.

    A window is ``reach`` phrases, each ``step`` words behind the one before.
    """
    names = textnp.gram_hashes(textnp.mix(grams.astype(np.uint64) + np.uint64(1)), reach, step - 1)[at]
    while True:
        order = np.argsort(names, kind="stable")
        ranked, place = names[order], at[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        times = np.diff(np.r_[starts, len(ranked)])
        leader = np.repeat(place[starts], times)
        if all((grams[place + k * step] == grams[leader + k * step]).all() for k in range(reach)):
            return place[starts[times > 1]]
        _, names = np.unique(np.stack([grams[at + k * step] for k in range(reach)], axis=1), axis=0, return_inverse=True)  # two windows share a hash


def spelled(numbers: np.ndarray, digits: int) -> str:
    """Numbers as signs, ``digits`` each; those of one digit have signs of their own, and -1 has one that no key has.

    The automaton looks through a node's children one after another, so its signs are to be few: with a sign for each
    number its root had a child for every confirmed window.
    """
    signs = (numbers[:, None] >> (BITS * np.arange(digits)) & (1 << BITS) - 1) + (np.arange(digits) << BITS) + 1
    signs[numbers < 0] = (digits << BITS) + 1
    return signs.astype("<u4").tobytes().decode("utf-32-le")


def judge(raw: bytes, begin: np.ndarray, end: np.ndarray, counts: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """For each window of each piece whether it stands earlier. Pieces come by document and place.

    The automaton's symbols are those of phrases of ``step`` words, which divides the window. A text is streamed once for each place in a phrase at which a window may begin.
    """
    found = np.zeros(int(counts.sum()), bool)
    if not len(found):
        return found
    step = max(k for k in range(1, PHRASE + 1) if window % k == 0)
    reach = window // step
    joined = np.frombuffer(raw, np.uint8)
    bounds = np.r_[0, np.flatnonzero(joined == 0x20) + 1]
    words, _ = textnp.word_numbers(joined, bounds)
    grams = textnp.gram_numbers(words, step)
    lo, hi = np.searchsorted(bounds, begin), np.searchsorted(bounds, end)
    starts = windows.spread(lo, counts)
    window_at = np.zeros(len(words), np.int64)
    window_at[starts] = np.arange(len(found))
    confirmed = recurring(grams, starts, reach, step)
    if not len(confirmed):
        return found
    digits = max(1, -(-int(grams.max()).bit_length() // BITS))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    size = reach * digits
    keys = spelled(grams[confirmed[:, None] + step * np.arange(reach)].ravel(), digits)
    for k in range(len(confirmed)):
        automaton.add_word(keys[k * size : (k + 1) * size], k)
    automaton.make_automaton()
    which, where = [], []
    for shift in range(step):
        length = np.maximum(0, -(-(hi - lo - step + 1 - shift) // step))
        piece = np.repeat(np.arange(len(lo)), length)
        place = lo[piece] + shift + step * windows.spread(np.zeros(len(lo), np.int64), length)
        ends = np.cumsum(length)
        stream = np.insert(grams[place], ends, -1)  # no match goes over the end of a piece
        place = np.insert(place, ends, 0)
        hits = np.array(list(automaton.iter(spelled(stream, digits))), np.int64).reshape(-1, 2)
        which.append(hits[:, 1])
        where.append(window_at[place[hits[:, 0] // digits - reach + 1]])
    which, where = np.concatenate(which), np.concatenate(where)
    first = np.full(len(confirmed), len(found))
    np.minimum.at(first, which, where)
    found[where[where != first[which]]] = True
    return found


def _finish(ids, text, symbols, offsets, covered) -> pa.Table:
    total = np.r_[0, np.cumsum(covered)]
    removed = np.diff(total[offsets])
    keep = (~covered).tolist()
    raw, at = textnp.utf8(text)
    whole, at, sha = raw.tobytes(), at.tolist(), []
    for k, a in enumerate(offsets[:-1].tolist()):
        words = whole[at[k] : at[k + 1]].split()
        if removed[k]:
            words = [w for w, stays in zip(words, keep[a : a + len(words)], strict=True) if stays]
        sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.table({"doc_id": ids.cast(pa.int64()), "n_words": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def dedup(docs: DataFrame, window: int = 20, gram: int = 6, hot: int = windows.HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    plan = windows.Plan(window, gram, True, False, word_symbols, word_content, judge, _finish, SCHEMA, hot)
    return windows.run(docs, plan)
