"""Token counts of a byte-level BPE vocabulary, by rank-synchronous merging of ragged numpy arrays.

Texts are cut into pre-tokens by the vocabulary's pattern, with the character classes of the library (``classes``). The distinct pre-tokens of a batch that the task has not
met before are held as one ragged array and merged together (``MergeTable.encode``); the symbols that survive are
counted. Pre-tokens of over ``merges.LEAF`` bytes are merged as trees of leaves. A special token's string inside a
text is one token, as by default in the library.

Cases: null text is empty and has no tokens; a null doc_id stays null; repeated rows are counted each; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tokenizers import Regex, pre_tokenizers

from . import merges, textnp
from .classes import Cutter, stand_ins

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
MEMORY = 400_000


@cache
def library_classes() -> dict[int, str]:
    """Where the tokenizers library's classes differ."""

    def members(pattern: str, text: str) -> str:
        return "".join(part for part, _ in pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True).pre_tokenize_str(text))

    return stand_ins(members)


class Counter:
    """Counts tokens of texts; remembers the counts of up to ``MEMORY`` distinct pre-tokens."""

    def __init__(self, path: str, instead: dict[int, str]):
        self.table = merges.MergeTable(path)
        self.find = Cutter(PATTERN, instead)
        specials = sorted(self.table.special, key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, specials))).split if specials else lambda t: [t]
        self.marks = specials
        self.known: dict[str, int] = {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) > MEMORY:
            self.known.clear()
        new = list(tokens)
        raw, at = textnp.utf8(pa.array(new, pa.large_string()))
        sizes = np.diff(at)
        short = np.flatnonzero(sizes <= merges.LEAF)
        for lo, hi in textnp.slices(np.r_[0, np.cumsum(sizes[short])], 1 << 20):
            rows = short[lo:hi]
            ends = np.r_[0, np.cumsum(sizes[rows])]
            part = raw if len(rows) == len(new) else np.concatenate([raw[at[r] : at[r + 1]] for r in rows])
            got = np.diff(self.table.encode(self.table.symbols(part, ends), ends)[1]).tolist()
            self.known.update(zip([new[r] for r in rows], got, strict=True))
        for r in np.flatnonzero(sizes > merges.LEAF):
            part = raw[at[r] : at[r + 1]]
            self.known[new[r]] = len(self.table.encode_long(self.table.symbols(part, np.array([0, len(part)]))))

    def count(self, texts: list[str]) -> list[int]:
        rows, extra = [], []
        for text in texts:
            parts = self.split(text) if any(m in text for m in self.marks) else [text]
            extra.append(len(parts) - 1)
            rows.append(self.find(text) if len(parts) == 1 else [t for p in parts for t in self.find(p)])
        fresh = set().union(*rows).difference(self.known) if rows else set()
        if fresh:
            if len(self.known) + len(fresh) > MEMORY:
                self.known.clear()
                fresh = set().union(*rows)
            self.learn(fresh)
        size = self.known.__getitem__
        return [sum(map(size, row)) + more for row, more in zip(rows, extra, strict=True)]


_counters: dict[str, Counter] = {}


def _counter(path: str, instead: dict[int, str]) -> Counter:
    """One for each worker, without what another task has remembered."""
    if path not in _counters:
        _counters[path] = Counter(path, instead)
    _counters[path].known.clear()
    return _counters[path]


def counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row."""

    instead = library_classes()

    def run(batches):
        counter = _counter(path, instead)
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            _, at = textnp.utf8(column)
            for lo, hi in textnp.slices(at, 2 << 20):
                n = counter.count([t or "" for t in column.slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(at[lo : hi + 1]), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
