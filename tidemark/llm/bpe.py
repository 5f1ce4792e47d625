"""BPE encoding and decoding by tree concatenation.

Texts are cut into words by the vocabulary's pattern; distinct words are merged in batches. A text of over ``LONG``
characters, with or without spaces, is not left to one task: it is cut into leaves, which are encoded in parallel as
rows of their own. A word longer than a leaf goes over several leaves, and the join of two of them re-encodes a
window that grows until both sides agree (see ``merges``), level by level of a tree. Equal long texts are encoded
once.

Cases: null text is empty (no tokens, empty decoding); a null doc_id stays null; repeated rows are encoded each; an
empty table gives an empty result; only doc_id and text are read. The strings of special tokens inside a text become
those tokens.
"""

from __future__ import annotations

import hashlib
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import merges, textnp
from .base import give_back, lean, text_or_empty

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
UNSETTLED = regex.compile(r"[^\x00-\u052F\u2010-\u2027\u20AC]").search
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MEMORY = 300_000
LONG = 65_536
LEAF_BYTES = 16_384


def lower(text: str) -> str:
    """Lower case a character at a time: a final sigma is no special case."""
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


class Codec:
    """Encodes and decodes texts with one vocabulary; remembers up to ``MEMORY`` distinct words."""

    def __init__(self, path: str):
        self.table = merges.MergeTable(path)
        self.find = regex.compile(PATTERN).findall
        self.library = Tokenizer.from_file(path)
        self.byte_of = {ord(c): chr(b) for b, c in enumerate(merges.byte_chars())}
        self.marks = sorted(self.table.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.marks)) + ")").split
        self.forget()
        self.names = list(map(str, range(len(self.table.tokens))))
        self.numbers = list(range(len(self.table.tokens)))  # one object a token, however many words hold it
        give_back()

    def forget(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {m: (i,) for m, i in self.table.special.items()}

    def words(self, text: str) -> list[str]:
        """Words of a text; special tokens are words of their own."""
        plain = self._plain
        if not any(m in text for m in self.marks):
            return plain(text)
        return [w for k, part in enumerate(self.split(text)) for w in ([part] if k % 2 else plain(part))]

    def _plain(self, text: str) -> list[str]:
        """Words of a text without special tokens. Scripts whose character tables differ between Unicode versions are
        normalised and cut by the library, so that its version holds."""
        if text.isascii():
            return self.find(text.lower())
        if not UNSETTLED(text):
            return self.find(lower(unicodedata.normalize("NFC", text)))
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [part.translate(self.byte_of).encode("latin-1").decode() for part, _ in parts]

    def learn(self, words: set[str]) -> None:
        new = list(words)
        raw, at = textnp.utf8(pa.array(new, pa.large_string()))
        sizes = np.diff(at)
        short = np.flatnonzero(sizes <= merges.LEAF)
        for lo, hi in textnp.slices(np.r_[0, np.cumsum(sizes[short])], 1 << 20):
            rows = short[lo:hi]
            ends = np.r_[0, np.cumsum(sizes[rows])]
            part = raw if len(rows) == len(new) else np.concatenate([raw[at[r] : at[r + 1]] for r in rows])
            tokens, cuts = self.table.encode(self.table.symbols(part, ends), ends)
            tokens, cuts = list(map(self.numbers.__getitem__, tokens.tolist())), cuts.tolist()
            for k, r in enumerate(rows.tolist()):
                self.known[new[r]] = tuple(tokens[cuts[k] : cuts[k + 1]])
        for r in np.flatnonzero(sizes > merges.LEAF):
            part = raw[at[r] : at[r + 1]]
            self.known[new[r]] = tuple(self.table.encode_long(self.table.symbols(part, np.array([0, len(part)]))).tolist())

    def encode_words(self, rows: list[list[str]]) -> list[list[int]]:
        fresh = set().union(*rows).difference(self.known) if rows else set()
        if fresh and len(self.known) + len(fresh) > MEMORY:
            self.forget()
            fresh = set().union(*rows).difference(self.known)
        if fresh:
            self.learn(fresh)
        ids_of = self.known.__getitem__
        return [list(chain.from_iterable(map(ids_of, row))) for row in rows]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.encode_words([self.words(t) for t in texts])

    def decode(self, ids: list[int]) -> str:
        """The tokens one after another with spaces between, special ones too: the vocabulary has no decoder."""
        return " ".join(map(self.table.tokens.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(" ".join(map(self.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


def _leaves(words: list[str], special: dict[str, int]):
    """(kind, payload) in order of the text: ``words`` (joined by a line end), ``head`` and ``more`` of a long word
    (``last`` its end), ``special``. Words hold no white space, so the line end parts them."""
    packed, size = [], 0
    for word in words:
        raw = word.encode()
        if word in special or len(raw) > LEAF_BYTES:
            if packed:
                yield "words", "\n".join(packed).encode()
            packed, size = [], 0
            if word in special:
                yield "special", raw
            else:
                cuts = range(0, len(raw), LEAF_BYTES)
                for k, c in enumerate(cuts):
                    yield ("last" if k == len(cuts) - 1 else "more" if k else "head"), raw[c : c + LEAF_BYTES]
            continue
        packed.append(word)
        size += len(raw) + 1
        if size >= LEAF_BYTES:
            yield "words", "\n".join(packed).encode()
            packed, size = [], 0
    if packed:
        yield "words", "\n".join(packed).encode()


def _long_texts(texts: DataFrame, path: str) -> DataFrame:
    """text_sha and the digests of each distinct text. texts: text_sha, text."""

    def cut(batches):
        for batch in batches:
            codec = _codec(path)
            for sha, text in zip(batch.column("text_sha").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = list(_leaves(codec.words(text), codec.table.special)) or [("words", b"")]
                yield pa.RecordBatch.from_arrays([pa.array([sha] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array([k for k, _ in parts]), pa.array([p for _, p in parts], pa.binary())], names=["text_sha", "leaf", "kind", "payload"])

    def encode(batches):
        for batch in batches:
            codec, ids, kept = _codec(path), [], []
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                kept.append(None if kind in ("words", "special") else payload)  # only joins of long words look again
                if kept[-1] is None:
                    ids.append(codec.encode_words([payload.decode().split("\n") if payload else []])[0])
                else:
                    raw = np.frombuffer(payload, np.uint8)
                    symbols = codec.table.inner[raw]
                    if kind == "last":
                        symbols[-1] = codec.table.final[raw[-1]] if codec.table.suffix else symbols[-1]
                    ids.append(codec.table.encode_long(symbols).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("text_sha", "leaf", "kind")), pa.array(kept, pa.binary()), pa.array(ids, pa.list_(pa.int32()))], names=["text_sha", "leaf", "kind", "payload", "ids"])

    def join(group: pa.Table) -> pa.Table:
        codec = _codec(path)
        group = group.sort_by("leaf")
        out: list[int] = []
        nodes: list[np.ndarray] = []
        symbols: list[np.ndarray] = []
        for kind, payload, ids in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist(), group.column("ids").to_pylist(), strict=True):
            if kind in ("words", "special"):
                out.extend(ids)
                continue
            raw = np.frombuffer(payload, np.uint8)
            part = codec.table.inner[raw]
            if kind == "last" and codec.table.suffix:
                part[-1] = codec.table.final[raw[-1]]
            nodes.append(np.array(ids, np.int32))
            symbols.append(part)
            if kind == "last":
                out.extend(codec.table.join_all(nodes, symbols).tolist())
                nodes, symbols = [], []
        n, ids_sha, text_sha = codec.digests(out)
        return pa.table({"text_sha": group.column("text_sha")[:1], "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [ids_sha], "decoded_sha256": [text_sha]})

    one = texts.dropDuplicates(["text_sha"])
    leaves = one.mapInArrow(_alone(cut), "text_sha string, leaf long, kind string, payload binary")
    ids = leaves.repartition("text_sha", "leaf").mapInArrow(_alone(encode), "text_sha string, leaf long, kind string, payload binary, ids array<int>")
    return ids.groupBy("text_sha").applyInArrow(join, "text_sha string, n_tokens long, ids_sha256 string, decoded_sha256 string")


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _alone(run):
    """run, for ``mapInArrow``; no codec stays in the worker, where it would stand beside what other stages need."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _codecs.clear()

    return lean(whole)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each row."""

    def run(batches):
        codec = _codec(path)
        for batch in batches:
            _, at = textnp.utf8(batch.column("text"))
            for lo, hi in textnp.slices(at, 1 << 20):
                ids = codec.encode([t or "" for t in batch.column("text").slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(_alone(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded of each row of (doc_id, ids); null ids decode to an empty text."""

    def run(batches):
        codec = _codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec.decode(x or []) for x in batch.column("ids").to_pylist()], pa.large_string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(_alone(run), "doc_id long, decoded string")


def digests(docs: DataFrame, path: str, long_chars: int = LONG) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""

    def run(batches):
        codec = _codec(path)
        for batch in batches:
            _, at = textnp.utf8(batch.column("text"))
            for lo, hi in textnp.slices(at, 1 << 20):
                ids = codec.encode([t or "" for t in batch.column("text").slice(lo, hi - lo).to_pylist()])
                n, a, b = zip(*map(codec.digests, ids), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    is_long = F.char_length("text") > long_chars
    short = rows.filter(~is_long).mapInArrow(_alone(run), SCHEMA)
    long = rows.filter(is_long).withColumn("text_sha", F.sha2("text", 256))
    done = _long_texts(long, path)
    return short.unionByName(long.select("doc_id", "text_sha").join(done, "text_sha").drop("text_sha"))
