"""Byte-level BPE encoding and decoding of rank files, by transducers (see ``transducer``).

A text is cut by a pattern as the library cuts it (see ``classes``); each match is read by the encoding transducer, and
the tokens of up to ``MEMORY`` distinct matches are remembered by a worker. Tokens are decoded one after another by the
UTF-8 machine. Both go through a text in slices, so a task holds a text and no more than a slice of its tokens.

Cases: a null text is empty (no tokens, empty decoding); a null doc_id stays null; repeated rows are encoded each; an
empty table gives an empty result; only doc_id and text (ids) are read, whatever other columns are called. The names
of special tokens are ordinary text.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from . import textnp
from .classes import Cutter, stand_ins
from .transducer import SLICE, Transducer, Utf8Machine, load_ranks

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MEMORY = 300_000
LONG = 256  # longer matches aren't remembered
SLICE_MATCHES = 50_000


@cache
def tiktoken_classes() -> dict[int, str]:
    """Where tiktoken's classes differ: what a pattern matches is all that it encodes."""

    def members(pattern: str, text: str) -> str:
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        return probe.decode_bytes(probe.encode_ordinary(text)).decode()

    return stand_ins(members)


class _Known(dict):
    """Tokens of matches, encoded when they are first asked for; long ones aren't remembered."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> list[int]:
        ids = self.transducer.encode(piece.encode())
        if len(piece) <= LONG:
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, path: str, pattern: str, instead: dict[int, str]):
        self.transducer = Transducer(load_ranks(path))
        self.machine = Utf8Machine(self.transducer.bytes_of)
        self.cut = Cutter(pattern, instead)
        self.known = _Known(self.transducer)

    def slices(self, text: str) -> Iterator[list[int]]:
        """The text's tokens, some at a time."""
        pieces = iter(self.cut(text))
        while part := list(islice(pieces, SLICE_MATCHES)):
            at = 0
            if max(map(len, part)) > SLICE:
                for k, piece in enumerate(part):
                    if len(piece) > SLICE:
                        yield self._all(part[at:k])
                        yield from self.transducer.stream(piece.encode())
                        at = k + 1
            yield self._all(part[at:])

    def _all(self, pieces: list[str]) -> list[int]:
        if len(self.known) > MEMORY:
            self.known.clear()
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.slices(text)))

    def decode(self, ids: list[int]) -> str:
        return self.machine.decode(ids)

    def digests(self, text: str) -> tuple[int, str, str]:
        n, of_ids, of_text, state = 0, hashlib.sha256(), hashlib.sha256(), b""
        for ids in self.slices(text):
            n += len(ids)
            of_ids.update(np.array(ids, "<u4").tobytes())
            out: list[str] = []
            state = self.machine.push(state, ids, out)
            of_text.update("".join(out).encode())
        of_text.update(("�" if state else "").encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str, instead: dict[int, str]) -> Codec:
    """One for each worker; what its tasks remember is bounded."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern, instead)
    return _codecs[path, pattern]


def _by_batch(docs: DataFrame, path: str, pattern: str, schema: str, run) -> DataFrame:
    """doc_id and what run(codec, texts) gives as columns, slice by slice of each batch."""
    instead = tiktoken_classes()
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def go(batches):
        codec = _codec(path, pattern, instead)
        gc.disable()  # states and memories are many and hold no cycles
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for lo, hi in textnp.slices(textnp.utf8(column)[1], 1 << 20):
                got = run(codec, [t or "" for t in column.slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), *got], names=names)
        gc.enable()

    return docs.select("doc_id", "text").mapInArrow(go, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of each row."""
    return _by_batch(docs, path, pattern, "doc_id long, ids array<int>", lambda codec, texts: [pa.array(map(codec.encode, texts), pa.list_(pa.int32()))])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded of each row of (doc_id, ids); null ids decode to an empty text."""

    def run(batches):
        codec = _codec(path, pattern, tiktoken_classes())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of 32-bit little-endian ids) and decoded_sha256 of each row."""

    def run(codec: Codec, texts: list[str]) -> list[pa.Array]:
        n, ids, decoded = zip(*map(codec.digests, texts), strict=True)
        return [pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)]

    return _by_batch(docs, path, pattern, SCHEMA, run)
