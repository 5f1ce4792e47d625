"""Numpy views of Arrow text columns: UTF-8 bytes, words and 64-bit word hashes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, taken unchanged. A null text is an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPAN = 1 << 20
LONG_WORD = 256
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers: dict[str, np.ndarray] = {}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another, and the n + 1 offsets of the rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; works in place on a uint64 array that it returns."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SPAN + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_spans(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the n + 1 word offsets of the rows."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separator[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    first[cuts] = True
    last = np.empty(len(raw), bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    ends = offsets[1:]
    last[ends[ends > 0] - 1] = True
    starts = np.flatnonzero(first & inside)
    stops = np.flatnonzero(last & inside) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, alike on every executor: eight bytes a step, each step mixed.

    Words may collide, so what follows from equal hashes is to be confirmed on the words' bytes.
    """
    size = stops - starts
    out = mix(size.astype(np.uint64) + np.uint64(1))
    eight = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    todo, step = np.flatnonzero(size <= LONG_WORD), 0
    while len(todo):
        left = size[todo] - step
        chunk = eight[starts[todo] + step] & LOW_BYTES[np.minimum(left, 8)]
        out[todo] = mix((out[todo] ^ chunk) * BASE)
        todo, step = todo[left > 8], step + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : stops[i]], digest_size=8).digest(), "little")
    return out


def joined_words(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, stops: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another, each with one space behind it, and the n + 1 offsets of the words in that."""
    at = np.r_[0, np.cumsum(stops - starts + 1)]
    keep = ~separator[raw]
    bare = np.zeros(len(raw) + 1, bool)  # where a row ends: a word that ends there has no separator of its own
    bare[offsets] = True
    bare = bare[stops]
    space = stops[~bare]
    keep[space] = True
    plain = raw.copy()
    plain[space] = 0x20
    out = plain[keep]
    lone = np.flatnonzero(bare)
    return np.insert(out, at[lone + 1] - 1 - np.arange(len(lone)), 0x20), at


def word_numbers(joined: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each word of ``joined_words``, equal exactly for equal bytes, and how many there are."""
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(joined)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def gram_hashes(hashes: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """Hash of the n hashes that start at each position (``skip`` left out between two of them)."""
    step, count = 1 + skip, len(hashes) - (n - 1) * (1 + skip)
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k * step : k * step + count]
        mix(out)
    return out


def gram_numbers(numbers: np.ndarray, n: int) -> np.ndarray:
    """A number for the n numbers that start at each position, equal exactly for equal ones.

    Hashes number them, and all that share one are compared; should two differ, they are numbered pair by pair.
    """
    hashes = gram_hashes(mix(numbers.astype(np.uint64) + np.uint64(1)), n)
    _, first, out = np.unique(hashes, return_index=True, return_inverse=True)
    leader = first[out]
    if all((numbers[k : k + len(out)] == numbers[leader + k]).all() for k in range(n)):
        return out
    out, most = numbers, int(numbers.max(initial=0)) + 1
    for k in range(1, n):
        _, out = np.unique(out[:-1] * most + numbers[k:], return_inverse=True)
    return out
