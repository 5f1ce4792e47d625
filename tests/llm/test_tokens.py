"""BPE encoding, decoding and token counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, classes, merges, queries, token_counts

COLUMNS = "doc_id long, text string, ids string, leaf long"


def texts(seed):
    rng = random.Random(seed)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    out = [None, "", " ", "\x1c\x1d a\x85b\xa0c", "ΑΣ ΣΑΣ", "İI", " <|endoftext|>a<|startoftext|> b's'S I'LL", "é ́x", "x" * 70_000, "ab" * 40_000 + " tail", "word " * 20_000]
    out += ["".join(map(chr, points[i : i + 997])) for i in range(0, len(points), 9970)]
    out += ["".join(chr(rng.choice(points)) if rng.random() < 0.2 else rng.choice("abcXYZ 's  \n12.,!é<|endoftext|>") for _ in range(rng.randint(1, 300))) for _ in range(100)]
    out.append("".join(rng.choice("etaoin") for _ in range(80_000)))
    return out + out[-3:]


@pytest.fixture(scope="module")
def table(spark):
    from tidemark.runtime import ship

    ship(spark)
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts(3))], COLUMNS).repartition(4)


def test_encoding_and_decoding(table):
    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.digests(table, path).collect()}
    for i, text in enumerate(texts(3)):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), repr(text)[:80]
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_counts(table):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts.counts(table, path, limit=100).collect()}
    for i, text in enumerate(texts(3)):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len((text or "").encode()), n, n > 100), repr(text)[:80]


def test_counts_of_every_code_point():
    """The library's tables decide what a letter is: all planes with assigned characters, behind and before others."""
    path = queries.tokenizer_path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), token_counts.Counter(path, token_counts.library_classes())
    points = [c for c in classes.POINTS if c < "\U00040000" or "\U000e0000" <= c < "\U000e1000"]
    some = [f"a{c}1{c}a !{c}" for c in points]
    assert counter.count(some) == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert counter.count(["\U00032a88\u8eaa"]) == [7]


def test_ids_round_trip(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = spark.createDataFrame([(1, "Hello, wörld!"), (None, None)], "doc_id long, text string")
    encoded = bpe.encode(rows, path)
    decoded = {r.doc_id: r.decoded for r in bpe.decode(encoded, path).collect()}
    assert decoded[None] == ""
    assert "hello</w>" in decoded[1]


@pytest.mark.parametrize("leaf", [16, 64, 1024])
def test_tree_of_joins_is_exact(leaf):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    table, library, rng = merges.MergeTable(path), Tokenizer.from_file(path), random.Random(leaf)
    for alphabet in ("ab", "a", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyzé"):
        word = "".join(rng.choice(alphabet) for _ in range(5000))
        raw = np.frombuffer(word.encode(), np.uint8)
        ids = table.encode_long(table.symbols(raw, np.array([0, len(raw)])), leaf)
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert bpe.digests(empty, queries.tokenizer_path("word_bpe_49k.json")).count() == 0
    assert token_counts.counts(empty, queries.tokenizer_path("byte_bpe_50k.json")).count() == 0
