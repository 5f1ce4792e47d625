"""The byte-level transducers against the tiktoken library and Python's decoder."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from test_tokens import COLUMNS, texts

from tidemark.llm import byte_bpe, classes, queries, transducer

PATH = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=queries.BYTE_LEVEL_PATTERN, mergeable_ranks=transducer.load_ranks(PATH), special_tokens={})


def test_digests(spark, library):
    from tidemark.runtime import ship

    ship(spark)
    rows = [(i, t, "x", 0) for i, t in enumerate(texts(5))] + [(None, "no id", "x", 0), (3, "again", "x", 0), (3, "again", "x", 0)]
    got = sorted(byte_bpe.digests(spark.createDataFrame(rows, COLUMNS).repartition(4), PATH, queries.BYTE_LEVEL_PATTERN).collect(), key=lambda r: (r[0] is None, r))
    want = []
    for i, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] is None, r))


def test_every_code_point_behind_and_before_others(library):
    """The library's tables decide what a letter is: all planes with assigned characters, cut and encoded as it does."""
    codec = byte_bpe.Codec(PATH, queries.BYTE_LEVEL_PATTERN, byte_bpe.tiktoken_classes())
    points = [c for c in classes.POINTS if c < "\U00040000" or "\U000e0000" <= c < "\U000e1000"]
    for lo in range(0, len(points), 20_000):
        text = "\n;\n".join(f"a{c}1{c}a !{c}" for c in points[lo : lo + 20_000])
        assert codec.encode(text) == library.encode_ordinary(text), lo


def test_pieces_without_bounds(monkeypatch):
    """Any bytes as one piece, states thrown away on the way, and tokens that come as soon as they are sure."""
    monkeypatch.setattr(transducer, "SLICE", 100)
    ranks = transducer.load_ranks(PATH)
    whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    small = transducer.Transducer(ranks, states=50)
    rng = random.Random(7)
    for alphabet in (["a"], ["a", "b"], list("etaoin "), ["é", "日", "本", "ا", "ل", "л", "ст", " ", "\n", "ing", "0", "\U0001f600"]):
        for size in (1, 2, 3, 17, 400, 3000):
            text = "".join(rng.choice(alphabet) for _ in range(size))
            assert small.encode(text.encode()) == whole.encode_ordinary(text)
    out, state, held = [], 0, 0
    raw = "".join(rng.choice("etaoinshrdlu é日") for _ in range(3000)).encode()
    for k in range(len(raw)):
        state = small.push(state, raw[k : k + 1], out)
        sure = b"".join(small.bytes_of[t] for t in out)
        assert raw.startswith(sure)
        held = max(held, k + 1 - len(sure))
    assert held <= 2 * max(map(len, ranks))  # bounded lookahead


def test_utf8_machine():
    ranks = transducer.load_ranks(PATH)
    machine = transducer.Utf8Machine({r: t for t, r in ranks.items()})
    by_byte = {b: ranks[bytes([b])] for b in range(256)}
    rng = random.Random(2)
    odd = [0x00, 0x7F, 0x80, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]
    for _ in range(20_000):
        raw = bytes(rng.choice(odd) if rng.random() < 0.8 else rng.randrange(256) for _ in range(rng.randint(0, 8)))
        assert machine.decode([by_byte[b] for b in raw]) == raw.decode("utf-8", "replace")
    out = []
    assert machine.push(b"", [by_byte[b] for b in "é".encode()[:1]], out) == "é".encode()[:1]
    assert "".join(out) == ""


def test_ranks_must_be_of_merges():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300}
    assert transducer.Transducer(ranks).encode(b"abc") == [300]  # not reached by merges, a token as a whole piece
    assert transducer.Transducer(ranks).encode(b"abcd") == [97, 98, 99, 100]
    with pytest.raises(ValueError, match="bytes"):
        transducer.Transducer({b"a": 0})


def test_round_trip_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "Hello, wörld! <|endoftext|>", 1), (None, None, 1)], "doc_id long, text string, ids int")
    encoded = byte_bpe.encode(rows, PATH, queries.BYTE_LEVEL_PATTERN)
    decoded = {r.doc_id: r.decoded for r in byte_bpe.decode(encoded, PATH, queries.BYTE_LEVEL_PATTERN).collect()}
    assert decoded == {1: "Hello, wörld! <|endoftext|>", None: ""}
    assert byte_bpe.digests(rows.limit(0), PATH, queries.BYTE_LEVEL_PATTERN).count() == 0


def test_states_are_shared_by_texts_that_differ_in_what_is_held_back():
    """A state is its hypotheses, not the tokens before them: invented words lead to states that others have made."""
    made, rng = transducer.Transducer(transducer.load_ranks(PATH)), random.Random(3)
    for _ in range(3000):
        made.encode("".join(rng.choice(["ka", "lor", "mi", "ten", "su", "vra", "el", "on"]) for _ in range(6)).encode())
    assert len(made.states) < 0.6 * len(made.moves)
