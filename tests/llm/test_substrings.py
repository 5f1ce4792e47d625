"""Suffix-array and repeated-phrase deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import phrase_dedup, suffix_dedup, windows

COLUMNS = "doc_id long, text string, block long, doc_key string, flags long"


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [text(rng.randint(15, 60)) for _ in range(5)]
    texts = [None, "", " \t\n", "short", "a " * 300, "ab" * 200, text(4000)]
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else text(rng.randint(1, 50)) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n", "\x0b  "]).join(parts))
    texts += [texts[20], texts[21], texts[4], texts[5]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(None if i == 3 else i, t, 1, "x", 2) for i, t in zip(ids, texts, strict=True)]


def brute_bytes(rows, w=50):
    key = lambda i: float("inf") if i is None else i
    least = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - w + 1):
            least[raw[p : p + w]] = min(key(i), least.get(raw[p : p + w], float("inf")))
    out = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - w + 1):
            if least[raw[p : p + w]] < key(i):
                gone[p : p + w] = [True] * w
        spans = sum(g and (not p or not gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, w=20):
    key = lambda r: (float("inf") if r[0] is None else r[0], r[1] or "")
    seen, out = set(), []
    for i, t, *_ in sorted(rows, key=key):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - w + 1):
            window = tuple(words[p : p + w])
            if window in seen:
                gone[p : p + w] = [True] * w
            seen.add(window)
        kept = b" ".join(x for x, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def same(df, expected):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("hot", [windows.HOT, 3])
def test_bytes_against_brute_force(spark, hot):
    rows = corpus(1)
    expected = brute_bytes(rows)
    assert sum(r[2] for r in expected) > 1000
    same(suffix_dedup.dedup(spark.createDataFrame(rows, COLUMNS), hot=hot, batch=200), expected)


@pytest.mark.parametrize("hot", [windows.HOT, 3])
def test_words_against_brute_force(spark, hot):
    rows = corpus(2)
    expected = brute_words(rows)
    assert sum(r[2] for r in expected) > 300
    same(phrase_dedup.dedup(spark.createDataFrame(rows, COLUMNS), hot=hot), expected)


def test_repeated_ids_are_one_document_to_bytes(spark):
    text = "the same fifty bytes and then some more of them, to be sure of it"
    rows = [(1, text, 0, "", 0), (1, text, 0, "", 0), (2, text, 0, "", 0)]
    got = {(r.doc_id, r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {(1, 0), (2, len(text))}


def test_level_index_merges_geometrically():
    rng = np.random.default_rng(4)
    index, seen = suffix_dedup.LevelIndex(20), set()
    for _ in range(40):
        text = rng.integers(97, 99, 400).astype(np.uint8)
        text[:200] = 97 if rng.random() < 0.3 else text[:200]
        rank = suffix_dedup.suffix_ranks(text, 20)[:381]
        _, at = np.unique(rank, return_index=True)
        strings = [text[p : p + 20].tobytes() for p in at.tolist()]
        assert strings == sorted(set(strings))
        assert index.add(text, at).tolist() == [x in seen for x in strings]
        seen |= set(strings)
    assert len(index.levels) <= 6
    assert sum(len(level.at) for level in index.levels) == len(seen)


def test_windows_that_a_polynomial_hash_confuses(spark):
    """The Thue-Morse word and its complement: equal modulo 2^64 whatever the base, and not equal here."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    rows = [(1, " ".join([word] * 20), 0, "", 0), (2, " ".join([other] * 20), 0, "", 0), (3, " ".join([word] * 20), 0, "", 0)]
    same(phrase_dedup.dedup(spark.createDataFrame(rows, COLUMNS)), brute_words(rows))


def test_recurring_windows_whose_hashes_collide(monkeypatch):
    monkeypatch.setattr(phrase_dedup.textnp, "gram_hashes", lambda words, n, skip=0: np.zeros(len(words) - (n - 1) * (1 + skip), np.uint64))
    words = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    assert phrase_dedup.recurring(words, np.arange(7), 3, 1).tolist() == [0]
    assert phrase_dedup.textnp.gram_numbers(words, 3).tolist() == [0, 2, 4, 1, 3, 5, 0]


@pytest.mark.parametrize("window", [20, 7, 1])
def test_phrases_of_any_window(spark, window):
    rows = corpus(6)[:30]
    same(phrase_dedup.dedup(spark.createDataFrame(rows, COLUMNS), window=window, gram=1), brute_words(rows, window))


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert suffix_dedup.dedup(empty).count() == 0
    assert phrase_dedup.dedup(empty).count() == 0


def test_long_text_over_spans(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(200_000))
    rows = [(1, long, 0, "", 0), (2, "x" + long[1_000_000:1_100_000] + "y", 0, "", 0)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {1: 0, 2: 100_000}
    words = long.split()
    rows = [(1, long, 0, "", 0), (2, "x " + "  ".join(words[100_000:110_000]) + " y", 0, "", 0)]
    got = {r.doc_id: r.n_removed for r in phrase_dedup.dedup(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {1: 0, 2: 10_000}


def pieces(seed, window=50):
    """Arguments of judge: texts of ascending documents, some of which hold parts of others, and the strings' answers."""
    rng = random.Random(seed)
    word = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    texts = [(k // 2, word(rng.randint(window, 120))) for k in range(2000)]
    for k in range(100, 2000, 100):
        part = texts[k - rng.randint(1, 90)][1]
        texts[k] = (texts[k][0], rng.choice([part, word(5) + part[3:] + word(2), part[: window + 1] + word(9)]))
    least: dict = {}
    for d, t in texts:
        for p in range(len(t) - window + 1):
            least.setdefault(t[p : p + window], d)
    answers = [least[t[p : p + window]] < d for d, t in texts for p in range(len(t) - window + 1)]
    size = np.array([len(t) for _, t in texts])
    place = rng.sample(range(len(texts)), len(texts))  # where each stands in the bytes
    end = np.empty(len(texts), np.int64)
    end[place] = np.cumsum(size[place])
    raw = b"".join(texts[k][1] for k in place)
    return (raw, end - size, end, size - window + 1, np.array([d for d, _ in texts]), window), answers


@pytest.mark.parametrize("batch", [suffix_dedup.BATCH, 300])
def test_only_strings_that_may_recur_get_ranks(monkeypatch, batch):
    ranked, ranks = [], suffix_dedup.suffix_ranks
    monkeypatch.setattr(suffix_dedup, "suffix_ranks", lambda text, window: ranked.append(len(text)) or ranks(text, window))
    given, answers = pieces(7)
    assert suffix_dedup.judge(*given, batch=batch).tolist() == answers
    assert 0 < sum(ranked) < len(given[0]) / 10


@pytest.mark.parametrize("batch", [suffix_dedup.BATCH, 300])
def test_strings_whose_hashes_collide_are_told_apart_by_bytes(monkeypatch, batch):
    monkeypatch.setattr(windows, "gram_keys", lambda symbols, m, room: np.zeros(len(symbols) - m + 1, np.uint64))
    given, answers = pieces(8)
    assert sum(answers) > 100
    assert suffix_dedup.judge(*given, batch=batch).tolist() == answers


def test_keys_of_grams_do_not_depend_on_their_place():
    text = np.random.default_rng(9).integers(0, 256, 3 * windows.STEP).astype(np.uint8)
    text[-500:] = text[:500]
    offsets, plan = np.array([0, len(text) - 500, len(text)]), windows.Plan(50, 20, False, True, None, None, None, None, "")
    runs = windows.find_runs(text, offsets, plan)
    assert runs.count.sum() == len(text) - 500 - 49 + 500 - 49
    windows_of = lambda lo, hi: {(s + k - lo, key) for s, n, key in zip(runs.start.tolist(), runs.count.tolist(), runs.key.tolist(), strict=True) for k in range(n) if lo <= s + k < hi}
    assert windows_of(0, 451) == windows_of(len(text) - 500, len(text))


@pytest.mark.parametrize("collide", [False, True])
def test_equal_spans(monkeypatch, collide):
    if collide:
        monkeypatch.setattr(windows.textnp, "word_hashes", lambda raw, starts, stops: np.zeros(len(starts), np.uint64))
    rng = np.random.default_rng(10)
    raw = rng.integers(97, 99, 400).astype(np.uint8).tobytes() + b"ab" * 300
    begin = rng.integers(0, len(raw), 3000)
    end = np.minimum(len(raw), begin + rng.choice([1, 2, 7, 8, 9, 16, 305], 3000))
    hashes, first = windows.equal_spans(raw, begin, end)
    spans, seen = [raw[a:b] for a, b in zip(begin, end, strict=True)], {}
    assert first.tolist() == [seen.setdefault(x, k) for k, x in enumerate(spans)]
    assert (hashes == hashes[first]).all()
    assert windows.equal_spans(b"", begin[:0], end[:0])[1].tolist() == []
