"""The n-gram Jaccard join against all pairs."""

import random
from collections import Counter

import pytest

from tidemark.llm import jaccard

COLUMNS = "doc_id long, text string, node string, component long"


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7)))
    rows = [None, "", "  \n", "one", "one", "one two three", "one two three four", "a b c d e"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(rng.choice([" ", "\n "]).join(copy))
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    return [(i if i else None, t, "x", 5) for i, t in enumerate(rows)]


def brute(rows, n=5, threshold=0.8):
    key = lambda i: float("inf") if i is None else i
    sets = []
    for _, t, *_ in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for k, r in enumerate(rows):
        least[root(k)] = min(least.get(root(k), float("inf")), key(r[0]))
    return Counter((r[0], None if least[root(k)] == float("inf") else least[root(k)], links[k]) for k, r in enumerate(rows))


@pytest.mark.parametrize(("together", "paired"), [(4096, 16), (6, 16), (4, 0)])
def test_against_all_pairs(spark, together, paired, monkeypatch):
    """The same links whether a component meets whole, in pairs of blocks, or in its buckets."""
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    rows = corpus(3)
    expected = brute(rows)
    assert sum(n for (_, _, n) in expected) > 60
    got = jaccard.classes(spark.createDataFrame(rows, COLUMNS), together=together)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == expected


@pytest.mark.parametrize("edges", [10**6, 40])
def test_components(spark, edges, monkeypatch):
    monkeypatch.setattr(jaccard, "EDGES", edges)
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400, 400 + k) for k in range(1, 40)]
    name = lambda k: k.to_bytes(16, "big")
    label = {k: k for p in pairs for k in p}
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = jaccard.components(spark.createDataFrame([(name(a), name(b)) for a, b in pairs if a != b], "a binary, b binary"))
    assert {(bytes(r.node), bytes(r.component)) for r in got.collect()} == {(name(k), name(c)) for k, c in label.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_prefix_is_shortened_to_the_target():
    assert jaccard.prefix_length(0.8, 24, 8, 0.9999) == 5
    assert jaccard.prefix_length(0.8, 24, 8, 0.5) == 8
    assert jaccard.prefix_length(0.01, 1, 8, 0.9999) == 1


def test_recall_of_a_family_near_the_threshold(spark):
    """Prefixes are shortened for documents with many links at 0.8; a rule for single links would leave some out."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(0, 400, 10), 4 + rng.randrange(3)):
            copy[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    rows = [(i, t, "", 0) for i, t in enumerate(texts)]
    expected = brute(rows)
    got = {r.doc_id: r.n_links for r in jaccard.classes(spark.createDataFrame(rows, COLUMNS), target=0.99).collect()}
    want = {i: n for i, _, n in expected}
    assert sum(want.values()) > 1000
    assert sum(got.values()) >= 0.9999 * sum(want.values())
    assert all(got[i] <= want[i] for i in want)


def test_words_that_a_polynomial_hash_confuses(spark):
    """The Thue-Morse word and its complement: equal modulo 2^64 whatever the base, and not equal here."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    rows = [(1, " ".join([word] * 20), "", 0), (2, " ".join([other] * 20), "", 0)]
    assert {(r.doc_id, r.class_id, r.n_links, r.copies) for r in jaccard.classes(spark.createDataFrame(rows, COLUMNS)).collect()} == {(1, 1, 0, 1), (2, 2, 0, 1)}


def test_shingles_are_compared_by_their_words():
    owner, grams, size = jaccard.exact_sets([b"a b c d e f ", b"b c d e f a ", b"a b ", b"a b ", b"b a "], 5)
    sets = [set(grams[owner == k].tolist()) for k in range(5)]
    assert size.tolist() == [2, 2, 1, 1, 1]
    assert len(sets[0] & sets[1]) == 1 and sets[2] == sets[3] != sets[4]


def test_very_long_text_and_ties(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(5, long, "", 0), (4, long + " end", "", 0), (9, "w1 w2", "", 0), (9, "w1 w2", "", 0)]
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {(5, 4, 1), (4, 4, 1), (9, 9, 1)}


def test_one_of_each_keeps_columns_and_blanks(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text, "a", 1), (2, text + " x", "b", 2), (4, "", "c", 3), (5, None, "d", 4), (9, "other", "e", 5)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, COLUMNS))
    assert got.columns == ["doc_id", "text", "node", "component"]
    assert sorted(r.doc_id for r in got.collect()) == [2, 4, 5, 9]


def test_one_of_each_with_null_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(80))
    other, clean, lone = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [
        (1, base, "a", 1),
        (None, base + " end", "b", 2),
        (None, clean, "c", 3),
        (None, None, "d", 4),
        (None, " ", "e", 5),
        (7, "start " + base, "f", 6),
        (7, other, "g", 7),
        (8, lone, "h", 8),
        (8, lone, "h", 8),
        (8, lone.replace(" ", "  "), "i", 9),
        (None, other + " end", "j", 10),
    ]
    got = jaccard.one_of_each(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(r.component for r in got) == [1, 3, 4, 5, 7, 9]
    assert all(tuple(r) in rows for r in got)
    assert jaccard.one_of_each(spark.createDataFrame([], COLUMNS)).count() == 0


def test_empty_table(spark):
    assert jaccard.classes(spark.createDataFrame([], COLUMNS)).count() == 0
