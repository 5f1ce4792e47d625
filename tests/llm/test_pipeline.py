"""The pipeline's stages against brute force on a small corpus, each judged on its own input."""

import os
import random
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    vocabulary = [word() for _ in range(2000)]
    docs, labels = [], []
    for i in range(500):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(30, 60))]
        if i % 4 == 0:
            text[rng.randrange(len(text))] = rng.choice(["vile", "nasty"])
        docs.append((i, " ".join(text), "en", f"s{i % 5}", 0))
        labels.append((i, int(i % 4 == 0), 1))
    base = [d for d in docs if d[0] % 4][:60]
    docs += [(1000 + k, d[1].upper() if k % 2 else d[1], "en", d[3], 0) for k, d in enumerate(base[:30])]
    docs += [(2000 + k, d[1] + " extra", "en", d[3], 0) for k, d in enumerate(base[30:])]
    docs += [(3000, None, None, None, None), (3001, "", "en", "s1", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    frames = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], folder)
        out.write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names, name
    rows = [[tuple(r) for r in f.collect()] for f in frames]

    toxic = lambda r: any(w in ("vile", "nasty") for w in (r[1] or "").lower().split())
    assert not any(toxic(r) for r in rows[1])
    assert Counter(rows[1]) == Counter(r for r in rows[0] if not toxic(r))

    lowered = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    best = {}
    for r in rows[1]:
        best[lowered(r[1])] = max(best.get(lowered(r[1]), r), r, key=lambda x: x[0])
    assert Counter(rows[2]) == Counter(best.values())

    def sets(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    kept = sorted(rows[2])
    parent = {r[0]: r[0] for r in kept}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shingles = {r[0]: sets(r[1]) for r in kept}
    for a in kept:
        for b in kept:
            x, y = shingles[a[0]], shingles[b[0]]
            if a[0] < b[0] and x and y and len(x & y) >= 0.8 * len(x | y):
                ra, rb = root(a[0]), root(b[0])
                parent[max(ra, rb)] = min(ra, rb)
    assert len(rows[3]) < len(rows[2])
    assert Counter(rows[3]) == Counter(r for r in kept if root(r[0]) == r[0])

    times = Counter(rows[4])
    mixed = frames[-2].select("doc_id").collect()
    beside = sum(a.doc_id == b.doc_id for a, b in zip(mixed, mixed[1:], strict=False))
    assert beside < 0.05 * len(mixed) < 0.5 * sum(n - 1 for n in times.values())  # repeats aren't side by side
    assert set(times) <= set(rows[3])
    assert max(times.values()) <= 2
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows[3]:
        size[r[3]] += len((r[1] or "").split())
    for r in rows[4]:
        taken[r[3]] += len(r[1].split())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    expected = Counter((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows[4])
    assert Counter((r[0], r[1]) for r in rows[5]) == expected


def test_run_agrees_with_stages(spark, folder):
    first = Counter(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert first
    assert first == Counter(map(tuple, corpus_pipeline.queries()["pipeline"](spark, folder).collect()))


def test_empty_tables_and_nulls(spark, tmp_path):
    for name, rows in (("none", []), ("some", [(None, None, None, None, None), (1, None, None, None, 3), (1, "w " * 3000, None, "s", 3), (1, "w " * 3000, None, "s", 3)])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in got} == ({1} if rows else set())
        assert len(got) <= 2


def test_run_leaves_only_its_result(spark, folder):
    from tidemark.runtime import shared_dir

    place = shared_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(place))
    corpus_pipeline.run(spark, folder).count()
    made = [x for x in set(os.listdir(place)) - before if x.startswith("pipeline-")]
    assert len(made) == 1
    assert os.listdir(f"{place}/{made[0]}") == ["4-bpe"]
