"""The filter audit against every order applied document by document, and its flags on odd texts."""

import random
import re
from itertools import permutations

import pytest

from tidemark.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string, part string, fails_A int, good int"
LABELS = "doc_id long, quality int, toxic int, text string, source string"


def documents(seed, n=160):
    rng = random.Random(seed)
    words = ["a", "B", "tide", "é", "İx", "x$", "A B", "CAPS", "w#", "\U0001f600"] + [f"w{i}" for i in range(200)]
    texts = [None, "", " \t\n", "\x1c", "$", "A" * 3, "x " * 60_000, " ".join(f"u{i}" for i in range(50)), " ".join(f"u{i}" for i in range(49)) + "\x0b", "same words " * 40]
    texts += [rng.choice(["", " "]).join([]) + rng.choice([" ", "\n", "  "]).join(rng.choice(words[: rng.choice([3, 40, 210])]) for _ in range(rng.choice([5, 49, 50, 51, 90]))) for _ in range(n)]
    texts += rng.choices(texts, k=60)
    rng.shuffle(texts)
    ids = [i if rng.random() < 0.9 else rng.choice([None, 3, 5]) for i in range(len(texts))]
    rows = [(i, t, rng.choice([None, "", "web", "web", "books"]), "x", 7, 8) for i, t in zip(ids, texts, strict=True)]
    labels = [(rng.choice([None, *range(len(texts))]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "t", "s") for _ in range(150)]
    return rows, labels


def flags(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > first[t])


def brute(rows, labels):
    good, toxic = ({i for i, *x, _, _ in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(f, r[0] in good, r[0] in toxic) for f, r in zip(flags(rows), rows, strict=True) if (r[2] or "") == part]
        share = dict.fromkeys(range(5), 0)
        for order in permutations(range(5)):
            left = own
            for step, k in enumerate(order, 1):
                gone = [d for d in left if d[0][k]]
                left = [d for d in left if not d[0][k]]
                share[k] += len(gone)
                fails = [d for d in own if d[0][k]]
                unique = sum(sum(d[0]) == 1 for d in fails)
                out[part, "".join("ABCDE"[x] for x in order), step] = [len(left), len(gone), len(fails) - len(gone), unique, sum(d[1] for d in gone), sum(d[2] for d in gone), k]
        for key in out:
            if key[0] == part:
                out[key][6] = share[out[key][6]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_orders(spark, seed):
    rows, labels = documents(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = fa.audit(fa.counted(fa.flagged(docs, spark.createDataFrame(labels, LABELS)))).collect()
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == brute(rows, labels)


def test_hot_text_and_no_ids(spark):
    rows = [(i, "the same", "s", "", 0, 0) for i in range(3000)] + [(None, f"t{i % 7}", "s", "", 0, 0) for i in range(3000)]
    flagged = fa.flagged(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(0, 1, 1, "", "")], LABELS))
    assert {tuple(r) for r in fa.counted(flagged).filter("fails_E").select("docs", "good").collect()} == {(2999, 0)}
    assert flagged.filter("good = 1").count() == 1
    assert flagged.count() == 6000


def test_survivors_of_subsets(spark):
    counts = spark.createDataFrame([("p", True, False, False, False, True, 3, 1, 0), ("p", False, False, False, False, False, 2, 0, 1)], "part string, fails_A boolean, fails_B boolean, fails_C boolean, fails_D boolean, fails_E boolean, docs long, good long, toxic long")
    got = {r.subset: (r.docs, r.good, r.toxic) for r in fa.survivors(counts).collect()}
    assert got[0] == (5, 1, 1)
    assert got[2] == got[4] == got[14] == (5, 1, 1)
    assert got[1] == got[16] == got[31] == (2, 0, 1)


def test_empty_table(spark):
    got = fa.audit(fa.counted(fa.flagged(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))))
    assert got.count() == 0
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
