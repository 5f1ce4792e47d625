"""Key literals and stored keys as columns against the functions for one text."""

import base64
import random

from pyspark.sql import functions as F

from tidemark.functions import key_columns, literals


def by_text(text, names):
    try:
        found = literals.parse(text, names)
    except ValueError:
        return None
    return [found[n] for n in names]


def test_parse_as_for_one_text(spark):
    rng = random.Random(3)
    signs = ["a", "b", "=", ",", "\\", "{", "}", "(", ")", " ", "é", "\n", "a=", ",b=", "\\,", "\\\\", "1"]
    bodies = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    texts = [rng.choice(["%s", "{%s}", "(%s)", " {%s} ", "{a=%s,b=1}", "{b=%s,a=}", "(%s,2)"]) % b for b in bodies] + ["", "{", "}", "()", "{}", "(,)", "{a=1,b=2}", "{b=2,a=1}", "{a=1,a=2}"]
    texts += ["{a=" + "x\\," * 20_000 + ",b=1}", "(" + "y" * 100_000 + ",z)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for names in (["a", "b"], ["a"]):
        got = df.select("t", key_columns.parse(F.col("t"), names).alias("r")).collect()
        for r in got:
            want = by_text(r.t.strip(" "), names) if r.t == r.t.strip() or r.t.strip(" ") == r.t.strip() else None
            if r.t.strip(" ") == r.t.strip():  # only spaces are trimmed in columns
                assert (r.r["values"], r.r.error is None) == (want, want is not None), (r.t[:60], r.r)
    reasons = {r.r.error for r in df.select(key_columns.parse(F.col("t"), ["a", "b"]).alias("r")).collect()}
    assert reasons == {None, "DANGLING_ESCAPE", "BARE_BRACE", "FIELD_WITHOUT_NAME", "NAME_TWICE", "OTHER_COLUMNS", "OTHER_NUMBER_OF_VALUES", "NOT_COMPOSITE"}
    assert spark.range(1).select(key_columns.parse(F.lit(None).cast("string"), ["a", "b"])["values"].alias("v")).first().v is None


def test_stored_forms(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("aé日=,\\ ") for _ in range(rng.randint(0, 40))), str(rng.randrange(10**9))) for _ in range(300)] + [("x" * 60_000, "")]
    df = spark.createDataFrame(rows, "a string, b string")
    parts = [(F.lit("a"), F.lit("STRING"), F.col("a")), (F.lit("b"), F.lit("INTEGER"), F.col("b"))]
    got = df.select("a", "b", key_columns.store(parts).alias("s")).withColumn("back", key_columns.load(F.col("s"))).collect()
    for r in got:
        want = [("a", "STRING", r.a), ("b", "INTEGER", r.b)]
        assert r.s == literals.store(want)
        assert [tuple(p) for p in r.back] == want
    good = literals.store([("a", "T", "1")])
    short = literals.STORED_PREFIX + base64.urlsafe_b64encode(base64.urlsafe_b64decode(good[len(literals.STORED_PREFIX) :] + "==")[:-1]).decode().rstrip("=")
    bad = spark.createDataFrame([("x",), ("pkt:v1:",), (None,), (short,), (literals.STORED_PREFIX + "AAAAAQ",), (literals.STORED_PREFIX + "____",)], "s string")
    assert [r.v for r in bad.select(key_columns.load(F.col("s")).alias("v")).collect()] == [None] * 6
