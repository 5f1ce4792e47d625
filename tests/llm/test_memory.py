"""What tasks hold in a worker's memory, and what they leave there."""

import subprocess
import sys
import tracemalloc

import pyarrow as pa
import pytest

from tidemark.llm import jaccard

LEFT = """
import re, sys
from pathlib import Path
import numpy as np, pyarrow as pa
from tidemark.llm import bpe, jaccard
from tidemark.llm.queries import tokenizer_path

class Docs:
    select = lambda self, *columns: self
    def mapInArrow(self, run, schema):
        self.run = run
        return self

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024

def batches(seed, rows):
    for k in range(4):
        letters = np.random.default_rng(seed + k).integers(97, 123, (rows, 60, 8), dtype=np.uint8)
        letters[:, :, 7] = 32
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(range(rows), pa.int64()), pa.array([x.tobytes().decode() for x in letters])], names=["doc_id", "doc_key", "text"])

stage = {"sets": lambda: jaccard._sets(Docs(), 5, 24, 8), "bpe": lambda: bpe.encode(Docs(), tokenizer_path("word_bpe_49k.json"))}[sys.argv[1]]
rows = {"sets": 20_000, "bpe": 600}[sys.argv[1]]
for _ in stage().run(batches(0, 1)):
    pass
list(batches(1, rows))
before = held()
for _ in stage().run(batches(1, rows)):
    pass
del _
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
@pytest.mark.parametrize(("stage", "most"), [("sets", 20), ("bpe", 30)])
def test_little_stays_in_a_worker(stage, most):
    done = subprocess.run([sys.executable, "-c", LEFT, stage], capture_output=True, text=True, check=True)
    assert int(done.stdout.split()[-1]) <= most, done.stdout


def test_wide_bit_sets_are_compared_in_small_steps():
    texts = [" ".join(f"{k // 2}x{i}" for i in range(4000)).encode() + b" " for k in range(200)]
    columns = {"node": pa.array([b"%03d" % k for k in range(200)]), "copies": pa.array([1] * 200, pa.int64()), "asked": pa.array([True] * 200), "part": pa.array([0] * 200, pa.int64()), "words": pa.array(texts), "signature": pa.array([bytes(24 * 8 * 2)] * 200)}
    join = jaccard.Join(5, 0.8, 24, 8, 0.9995, 1024)
    seen = []
    count = jaccard.np.bitwise_count
    tracemalloc.start()
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(jaccard.np, "bitwise_count", lambda x: (seen.append((x.nbytes, tracemalloc.get_traced_memory()[0])), count(x))[1])
            found = join.verify(pa.table(columns), join.first, None, (0, 0))
    finally:
        tracemalloc.stop()
    assert found.column("links").to_pylist() == [1] * 200
    assert max(b for b, _ in seen) <= jaccard.AT_ONCE
    assert max(m for _, m in seen) < 30_000_000


def test_rows_meet_python_in_small_batches(spark, tmp_path):
    import corpus_pipeline

    spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    try:
        assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 3000
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n long")
        assert max(r.n for r in sizes.collect()) <= 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
