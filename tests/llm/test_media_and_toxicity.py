"""Media columns and toxicity."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import media, toxicity

COLUMNS = "doc_id long, text string, media string, score double"


def test_digests(spark):
    texts = [None, "", "a", "x" * 64, "é" * 100, "long " * 9000, "long " * 9000]
    got = {r.doc_id: r for r in media.digests(media.store(spark.createDataFrame([(i, t, "m", 0.0) for i, t in enumerate(texts)], COLUMNS))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(raw), len(payload))
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.store_bytes(np.frombuffer(raw, np.uint8))
        assert (got[i].media_bytes, got[i].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert tuple(got[5])[1:] == tuple(got[6])[1:]
    assert media.digests(media.store(spark.createDataFrame([], COLUMNS))).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (64, 65)])
def test_formats_round_trip(shape):
    image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_pgm(image)) == image).all()
    assert (media.decode(media.encode_bmp(image)) == image).all()
    parts = media.tiles(image, 4)
    assert (media.join_tiles(parts, image.shape) == image).all()
    assert all((np.load(io.BytesIO(npy)) == image[t : t + 4, s : s + 4]).all() for t, s, npy in parts)


def test_other_netpbm_and_bmp():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15 # c\n0 15").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    head = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    assert media.decode(head + b"\x03\x02\x01\x00").tolist() == [[[1, 2, 3]]]


def test_resize_is_the_mean_of_the_area():
    image = np.arange(12.0).reshape(3, 4)
    assert media.resize(image, 1, 1)[0, 0] == pytest.approx(image.mean())
    assert media.resize(image, 3, 2)[:, 0] == pytest.approx(image[:, :2].mean(axis=1))
    assert media.resize(image, 2, 4)[0] == pytest.approx((image[0] + 0.5 * image[1]) / 1.5)


def test_process_reports_bad_media(spark):
    rows = [(1, bytearray(media.encode_pgm(np.zeros((70, 3), np.uint8)))), (2, bytearray(b"junk")), (3, None)]
    got = {r.id: r for r in media.process(spark.createDataFrame(rows, "k long, m binary"), "k", "m").collect()}
    assert (got[1].height, got[1].width, got[1].channels, len(got[1].tiles)) == (70, 3, 1, 2)
    assert got[2].error
    assert got[3].error


def labelled(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        text, bad = [rng.choice(words) for _ in range(rng.randint(5, 80))], i % 4 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["Nasty,", "vile"])
        docs.append((i, " ".join(text), "m", 0.5))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled(900, 1)
    docs += [(5000, None, "m", 0.0), (None, "vile", "m", 0.0), (5001, "", "m", 0.0)]
    df = spark.createDataFrame(docs, COLUMNS)
    table = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    rows = toxicity.classify(df, table).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len(rows) == len(docs)
    kept = toxicity.without_toxic(df, table)
    assert kept.columns == df.columns
    assert kept.count() == sum(not r.predicted for r in rows)


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, "text", "m", 0.0)], COLUMNS)
    assert toxicity.classify(one, none).first().score == 0.5
    assert toxicity.classify(spark.createDataFrame([], COLUMNS), none).count() == 0


def test_training_against_ftrl_by_hand(spark):
    """A second FTRL on dictionaries of feature strings; hashing apart, it must give the same probabilities."""
    rng = random.Random(4)
    vocabulary = ["vile", "nasty", "good", "calm", "tree", "sea"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(6))) for i in range(60)]
    labels = {i: int("vile" in t) for i, t in rows}
    options = {"alpha": 0.5, "beta": 1.0, "l1": 0.3, "l2": 0.1, "positive": 2.0, "least": 2, "epochs": 3, "bits": 22}

    def named(text):
        w = text.split()
        return {(x,) for x in w} | set(zip(w, w[1:], strict=False)) | {("skip", a, b) for a, b in zip(w, w[2:], strict=False)} | {("stem", x[:n]) for n in toxicity.STEMS for x in w if len(x) > n}

    times = {}
    for _, t in rows:
        for f in named(t):
            times[f] = times.get(f, 0) + 1
    z, n = {}, {}

    def weight(f):
        l1 = 0 if f == "bias" else options["l1"]
        if abs(z.get(f, 0)) <= l1:
            return 0.0
        sign = 1 if z[f] > 0 else -1
        return -(z[f] - sign * l1) / ((options["beta"] + n[f] ** 0.5) / options["alpha"] + options["l2"])

    chance = lambda text: 1 / (1 + np.exp(-sum(weight(f) for f in [*named(text), "bias"])))
    order = np.random.default_rng(7).permutation(len(rows))
    for _ in range(options["epochs"]):
        for i in order:
            active = [f for f in named(rows[i][1]) if times[f] >= options["least"]] + ["bias"]
            w = {f: weight(f) for f in active}
            g = (1 / (1 + np.exp(-sum(w.values()))) - labels[i]) * (options["positive"] if labels[i] else 1)
            for f in active:
                z[f] = z.get(f, 0) + g - ((n.get(f, 0) + g * g) ** 0.5 - n.get(f, 0) ** 0.5) / options["alpha"] * w[f]
                n[f] = n.get(f, 0) + g * g
    docs = spark.createDataFrame([*rows, (60, "tree " * 300_000 + "vile"), (61, None)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels.items(), (0, None), (None, 1)], "doc_id long, toxic int")
    bits = options.pop("bits")
    model = toxicity.fit(toxicity.training_rows(docs, marks, "toxic", F.lit(True), 1000), bits, **options)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, bits).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(chance(t), abs=1e-5)
    assert got[61] == pytest.approx(1 / (1 + np.exp(-weight("bias"))), abs=1e-6)
    assert 0 <= got[60] <= 1


def test_training_memory_goes_with_the_sample():
    """2^22 places, of which the sample has few: arrays over all places took hundreds of MB; rows come in pieces."""
    import tracemalloc

    rng = np.random.default_rng(3)
    whole = [np.unique(rng.integers(0, 1 << 22, 300)).astype(np.int32) if i % 7 else np.zeros(0, np.int32) for i in range(400)]
    whole = [np.union1d(p, [5, 9, (1 << 22) - 1]).astype(np.int32) if i % 3 else p for i, p in enumerate(whole)]
    cut = [(i, k, p[lo : lo + 128]) for i, p in enumerate(whole) for k, lo in enumerate(range(0, max(1, len(p)), 128))]
    options = {"bits": 22, "epochs": 2, "alpha": 1.0, "beta": 1.0, "l1": 0.1, "l2": 0.0, "positive": 6.0, "least": 3}
    mixed = [cut[i] for i in rng.permutation(len(cut))]
    tracemalloc.start()
    places, weights = toxicity.learned(np.array([i for i, _, _ in mixed]), np.array([i % 2 for i, _, _ in mixed]), np.array([k for _, k, _ in mixed]), [p for _, _, p in mixed], **options)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    again = toxicity.learned(np.arange(400), np.arange(400) % 2, np.zeros(400, int), whole, **options)
    assert (places == again[0]).all() and (weights == again[1]).all()
    assert places[-1] == 1 << 22 and {5, 9, (1 << 22) - 1} <= set(places.tolist())


def test_sample_bounds_rows_not_only_labels(spark):
    docs = spark.createDataFrame([(i % 4, f"t{i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, "toxic", F.lit(True), 2).count() == 2


@pytest.mark.parametrize("shape", [(3, 64), (8, 9), (17, 31)])
def test_feature_against_a_sum_over_pixels(shape):
    """The hash from cell means summed pixel by pixel, each weighed by the part of it that a cell covers."""
    image = np.random.default_rng(5).integers(0, 256, shape, dtype=np.uint8)
    means = np.zeros((8, 9))
    for i in range(8):
        for j in range(9):
            top, bottom, left, right = i * shape[0] / 8, (i + 1) * shape[0] / 8, j * shape[1] / 9, (j + 1) * shape[1] / 9
            total = 0.0
            for y in range(shape[0]):
                for x in range(shape[1]):
                    total += float(image[y, x]) * max(0, min(bottom, y + 1) - max(top, y)) * max(0, min(right, x + 1) - max(left, x))
            means[i, j] = round(total / ((bottom - top) * (right - left)), 6)
    bits = "".join(str(int(means[i, j] < means[i, j + 1])) for i in range(8) for j in range(8))
    assert media.dhash(image) == f"{int(bits, 2):016x}"


def test_format_is_the_callers():
    raw = np.arange(40_000, dtype=np.uint8)
    assert media.store_bytes(raw)[:2] == b"BM"
    assert media.store_bytes(raw, 1 << 30)[:2] == b"P5"
    assert media.store_bytes(raw[:5], 0)[:2] == b"BM"
