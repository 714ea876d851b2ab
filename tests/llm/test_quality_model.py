import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from molquarry.llm.quality_model import Features, Ftrl, _ftrl, quality_digests, quality_scores, train_quality_model

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in quality_digests(spark, SF).collect()}
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    assert len(rows) == pq.read_table(f"{SF}/documents.parquet").num_rows
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [(rows[x["doc_id"]], x["quality"]) for x in labels if x["doc_id"] in rows and rows[x["doc_id"]]["held_out"]]
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.9
    assert all(r["predicted"] == 1 for r, q in held if q == 1)
    good, bad = [r["score"] for r, q in held if q == 1], [r["score"] for r, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_scores_are_dot_products(spark):
    settings = Ftrl(bits=12)
    weights = np.linspace(-1, 1, (1 << 12) + 1).astype(np.float32)
    texts = [None, "", "a", "One two TWO !!! 12", "x " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    features = Features(12)
    for r in quality_scores(docs, weights, settings).collect():
        p, v = features(r["text"])
        assert abs(r["score"] - 1 / (1 + np.exp(-(weights[p].astype(float) @ v + weights[-1])))) < 1e-9


def test_odd_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, label int")
    weights = train_quality_model(empty)
    assert not weights.any()
    docs = spark.createDataFrame([(1, None, "s"), (None, "text", None)], "doc_id long, text string, shard string")
    assert [r["score"] for r in quality_scores(docs, weights).collect()] == [0.5, 0.5]
    rows = [(1, None, 1), (1, "good text", 1), (2, "bad", 0), (None, "x", 0), (3, "y", None)] * 3
    weights = train_quality_model(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert np.isfinite(weights).all() and weights.any()


def plain_ftrl(texts, labels, s):
    """Follow-the-regularised-leader, coordinate by coordinate as in its paper."""
    features, bias, z, n = Features(s.bits), 1 << s.bits, {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= s.l1:
            return 0.0
        return -(zi - math.copysign(s.l1, zi)) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for text, y in zip(texts, labels):
            places, values = features(text)
            x = dict(zip(places.tolist(), values.tolist())) | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_updates_against_a_plain_learner(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["good", "fine", "bad", "!!!", "Word", "12", "x"]) for _ in range(rng.randint(0, 25))) for _ in range(120)] + [None]
    labels = [int("good" in (t or "")) for t in texts]
    for settings in (Ftrl(bits=10), Ftrl(bits=10, l1=0.3, l2=1.0, alpha=0.1, epochs=2)):
        want, got = plain_ftrl(texts, labels, settings), _ftrl(texts, labels, settings)
        assert set(np.flatnonzero(got)) == {i for i, w in want.items() if w}
        assert all(abs(got[i] - w) < 1e-4 for i, w in want.items())
    # the operator averages the learners of its groups
    settings = Ftrl(bits=10, group=41)
    df = spark.createDataFrame(list(zip(range(121), texts, labels)), "doc_id long, text string, label int")
    rows = df.select(F.xxhash64("doc_id").alias("o"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("s"), "text", "label").orderBy("o").collect()
    shards = [_ftrl([r["text"] for r in rows if r["s"] == k], [r["label"] for r in rows if r["s"] == k], settings) for k in range(3)]
    assert np.allclose(train_quality_model(df, settings), np.mean(shards, axis=0), atol=1e-6)


def test_few_labels_find_the_bad_text(spark):
    """The smallest table has a hundred labels or so: one group learns from all of them, and its threshold is in the right place."""
    few = SF.replace("0.01", "0.001")
    rows = {r["doc_id"]: r for r in quality_digests(spark, few).collect()}
    held = [(rows[x["doc_id"]]["predicted"], x["quality"]) for x in pq.read_table(f"{few}/labels.parquet").to_pylist() if x["doc_id"] in rows and rows[x["doc_id"]]["held_out"]]
    assert any(q == 0 for _, q in held) and all(p == q for p, q in held)
