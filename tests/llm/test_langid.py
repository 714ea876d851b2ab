import math
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from molquarry.llm.langid import Bags, Mixture, identified, language_digests, learn, mixtures, trigrams

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_digests(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert len(rows) == len(lang) and {r["lang_pred"] for r in rows} <= {*lang.values(), "und"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.97


def test_mixed_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, p = learn(docs, F.lit(True))
    one = {k: docs.where(f"lang = '{k}' and n_chars > 2000 and source = 'src0'").orderBy("doc_id").first()["text"][:1500] for k in ("en", "fr", "de")}
    texts = spark.createDataFrame([(1, one["en"] + " " + one["fr"]), (2, one["de"]), (3, one["en"] * 3 + one["de"])], "doc_id long, text string")
    got = {r["doc_id"]: dict(zip(r["langs"], r["shares"])) for r in identified(texts, langs, p).collect()}
    assert set(got[1]) == {"en", "fr"} and 0.3 < got[1]["en"] < 0.7
    assert set(got[2]) == {"de"} and set(got[3]) == {"en", "de"} and got[3]["en"] > 0.6


def test_maximisation_against_a_grid():
    rng = np.random.default_rng(1)
    p = rng.random((64, 2))
    p /= p.sum(axis=0)
    places = [rng.choice(64, 500, p=p @ [0.3, 0.7]), rng.choice(64, 300, p=p[:, 0])]
    bags = Bags(places, p)
    share = bags.proportions(np.full((2, 2), 0.5), Mixture(rounds=500, settled=1e-9))
    grid = np.linspace(0, 1, 1001)
    for i, x in enumerate(places):
        ll = [np.log(p[x] @ [g, 1 - g]).sum() for g in grid]
        assert abs(grid[int(np.argmax(ll))] - share[i, 0]) < 2e-3
    assert (mixtures(bags, Mixture())[1].sum(axis=1) - 1 < 1e-9).all()


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ... !", "fr"), (4, "the cat", "en"), (4, "the cat", "en"), (None, "le chat é", "fr"), (6, "x" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = sorted(((r["doc_id"] or 0, r["lang_pred"]) for r in language_digests(docs).collect()))
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")] and len(got) == 7
    none = language_digests(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language_digests(docs.limit(0)).collect() == []
    assert not len(trigrams("1 2", 10))


def plain_mixture(counts, p, spec):
    """(shares over all languages, chosen set's shares) of one bag {place: count}, number by number."""
    languages, total = len(p[0]), sum(counts.values())

    def em(share):
        for _ in range(spec.rounds):
            new = [0.0] * languages
            for g, c in counts.items():
                mix = sum(a * b for a, b in zip(p[g], share))
                new = [x + c * a * b / mix for x, a, b in zip(new, p[g], share)]
            share = [x / total for x in new]
        return share

    def likelihood(share):
        return sum(c * math.log(sum(a * b for a, b in zip(p[g], share))) for g, c in counts.items())

    whole = em([1 / languages] * languages)
    order = sorted(range(languages), key=lambda k: -whole[k])
    chosen = [float(k == order[0]) for k in range(languages)]
    best = likelihood(chosen)
    for size in range(2, languages + 1):
        start = [max(whole[k], 1e-3) if k in order[:size] else 0.0 for k in range(languages)]
        share = em([x / sum(start) for x in start])
        if likelihood(share) - best <= spec.penalty * math.log(max(total, 2)):
            break
        chosen, best = share, likelihood(share)
    return whole, chosen


def test_choice_of_sets_against_a_plain_one():
    rng = np.random.default_rng(5)
    spec = Mixture(rounds=60, settled=0.0)
    p = rng.random((80, 4)) ** 4 + 1e-4
    p /= p.sum(axis=0)
    mixes = [[1, 0, 0, 0], [0.5, 0.5, 0, 0], [0, 0.9, 0.1, 0], [0.3, 0.3, 0.4, 0], [0.25] * 4, [0, 0, 0.02, 0.98]]
    places = [rng.choice(80, n, p=p @ np.array(m)) for m in mixes for n in (3, 60, 900)]
    everything, chosen = mixtures(Bags(places, p), spec)
    sizes = set()
    for x, whole, own in zip(places, everything, chosen):
        want, best = plain_mixture(dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True)))), p.tolist(), spec)
        assert np.allclose(whole, want, atol=1e-6) and np.allclose(own, best, atol=1e-6)
        sizes.add(sum(v > 0 for v in best))
    assert sizes >= {1, 2, 3}


def test_rare_language_is_learnt_whole(spark):
    docs = spark.createDataFrame([(i, f"abc def ghi {i}", "a") for i in range(300)] + [(1000 + i, f"xyz uvw {i}", "b") for i in range(3)], "doc_id long, text string, lang string")
    langs, p = learn(docs, F.lit(True), Mixture(per_language=20, bits=10))
    assert langs == ["a", "b"] and np.allclose(p.sum(axis=0), 1)
    got = {r["doc_id"]: r["lang_pred"] for r in identified(docs, langs, p, Mixture(bits=10)).collect()}
    assert all(v == ("a" if i < 1000 else "b") for i, v in got.items())


def test_numbers_that_are_no_digits_are_no_letters(spark):
    texts = ["½²", "¹³ ¼", "①", "Ⅷ ⅷ", "12", "!?", "_", "日本", "é"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(100 + i, f"some words {i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_digests(docs).collect()}
    assert [got[i] for i in range(len(texts))] == ["und"] * 7 + ["en"] * 2
