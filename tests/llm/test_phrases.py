"""Phrase mining against plain counting, for several numbers of shards and filters so small that they let almost everything through."""

import random
import re
from collections import Counter

import duckdb
import pytest

from molquarry.llm import phrases
from molquarry.llm.phrases import PhraseMining, collocations, cut, frequent_phrases

DOCS = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, m):
    f, n = plain_counts(rows, m.longest)
    of = {}
    for (lang, p), a in f.items():
        if a >= m.least and len(p) > 1:
            of.setdefault(lang, {})[p] = a
    out = []
    for lang, cands in of.items():
        told = []
        for p, a in cands.items():
            inside = any(len(q) > len(p) and 100 * b >= m.share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items())
            if inside:
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            told.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(told)[: m.top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return Counter(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["ab", "cd", "É", "x y", "The", "THE", "q", "w\x1cv", "zz", "ß"]
    rows = []
    for i in range(n):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "!"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, t, rng.choice(["en", "fr", None, "und"])))
    phrase = "one two three four five six"
    rows += [(n + i, f"{phrase} {i}. {phrase}", "en") for i in range(9)]
    return rows


@pytest.mark.parametrize(("shards", "bits"), [(1, 28), (2, 28), (3, 6), (5, 28)])
def test_matches_plain_counting(spark, shards, bits):
    rows = texts(shards, 120) + [(None, None, "en"), (1, "", None), (1, "alone", None), (1, "...", "de")]
    m = PhraseMining(least=7, shards=shards, filter_bits=bits, top=40)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert Counter(tuple(r) for r in collocations(df, m).collect()) == plain(rows, m)


@pytest.mark.parametrize("shards", [2, 4])
def test_late_phrases_are_counted_for_a_whole_cycle(spark, shards):
    """Rows in order, one partition: the threshold is reached in the last shard, or at the very last row."""
    rows = [(i, "rare pair here now" if i >= 40 else "other words", "en") for i in range(47)] + [(90 + i, "a b c d e", "en") for i in range(7)]
    m = PhraseMining(least=7, shards=shards)
    found, sizes = frequent_phrases(spark.createDataFrame(rows, DOCS).coalesce(1), m)
    f, n = plain_counts(rows, 5)
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["a"] for r in found.collect()} == {p: a for p, a in f.items() if a >= 7}
    assert {r["lang"]: r["n"] for r in sizes.collect()} == dict(n)


def test_share_and_copies_and_extra_columns(spark):
    rows = [(1, "new york city. new york state. new york city", "en")] * 20
    for share in (100, 60):
        m = PhraseMining(least=10, share=share)
        df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as k", "2 as phrase", "'x' as h", "3 as shard", "4 as n")
        assert Counter(tuple(r) for r in collocations(df, m).collect()) == plain(rows, m)


def test_long_text_is_cut_between_pieces(spark):
    text = b"A b, c " * 50
    assert b"".join(cut(text, 40)) == text.translate(phrases._PIECES)
    assert all(part.endswith(b".") for part in list(cut(text, 40))[:-1])
    assert list(cut(b"abc def", 3)) == [b"abc def"] and list(cut(b"", 3)) == []
    rows = [(1, "word pair, " * 200_000 + "word pair", "en"), (2, "word pair", None)]
    m = PhraseMining()
    assert Counter(tuple(r) for r in collocations(spark.createDataFrame(rows, DOCS), m).collect()) == plain(rows, m)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, "en"), (2, " ", "en")], DOCS)).count() == 0


def test_matches_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}')")
    want = con.execute(f"select lang, rank, phrase, a, l, r, n, score from ({phrases.SQL})").fetchall()
    assert Counter(tuple(r) for r in collocations(spark.read.parquet(path)).collect()) == Counter(want)
