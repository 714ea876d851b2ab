import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from molquarry.llm import jaccard_join
from molquarry.llm.components import components
from molquarry.llm.jaccard_join import JaccardJoin, alike, frequency_sketch, jaccard_components, near_duplicates_removed

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, k=4, num=85, den=100):
    sets = []
    for _, text in rows:
        w = WORDS.findall(lowered(text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and den * inter >= num * (len(sets[i]) + len(sets[j]) - inter):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    key = lambda t: tuple(-1 if x is None else x for x in t)
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=key)


def ours(spark, rows, join=JaccardJoin()):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, node string").repartition(3)
    return sorted(map(tuple, jaccard_components(docs, join).collect()), key=lambda t: tuple(-1 if x is None else x for x in t))


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize(("short_list", "sent_pairs"), [(2, 1_000_000), (24, 1_000_000), (24, 0)])
@pytest.mark.parametrize("edits", [(0, 2), (1, 4), (2, 2)])
def test_large_groups_of_near_copies(spark, edits, short_list, sent_pairs):
    rng = random.Random(sum(edits) + short_list)
    rows = []
    for g in range(3):
        base = [f"w{rng.randint(0, 60)}" for _ in range(rng.choice([30, 60, 110]))]
        for _ in range(45):
            words = list(base)
            for _ in range(rng.randint(*edits)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
            if rng.random() < 0.3:
                words += [f"y{rng.randint(0, 5)}"] * rng.randint(1, 3)
            rows.append((len(rows) * 7 % 1000, " ".join(words)))
    rows += [(2000 + i, "common passage of words that many texts share here and there " + " ".join(f"z{rng.randint(0, 99)}" for _ in range(8))) for i in range(40)]
    join = JaccardJoin(short_list=short_list, pivots=1 if short_list == 2 else 3, sketch_bits=12, sent_pairs=sent_pairs)
    assert ours(spark, rows, join) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \n\t"), (2, "One"), (1, "oNE "), (8, "a b c"), (9, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "lonely words of a text"), (11, "É b c d"), (12, "é b c d"), (13, "w " * 30_000)]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, []) == []


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g h i j", 1), (1, "a b c d e f g h i j", 2), (1, "a b c d e f g h i j", 2), (2, "other text with words", 3), (4, None, 4), (5, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted(r["doc_id"] for r in near_duplicates_removed(docs, JaccardJoin(k=5, num=80)).collect()) == [1, 2, 4, 5]


def test_many_unlinked_documents_around_a_common_passage(spark):
    """Each has a tenth of its own words around one passage: their similarity is under the threshold, and none may meet all others."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(i, " ".join(f"o{i}x{j}" for j in range(rng.randint(13, 15))) + " " + passage) for i in range(2500)]
    rows += [(3000, rows[7][1] + " end"), (3001, "start " + rows[1200][1])]
    join = JaccardJoin(sketch_bits=16)
    got = {d: (n, c) for d, n, c in ours(spark, rows, join)}
    assert {d: c for d, (_, c) in got.items()} == {i: i for i in range(2500)} | {3000: 7, 3001: 1200}
    assert all(got[i][0] == len(t.split()) - 3 for i, t in rows)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(700)] + [(2000, 2001), (5, None), (9, 9)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(701)} | {2000: 2000, 2001: 2000}


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_sketch_counts_every_document_once(spark, fan):
    """However many levels of sums there are; tasks without texts give no arrays."""
    texts = [None, "", "a b c d e"] + ["a b c d e f"] * 300 + [f"w{i} x y z" for i in range(40)]
    join = JaccardJoin(sketch_bits=8)
    got = frequency_sketch(spark.createDataFrame([(t,) for t in texts], "text string").repartition(11), join, fan)
    # a b c d and b c d e 301 times, c d e f 300 times, each w shingle once
    assert got.sum() == 2 * 301 + 300 + 40 and len(got) == 256 and got.max() >= 300
    assert not frequency_sketch(spark.createDataFrame([], "text string"), join, fan).any()


def test_rows_are_kept_by_row_not_by_id(spark):
    a, c, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "acb")
    rows = [(3, a), (5, c), (5, a + " more"), (None, b + " more"), (2, b), (None, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int").selectExpr("*", "'x' as stays", "1 as place").repartition(3)
    kept = near_duplicates_removed(docs, JaccardJoin(k=5, num=80))
    assert kept.columns == docs.columns
    assert sorted(r["row"] for r in kept.collect()) == [0, 1, 4, 5]
    twice = near_duplicates_removed(docs.union(docs), JaccardJoin(k=5, num=80)).collect()
    assert sorted(r["row"] for r in twice) == [0, 1, 4, 5]
    nulls = spark.createDataFrame([(None, a), (None, a), (None, a + " more"), (None, ""), (None, ""), (7, ""), (None, None)], "doc_id long, text string")
    left = sorted(((r["doc_id"], r["text"]) for r in near_duplicates_removed(nulls, JaccardJoin(k=5, num=80)).collect()), key=str)
    assert len([t for _, t in left if t and t.startswith("a0")]) == 1 and [x for x in left if not x[1]] == sorted([(7, ""), (None, ""), (None, None)], key=str)


def test_sets_of_pairs_that_share_a_passage_by_chance_are_not_gathered(spark, monkeypatch):
    """Only the sets of pairs that may link are shuffled; the coarse sketch lets nearly every pair with a common passage be found."""
    rng = random.Random(9)
    rows = []
    for g in range(40):
        passage = [f"p{g}x{j}" for j in range(30)]
        rows += [(2 * g + i, " ".join(passage + [f"o{g}x{i}x{j}" for j in range(rng.randint(160, 180))])) for i in range(2)]
    rows += [(100 + d, rows[d][1] + " end") for d in (3, 8, 21)]
    gathered, gather = [], jaccard_join.candidate_sets

    def noted(docs, ids, join):
        gathered.extend(ids.distinct().collect())
        return gather(docs, ids, join)

    monkeypatch.setattr(jaccard_join, "candidate_sets", noted)
    assert ours(spark, rows, JaccardJoin(sketch_bits=4)) == brute(rows)
    assert len(gathered) == 6


@pytest.mark.parametrize("join", [JaccardJoin(), JaccardJoin(num=30), JaccardJoin(sent_pairs=0)])
def test_parities_drop_no_pair_that_links(spark, join):
    """Sets of all ratios of size, with just enough in common to link; sets without anything in common go at high thresholds, but for very small ones."""
    rng = np.random.default_rng(5)
    rows, linked, unlike = [], [], []

    def add(x):
        rows.append((len(rows), bytes([len(rows) % 251, len(rows) // 251]), len(x), jaccard_join._parity(x).tolist()))
        return len(rows) - 1

    fresh = lambda n: np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
    for n in (1, 2, 7, 63, 64, 65, 128, 129, 400, 513, 1000, 5000):
        for m in sorted({n, -(-n * join.num // join.den), (n + -(-n * join.num // join.den)) // 2}):
            common = join.least_shared(n + m)
            if common <= m:
                x = fresh(n)
                linked.append((add(x), add(np.concatenate([x[:common], fresh(m - common)]))))
            unlike.append((add(fresh(n)), add(fresh(m))))
    schema = "id long, node binary, n long, parity array<long>"
    other = (linked[0][0], b"another set of this id", 5000, jaccard_join._parity(fresh(5000)).tolist())
    parities, pairs = spark.createDataFrame([*rows, other], schema), spark.createDataFrame(linked + unlike, "a long, b long")
    got = sorted(map(tuple, alike(pairs, parities, join).collect()))
    assert set(linked) <= set(got) and len(got) == len(set(got))
    if join.num > 50:  # a lower threshold leaves more room than the parities of unlike sets differ in
        assert all(rows[a][2] < 64 for a, b in set(got) - set(linked))
