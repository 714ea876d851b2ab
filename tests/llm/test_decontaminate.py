import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow.parquet as pq

from molquarry.llm.decontaminate import Tiling, contaminated, decontaminated, greedy_tiles

SF = "/root/testdata/sf0.001"


def split(text):
    return [w.encode() for w in split_folded(text)]


def brute_marked(a, b, k):
    """Words of a marked by taking the longest common unmarked run again and again."""
    free_a, free_b, marked = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for q in range(len(b)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and free_a[p + n] and free_b[q + n]:
                    n += 1
                best = max(best, (n, -p, -q))
        n, p, q = best[0], -best[1], -best[2]
        if n < min(k, len(a)) or n == 0:
            return marked
        for i in range(n):
            free_a[p + i] = free_b[q + i] = False
        marked += n


def test_tiles_are_disjoint_and_greedy():
    rng = random.Random(2)
    for _ in range(60):
        a = np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 25))], np.uint64)
        b = np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 50))], np.uint64)
        tiles = greedy_tiles(a, b, 3)
        for side in (1, 2):
            places = [t[side] + i for t in tiles for i in range(t[0])]
            assert len(places) == len(set(places))
        assert all((a[p : p + n] == b[q : q + n]).all() and n >= min(3, len(a)) for n, p, q in tiles)
        assert not tiles or max(t[0] for t in tiles) == tiles[0][0]


def test_documents_against_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    rng = random.Random(3)
    for i, item in enumerate(items[:12]):  # reordered halves, parts, changed words
        w = item["text"].split()
        h = len(w) // 2
        docs += [{"doc_id": 10_000 + 3 * i, "text": "x y " + " ".join(w[h:]) + " between them " + " ".join(w[:h])}, {"doc_id": 10_001 + 3 * i, "text": " ".join(w[: h + 2])}]
        w[rng.randrange(len(w))] = "changed"
        docs.append({"doc_id": 10_002 + 3 * i, "text": "lead " + " ".join(w).upper()})
    given = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(r["item_id"], r["text"]) for r in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["marked_words"] for r in contaminated(given, bench).collect()}
    want = {}
    for d in docs:
        b = split(d["text"])
        if len(b) > 1500:
            continue
        grams = {tuple(b[i : i + 5]) for i in range(len(b) - 4)}
        for item in items:
            a = split(item["text"])
            if any(tuple(a[i : i + 5]) in grams for i in range(len(a) - 4)):
                marked = brute_marked(a, b, 5)
                if 100 * marked >= 80 * len(a):
                    want[d["doc_id"], item["item_id"]] = marked
    long = {d["doc_id"] for d in docs if len(split(d["text"])) > 1500}
    assert {k: v for k, v in got.items() if k[0] not in long} == want
    assert all((10_000 + 3 * i, items[i]["item_id"]) in got for i in range(12))
    clean = {r["doc_id"] for r in decontaminated(given, bench).collect()}
    assert clean == {d["doc_id"] for d in docs} - {k[0] for k in got}
    blocks = {(r["doc_id"], r["item_id"]): r["marked_words"] for r in contaminated(given, bench, Tiling(block_words=200)).collect()}
    assert blocks == got


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "!!!", 1), (None, "Short item", 1), (5, "a short item here", 1), (5, "a short item here", 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, "short item"), (1, "short item"), (2, None), (3, ""), (4, "...")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["marked_words"]) for r in contaminated(docs, items).collect())
    assert got == [(0, 1, 2), (5, 1, 2), (5, 1, 2)]
    assert contaminated(docs, items.limit(0)).collect() == [] == contaminated(docs.limit(0), items).collect()
    assert decontaminated(docs, items.limit(0)).count() == 6


def test_case_of_all_letters(spark):
    texts = [
        "la educación del niño pequeño mejoró según la opinión pública en aquel año",
        "l'élève français répète où naît la forêt à côté du château brûlé",
        "die größte Straße führt über schöne Brücken weiß und süß nach Hause",
        "ο μικρός δρόμος της πόλης είναι ΐσως καλός και όμορφος τόπος",
    ]
    low = [unicodedata.normalize("NFC", t) for t in texts]
    forms = [unicodedata.normalize(f, t) for t in low for f in ("NFC", "NFD")]
    docs = [(i, way(t)) for i, (t, way) in enumerate(itertools.product(forms, (str, str.upper, str.title)))]
    given = spark.createDataFrame(docs, "doc_id long, text string")
    for way in (str, str.upper):
        items = spark.createDataFrame([(i, way(t)) for i, t in enumerate(low)], "item_id long, text string")
        got = {(r["doc_id"], r["item_id"], r["coverage"]) for r in contaminated(given, items).collect()}
        assert got == {(i, i // 6, 1.0) for i, _ in docs}
        assert decontaminated(given, items).count() == 0


def split_folded(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", unicodedata.normalize("NFC", (text or "").casefold()))


def test_a_seed_that_all_items_share(spark):
    """Two thousand items share a sentence; documents with it alone hold none of them."""
    rng = random.Random(12)
    common = " ".join(f"c{i}" for i in range(9))
    own = [[f"o{i}x{j}" for j in range(rng.randint(12, 30))] for i in range(2000)]
    items = [(i, " ".join([*w[:5], common, *w[5:]])) for i, w in enumerate(own)]
    docs = [(i, f"lead {i} {common} tail") for i in range(300)] + [(1000 + i, "x " + items[i * 7][1] + " y") for i in range(20)]
    given, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(given, bench).collect()}
    assert got == {(1000 + i, i * 7) for i in range(20)}
    assert decontaminated(given, bench).count() == 300


def test_very_long_document(spark):
    rng = random.Random(13)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(200_000)]
    item = [f"q{i}" for i in range(30)]
    words[150_000:150_000] = [*item[15:], "between", *item[:15]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w " * 100_000)], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item)), (8, "w " * 40)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["marked_words"]) for r in contaminated(docs, items).collect()} == {(1, 9, 30), (2, 8, 40)}


def test_documents_without_case_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist() if len(split_folded(r["text"])) <= 1500]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    docs += [(10_000 + i, "lead " + t.replace(" ", " changed ", 1).upper()) for i, t in items if not t.isascii()]
    given, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["marked_words"] for r in contaminated(given, bench).collect()}
    want = {}
    for i, text in docs:
        b = split_folded(text)
        grams = {tuple(b[p : p + 5]) for p in range(len(b) - 4)}
        for j, item in items:
            a = split_folded(item)
            if any(tuple(a[p : p + 5]) in grams for p in range(len(a) - 4)) and 100 * (marked := brute_marked(a, b, 5)) >= 80 * len(a):
                want[i, j] = marked
    assert got == want and any(i >= 10_000 for i, _ in want)
    assert {r["doc_id"] for r in decontaminated(given, bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}
