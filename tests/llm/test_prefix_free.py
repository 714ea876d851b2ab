import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from molquarry.llm import prefix_free
from molquarry.llm.prefix_free import Repeats, repeat_digests, repeats_removed

SF = "/root/testdata/sf0.001"


def brute(rows, length=200):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc_id, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((doc_id, len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def ours(spark, rows, spec=Repeats()):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, row string").repartition(3)
    return sorted(map(tuple, repeat_digests(docs, spec).collect()), key=str)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert ours(spark, rows) == brute(rows)


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(n)) for n in (12, 25, 60)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.7:
            p = rng.choice(passages)
            parts.insert(rng.randint(0, len(parts)), p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)])
        rows.append((i, "".join(parts)))
    return rows + [(100, "x" * 90), (101, "x" * 95), (102, "ab" * 70), (103, "abc" * 60), (104, None), (105, ""), (7, rows[7][1]), (None, rows[9][1])]


@pytest.mark.parametrize("seed, crowd", [(1, 20_000), (2, 2)])
def test_short_strings_against_brute_force(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(prefix_free, "CROWD", crowd)
    assert ours(spark, made(seed), Repeats(length=40, gram=12)) == brute(made(seed), 40)


def test_exact_lengths(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p199, p200, p201 = text(199), text(200), text(201)
    rows = [(1, "1" + p199 + "2"), (2, "3" + p199 + "4"), (3, "5" + p200 + "6"), (4, p200), (5, "7" + p201), (6, p201 + "8" + text(3000)), (7, "z" * 399), (8, "y" * 200), (9, "é" * 150)]
    got = ours(spark, rows)
    assert got == brute(rows)
    assert {r[0]: r[2] for r in got} == {1: 0, 2: 0, 3: 200, 4: 200, 5: 201, 6: 201, 7: 399, 8: 0, 9: 300}


def test_removed_text_and_empty_table(spark):
    p = "".join(random.Random(8).choice("abcdefgh ") for _ in range(300))
    docs = spark.createDataFrame([(1, p + "tail", 304, "s"), (2, "é" + p, 301, None), (3, p, 300, "s"), (4, None, None, "s"), (5, "short", 5, "s")], "doc_id long, text string, n_chars long, source string")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in repeats_removed(docs).collect()}
    assert got == {1: ("tail", 4), 2: ("é", 1), 3: ("", 0), 4: (None, None), 5: ("short", 5)}
    assert repeat_digests(docs.limit(0)).collect() == []


def test_suffix_ranks_are_byte_order():
    rng = random.Random(6)
    for length in (5, 8, 20, 200):
        bodies = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(length, length + 150))) for _ in range(30)] + [b"a" * (length + 90)] * 2
        data, starts, at = b"".join(bodies), [], 0
        for b in bodies:
            starts += range(at, at + len(b) - length + 1)
            at += len(b)
        strings = [data[s : s + length] for s in starts]
        place = {s: i for i, s in enumerate(sorted(set(strings)))}
        assert prefix_free.suffix_ranks(data, np.array(starts), length).tolist() == [place[s] for s in strings]


def test_pieces_have_all_windows_and_their_triggers(monkeypatch):
    rng = random.Random(7)
    spec = Repeats(length=40, gram=12)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (39, 40, 41, 500, 1700, 0)] + [b"z" * 600]

    def windows():
        out = {}
        for number, place, group in prefix_free._pieces(texts, spec):
            for p, first, count, gram in zip(*(x.tolist() for x in prefix_free._phrases(group, spec)[:4])):
                for w in range(count):
                    key = int(number[p]), int(place[p]) + first + w
                    assert key not in out
                    out[key] = gram
        return out

    whole = windows()
    assert set(whole) == {(i, w) for i, t in enumerate(texts) for w in range(len(t) - 39)}
    monkeypatch.setattr(prefix_free, "PIECE", 97)
    monkeypatch.setattr(prefix_free, "SLICE_BYTES", 300)
    assert windows() == whole


def test_very_long_text(spark):
    rng = random.Random(9)
    raw = bytearray(rng.randbytes(10_000_100).hex().encode())  # 20 MB; no 200 bytes of it occur twice
    passage = rng.randbytes(300).hex()
    for at in (999_900, 7_000_000, 19_999_000):  # one over the border of two pieces
        raw[at : at + 600] = passage.encode()
    other = "q" + raw[4_000_000:4_003_000].decode() + "w"
    rows = [(1, raw.decode()), (2, other), (3, None)]
    spans = {1: [(999_900, 1_000_500), (4_000_000, 4_003_000), (7_000_000, 7_000_600), (19_999_000, 19_999_600)], 2: [(1, 3001)], 3: []}
    want = []
    for i, t in rows:
        kept, at = b"", 0
        for a, b in spans[i]:
            kept, at = kept + (t or "").encode()[at:a], b
        kept += (t or "").encode()[at:]
        want.append((i, len((t or "").encode()), sum(b - a for a, b in spans[i]), len(spans[i]), hashlib.sha256(kept).hexdigest()))
    assert ours(spark, rows) == want


def test_powers_are_exact_and_take_memory_as_texts_do():
    """A worker keeps no table of all powers: it did keep 64 MB, whatever the texts."""
    rng = random.Random(5)
    places = [0, 1, 2047, 2048, 2049, (1 << 22) - 1, *(rng.randrange(1 << 22) for _ in range(50))]
    for base in (prefix_free.BASE, prefix_free.INVERSE):
        powers = prefix_free._powers(base, 1 << 22)
        assert len(powers) == 1 << 22 and all(int(powers[i]) == pow(base, i, 1 << 64) for i in places)
        assert [len(prefix_free._powers(base, n)) for n in (1, 2047, 2048, 2049)] == [1, 2047, 2048, 2049]
    del powers
    prefix_free._steps.cache_clear()
    tracemalloc.start()
    prefix_free._rolling(np.zeros(10_000, np.uint8), 48)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 2_000_000
