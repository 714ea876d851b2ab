"""The vector operators against plain ones: nearest neighbours by distance to all, codes by distance to all entries."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from molquarry.llm import vector_codes
from molquarry.llm.cross_polytope import CrossPolytope, Rotations, hadamard, neighbours
from molquarry.llm.vector_codes import ProductCodes, Slices, code_digests, coded, codebook_digest, decoded, trained

SF = "/root/testdata/sf0.01"
ROWS = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def usable(v, dim, zero):
    return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))


def plain_neighbours(rows, k, asked):
    rows = [(i, np.array(v, np.float64)) for i, v, _ in rows]
    out = []
    for at, (i, v) in enumerate(rows):
        if i is None or not asked(i):
            continue
        near = sorted(((float(np.sqrt(((v - w) ** 2).sum())), (1, 0) if j is None else (0, j)) for b, (j, w) in enumerate(rows) if b != at))[:k]
        out += [(i, r + 1, None if j[0] else j[1], round(d, 9)) for r, (d, j) in enumerate(near)]
    return Counter(out)


def found(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


def test_bucket_is_the_first_probe():
    turns = Rotations(12, 2, CrossPolytope())
    x = np.random.default_rng(2).normal(size=(50, 12))
    for t in range(turns.tables):
        assert (turns.scores(x, t).argmax(axis=1) == turns.bucket(x, t)).all()


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], i % 3) for i in range(60)]
    rows += [(60 + i, rows[7][1], None) for i in range(20)]  # copies
    rows += [(i, [float(x) for x in rng.integers(-1, 2, 6)], 5) for i in range(80, 140)]  # many ties
    rows = [r for r in rows if any(r[1])]
    rows += [(10, rows[7][1], 1), (10, rows[7][1], 1), (20, rows[0][1], None), (None, rows[5][1], 0), (None, rows[5][1], 0)]
    bad = [(200, None, 1), (210, [0.0] * 6, 1), (220, [None] + [1.0] * 5, 1), (230, [float("nan")] * 6, 1), (240, [float("inf")] + [0.0] * 5, 2), (250, [1.0] * 5, 1), (260, [], 1)]
    return rows, bad


def test_neighbours_of_odd_rows_in_all_buckets(spark):
    """With all buckets probed, the search is exact: copies, ties, repeated and null ids, rows that take no part."""
    rows, bad = odd_rows()
    got = found(neighbours(table(spark, rows + bad), "vec_id % 10 = 0", CrossPolytope(probes=1 << 14)))
    want = plain_neighbours(rows, 10, lambda i: i % 10 == 0)
    assert got == want


def test_tiles_change_nothing(spark):
    rows, bad = odd_rows()
    df = table(spark, rows + bad).repartition(5)
    one = found(neighbours(df, "vec_id % 5 = 0", CrossPolytope(probes=1 << 14)))
    assert found(neighbours(df, "vec_id % 5 = 0", CrossPolytope(probes=1 << 14, tile_rows=3, tile_queries=2))) == one
    assert found(neighbours(df, "vec_id % 5 = 0", CrossPolytope(probes=1 << 14, wide=1))) == one


@pytest.mark.parametrize("wide", [10**9, 1])
def test_recall(spark, wide):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    want = plain_neighbours(rows, 10, lambda i: i % 10 == 0)
    got = found(neighbours(df, "vec_id % 10 = 0", CrossPolytope(wide=wide)))
    pairs = lambda c: {(q, v, d) for q, _, v, d in c}
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(pairs(want))
    assert sum(got.values()) == sum(want.values())


def test_few_and_no_rows(spark):
    few = [(100, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.5], 1)]
    assert found(neighbours(table(spark, few), "vec_id % 100 = 0")) == plain_neighbours(few, 10, lambda i: i % 100 == 0)
    assert neighbours(table(spark, few[:1]), "vec_id % 100 = 0").count() == 0
    assert neighbours(table(spark, []), "vec_id % 100 = 0").count() == 0
    assert neighbours(table(spark, few[1:]), "vec_id % 100 = 0").count() == 0
    extra = table(spark, few).selectExpr("*", "1 as key", "2 as tile", "'x' as v", "3 as ids")
    assert neighbours(extra, "vec_id % 100 = 0").count() == 2


def plain_codes(rows, codes, dim):
    rows = [r for r in rows if usable(r[1], dim, True)]
    width = dim // codes.parts
    whole = [[int(np.floor(codes.scale * np.float64(x))) for x in r[1]] for r in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[: codes.entries]
    out = [[] for _ in rows]
    errors, final = [0] * len(rows), []
    for p in range(codes.parts):
        parts = [w[p * width : (p + 1) * width] for w in whole]
        book = [parts[i] for i in first]
        for turn in range(codes.rounds + 1):
            at = [min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book)) for x in parts]
            if turn < codes.rounds:
                got = defaultdict(list)
                for x, (_, i) in zip(parts, at):
                    got[i].append(x)
                book = [[sum(c) // len(got[i]) for c in zip(*got[i])] if got[i] else e for i, e in enumerate(book)]
        for i, (d, e) in enumerate(at):
            out[i].append(e)
            errors[i] += d
        final += [v for e in book for v in e]
    per_label = Counter()
    for r, e in zip(rows, errors):
        per_label[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, final)).encode()).hexdigest()
    return Counter((r[0], bytes(c).hex(), e, per_label[r[2]], digest) for r, c, e in zip(rows, out, errors))


def test_slices_find_the_nearest_entry():
    rng = np.random.default_rng(4)
    for d, spread in ((1, 5), (4, 3), (4, 400), (3, 1 << 26)):
        entries, x = rng.integers(-spread, spread + 1, (64, d)), rng.integers(-spread, spread + 1, (500, d))
        full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        entry, best = Slices(entries).nearest(x)
        assert (entry == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], [None, 1, 2][i % 3]) for i in range(40)]
    rows += [(7, rows[3][1], None), (None, rows[3][1], 2), (3, rows[9][1], 1), (50, [0.0] * 8, 1)]
    bad = [(0, None, 1), (1, [None] + [1.0] * 7, 1), (2, [float("nan")] * 8, 2), (3, [float("-inf")] + [0.0] * 7, 2), (4, [1.0] * 7, 1), (5, [], 1), (6, [1.0] * 16, 1)]
    codes = ProductCodes(parts=4, entries=8)
    df = table(spark, rows + bad).selectExpr("*", "1 as code", "2 as error", "3 as of")
    got = Counter(tuple(r) for r in code_digests(df, codes).collect())
    assert got == plain_codes(rows, codes, 8)
    again = Counter(tuple(r) for r in code_digests(df, ProductCodes(parts=4, entries=8, sent_labels=0)).collect())
    assert again == got
    assert code_digests(table(spark, [])).count() == 0
    assert code_digests(table(spark, bad[:2])).count() == 0
    few = code_digests(table(spark, rows[:3]), codes)
    assert Counter(tuple(r) for r in few.collect()) == plain_codes(rows[:3], codes, 8)
    assert few.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_decoded_is_within_the_error(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    codes = ProductCodes()
    dim, books = trained(df, "embedding", "vec_id", codes)
    rows = coded(df, "embedding", dim, books, codes).withColumn("y", decoded(vector_codes.F.col("code"), books)).join(df.select("vec_id", "embedding"), "vec_id").collect()
    assert len(rows) == df.count() and len(codebook_digest(books)) == 64
    for r in rows[:100]:
        whole = np.floor(256 * np.array(r["embedding"], np.float64)).astype(np.int64)
        assert ((whole - np.array(r["y"])) ** 2).sum() == r["error"]


def test_codes_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = Counter(con.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({vector_codes.SQL})").fetchall())
    assert Counter(tuple(r) for r in code_digests(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()) == want
