import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from molquarry.operators import classify, nearest, paths, profiles, reach, similarity
from molquarry.plans.queries import QUERIES
from molquarry.plans.tables import Model

MOLS = [(1, True), (2, None), (3, False), (4, False)]
# r1: 1 -> 2, r2: 2 -> 3, r3: 1 -> 3, r4: 3 -> 1 (a cycle), r5: 2 -> 2
STEPS = [(1, 1, 2), (2, 2, 3), (3, 1, 3), (4, 3, 1), (5, 2, 2)]


@pytest.fixture(scope="module")
def toy(spark):
    molecules = spark.createDataFrame(MOLS, "inchikey long, commercially_available boolean")
    reactions = spark.createDataFrame([(1, "c1", 50.0), (2, "c2", 80.0), (3, "c3", None), (4, "c4", 10.0), (5, "c5", 0.0)], "reaction_id long, reaction_class string, yield_pct double")
    rows = [(r, a, "reactant") for r, a, _ in STEPS] + [(r, b, "product") for r, _, b in STEPS]
    return molecules, reactions, spark.createDataFrame(rows, "reaction_id long, inchikey long, role string")


def brute_routes(target, steps, simple=False):
    found = []
    for combo in itertools.product(STEPS, repeat=steps):
        if any(a[2] != b[1] for a, b in zip(combo, combo[1:])) or combo[-1][2] != target or combo[0][1] != 1:
            continue
        ms, used, made = [combo[0][1]] + [c[2] for c in combo], [(c[0], c[1]) for c in combo], [(c[0], c[2]) for c in combo]
        if len(set(used)) < steps or len(set(made)) < steps or (simple and len(set(ms)) < len(ms)):
            continue
        found.append((tuple(ms), tuple(c[0] for c in combo)))
    return sorted(found)


@pytest.mark.parametrize("steps", [1, 2, 3, 4])
@pytest.mark.parametrize("simple", [False, True])
def test_routes_against_brute_force(spark, toy, steps, simple):
    molecules, reactions, components = toy
    targets = spark.createDataFrame([(3,), (2,)], "inchikey long")
    got = paths.route_depth(paths.hops(components), molecules, reactions, targets, steps, simple).collect()
    for t in (2, 3):
        assert sorted((tuple(r["molecules"]), tuple(r["reaction_ids"])) for r in got if r["target"] == t) == brute_routes(t, steps, simple)
    for r in got:
        ys = [{1: 50.0, 2: 80.0, 3: None, 4: 10.0, 5: 0.0}[i] for i in r["reaction_ids"]]
        want = None
        if all(y is not None and y > 0 for y in ys):
            want = 100.0
            for y in ys:
                want = want * y / 100
            want = round(want, 2)
        assert r["total_yield"] == want


def test_search_is_shortest_first_and_capped(spark, toy):
    molecules, reactions, components = toy
    targets = spark.createDataFrame([(3,)], "inchikey long")
    got = paths.route_search(paths.hops(components.repartition(3)), molecules, reactions, targets, max_depth=8, max_routes=3).collect()
    assert sorted((r["steps"], tuple(r["reaction_ids"])) for r in got) == [(1, (3,)), (2, (1, 2)), (3, (1, 5, 2))]


def random_graph(spark, seed, molecules, n):
    """(tables, hops, available): a random graph with cycles, loops and parallel reactions."""
    rng = random.Random(seed)
    hops = sorted({(rng.randint(1, molecules), r, rng.randint(1, molecules)) for r in range(1, n + 1) for _ in range(rng.choice([1, 1, 2]))})
    rows = {(r, a, "reactant") for a, r, _ in hops} | {(r, b, "product") for _, r, b in hops}
    hops = sorted({(a, r, b) for r, a, x in rows if x == "reactant" for q, b, y in rows if q == r and y == "product"})
    ready = {m for m in range(1, molecules + 1) if rng.random() < 0.25} | {1}
    yields = {r: rng.choice([None, 0.0, 10.0, 37.5, 80.0, 95.0]) for r in range(1, n + 1)}
    tables = (
        spark.createDataFrame([(m, m in ready) for m in range(1, molecules + 1)], "inchikey long, commercially_available boolean"),
        spark.createDataFrame([(r, f"c{r}", y) for r, y in yields.items()], "reaction_id long, reaction_class string, yield_pct double"),
        spark.createDataFrame(sorted(rows), "reaction_id long, inchikey long, role string").repartition(3),
    )
    return tables, hops, ready, yields


def plain_search(hops, ready, target, steps, most, simple):
    """All routes by walking forwards, shortest first, then by start, reactions and molecules."""
    out, open_ = [], [((m,), ()) for m in sorted(ready)]
    by = {}
    for a, r, b in hops:
        by.setdefault(a, []).append((r, b))
    for _ in range(steps):
        longer = []
        for ms, rs in open_:
            for r, b in by.get(ms[-1], ()):
                if (b in ms) if simple else ((ms[-1], r) in zip(ms, rs) or (r, b) in zip(rs, ms[1:])):
                    continue
                longer.append((ms + (b,), rs + (r,)))
        open_ = longer
        out += sorted(((len(rs), ms[0], rs, ms) for ms, rs in open_ if ms[-1] == target))
        if len(out) >= most:
            break
    return [(rs, ms) for _, _, rs, ms in out[:most]]


@pytest.mark.parametrize(("seed", "simple", "most"), [(1, False, 3), (2, True, 2)])
def test_search_to_eight_steps_against_walking(spark, seed, simple, most):
    """Lists of two or so routes a molecule: many are cut, some targets are searched again."""
    (molecules, reactions, components), hops, ready, _ = random_graph(spark, seed, 9, 11)
    targets = spark.createDataFrame([(t,) for t in [*range(1, 10), 3, None, 99]], "inchikey long")
    got = {}
    for r in paths.route_search(paths.hops(components), molecules, reactions, targets, max_depth=16, max_routes=most, simple=simple).collect():
        assert r["steps"] == len(r["reaction_ids"]) and r["start"] == r["molecules"][0]
        got.setdefault(r["target"], []).append((r["steps"], r["start"], tuple(r["reaction_ids"]), tuple(r["molecules"])))
    for t in range(1, 10):
        assert [x[2:] for x in sorted(got.get(t, []))] == plain_search(hops, ready, t, 8, most, simple), t
    assert set(got) <= set(range(1, 10))


def test_lists_that_are_too_short_are_searched_again(spark):
    """A cycle eats the first routes of a list: 1 -> 2 -> 1 ... repeat edges, so kept routes go and the ones left out follow."""
    hops = [(1, 1, 2), (2, 2, 1), (2, 3, 3), (1, 4, 3), (3, 5, 4), (1, 6, 2), (4, 7, 1)]
    molecules = spark.createDataFrame([(m, m == 1) for m in range(1, 5)], "inchikey long, commercially_available boolean")
    reactions = spark.createDataFrame([(r, "c", 50.0) for r in range(1, 8)], "reaction_id long, reaction_class string, yield_pct double")
    rows = [(r, a, "reactant") for a, r, _ in hops] + [(r, b, "product") for _, r, b in hops]
    table = paths.hops(spark.createDataFrame(rows, "reaction_id long, inchikey long, role string"))
    wanted, starts = spark.createDataFrame([(4,)], "inchikey long"), paths._starts(molecules)
    sure, doubt = paths._searched(table, starts, wanted, 8, 40, 1, False)
    assert sure.count() == 0 and [r[0] for r in doubt.collect()] == [4]
    got = paths.route_search(table, molecules, reactions, wanted, max_depth=16, max_routes=40).collect()
    assert sorted((r["steps"], tuple(r["reaction_ids"])) for r in got) == [(len(rs), rs) for rs, _ in plain_search(hops, {1}, 4, 8, 40, False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_precursors_of_four_steps_against_all_paths(spark, seed):
    (_, reactions, components), hops, _, yields = random_graph(spark, seed, 12, 40)
    best = {}
    for a, r, b in hops:
        if a != b:
            best.setdefault((a, b), []).append(yields[r])
    best = {k: max((y for y in v if y is not None), default=None) for k, v in best.items()}
    open_, want = {(a, b): y for (a, b), y in best.items()}, {}
    for depth in (2, 3, 4):
        longer = {}
        for path, y in open_.items():
            for (a, b), z in best.items():
                if a == path[-1] and b not in path:
                    longer[path + (b,)] = None if y is None or z is None else y * z / 100
        open_ = longer
        for path, y in open_.items():
            want.setdefault((path[0], path[-1], depth), []).append(y)
    want = {k: max((y for y in v if y is not None), default=None) for k, v in want.items()}
    same = lambda rows, keys: {(r["src"], r["dst"], r["step_count"]): r["total_yield"] for r in rows} == pytest.approx({k: want[k] for k in keys}, abs=0.0051)
    assert same(paths.precursor_edges(components, reactions, max_depth=4).collect(), want)
    assert same(paths.precursor_edges(components, reactions, max_depth=3).collect(), [k for k in want if k[2] < 4])
    of = spark.createDataFrame([(3,), (4,), (4,), (77,)], "inchikey long")
    assert same(paths.precursor_edges(components, reactions, max_depth=4, targets=of).collect(), [k for k in want if k[1] in (3, 4)])
    assert same(paths.precursor_edges(components, reactions, min_depth=4, max_depth=4).collect(), [k for k in want if k[2] == 4])


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_precursors_of_three_steps_by_blocks_and_stretches(spark, monkeypatch, kind):
    """The same rows for any cut of starts and hops, and no table of paths is shuffled or written."""
    monkeypatch.setattr(reach, "STRETCH", 7)
    monkeypatch.setattr(reach, "ROWS", 9)
    (_, reactions, components), hops, _, yields = random_graph(spark, 3, 10, 30)
    components = components.withColumn("inchikey", F.col("inchikey").cast(kind))
    got = paths.precursor_edges(components, reactions)
    best = {}
    for a, r, b in hops:
        if a != b:
            best.setdefault((a, b), []).append(yields[r])
    best = {k: max((y for y in v if y is not None), default=None) for k, v in best.items()}
    want = {}
    for n in (3, 4):
        for path in itertools.permutations(range(1, 11), n):
            if all(x in best for x in zip(path, path[1:])):
                y = 100.0
                for z in (best[x] for x in zip(path, path[1:])):
                    y = None if y is None or z is None else y * z / 100
                want.setdefault((path[0], path[-1], n - 1), []).append(y)
    want = {k: max((y for y in v if y is not None), default=None) for k, v in want.items()}
    assert dict(got.dtypes)["src"] == kind and len(got.collect()) == len(want)
    assert {(int(r["src"]), int(r["dst"]), r["step_count"]): r["total_yield"] for r in got.collect()} == pytest.approx(want, abs=0.0051)
    if kind == "bigint":
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


@pytest.mark.parametrize("seed", [4, 5])
def test_precursors_of_four_steps_by_blocks_and_stretches(spark, monkeypatch, seed):
    (_, reactions, components), *_ = random_graph(spark, seed, 14, 45)
    targets = spark.createDataFrame([(t,) for t in range(1, 13)], "inchikey long")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole = rows(paths.precursor_edges(components, reactions, max_depth=4, targets=targets))
    monkeypatch.setattr(reach, "STRETCH", 5)
    monkeypatch.setattr(reach, "ROWS", 20)
    cut = paths.precursor_edges(components, reactions, max_depth=4, targets=targets)
    assert rows(cut) == whole and any(r[2] == 4 for r in whole)
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()


def test_yields_are_rounded_as_decimals(spark):
    values = [a * b / 100 * c / 100 for a in range(0, 101, 3) for b in (1, 7, 33, 50, 99) for c in (5, 25, 45, 75, 100)] + [0.005, 1.005, 2.675, 33.285]
    rows = spark.createDataFrame([(v,) for v in values], "y double").select("y", F.round("y", 2).alias("r")).collect()
    assert [r["r"] for r in rows] == reach._rounded(np.array([r["y"] for r in rows])).tolist()


def test_precursors(toy):
    _, reactions, components = toy
    got = {(r["src"], r["dst"], r["step_count"]): r["total_yield"] for r in paths.precursor_edges(components, reactions, max_depth=3).collect()}
    assert got == {(1, 3, 2): 40.0, (2, 1, 2): 8.0, (3, 2, 2): 5.0}


def test_similarity_join_against_brute_force(spark):
    rng = random.Random(3)
    sets = [(i, sorted(rng.sample([f"t{x}" for x in range(30)], rng.randint(0, 12)))) for i in range(150)]
    sets += [(200 + i, s) for i, (_, s) in enumerate(sets[:20])] + [(300 + i, sorted([*s, "z"])) for i, (_, s) in enumerate(sets[:40])]
    df = spark.createDataFrame(sets, "id long, items array<string>")
    first = {}
    for i, s in sets:
        if s:
            first[tuple(s)] = min(i, first.get(tuple(s), i))
    reps = {i: set(s) for s, i in first.items()}
    for num, den in ((1, 2), (4, 5), (1, 1)):
        want = {(a, b) for a in reps for b in reps if a < b and len(reps[a] & reps[b]) * den >= len(reps[a] | reps[b]) * num}
        assert {(r["a"], r["b"]) for r in similarity.similar_edges(df, num, den).collect()} == want
    capped = similarity.similar_edges(df, 1, 2, max_neighbours=1)
    assert capped.groupBy("a").count().where("count > 1").count() == 0


@pytest.mark.parametrize(("bits", "pairs"), [(20, 1_000_000), (2, 0)])
def test_similarity_join_writes_prefixes_and_candidates_alone(spark, monkeypatch, bits, pairs):
    """Exact for any sketch of counts, and whole sets of items are written for candidates only."""
    monkeypatch.setattr(similarity, "SKETCH", bits)
    monkeypatch.setattr(similarity, "PAIRS", pairs)
    made, written = {}, similarity.written

    def noted(df, tag):
        table = written(df, tag)
        arrays = [c for c, kind in table.dtypes if kind.startswith("array")]
        made[tag] = table.agg(F.sum(F.size(arrays[0])) if arrays else F.count("*")).first()[0]
        return table

    monkeypatch.setattr(similarity, "written", noted)
    rng = random.Random(bits)
    sets = [(i, sorted(f"{i}-{x}" if x > 4 else f"t{rng.randint(0, 40)}" for x in range(60))) for i in range(40)]
    sets += [(100 + i, sorted([*s[1:], "z"])) for i, s in sets[:5]] + [(200 + i, s) for i, s in sets[:3]] + [(None, sets[0][1]), (300, []), (301, None)]
    sets = [(i, None if s is None else sorted(set(s))) for i, s in sets]
    reps = {}
    for i, s in sets:
        if i is not None and s:
            reps[tuple(s)] = min(i, reps.get(tuple(s), i))
    want = {(a, b): round(len(set(s) & set(t)) / len(set(s) | set(t)), 4) for s, a in reps.items() for t, b in reps.items() if a < b and 20 * len(set(s) & set(t)) >= 17 * len(set(s) | set(t))}
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.similar_edges(spark.createDataFrame(sets, "id long, items array<string>"), 85, 100).collect()}
    assert got == pytest.approx(want, abs=1e-4) and len(want) == 5
    every = sum(len(s) for _, s in sets if s)
    assert made["sets"] < every / 4 and made["candidates"] < every / 2


@pytest.mark.parametrize("most", [2, 7])
def test_similarity_join_splits_the_sets_of_a_common_item(spark, monkeypatch, most):
    """Items that many sets have in their prefixes are dealt into blocks; all pairs are found, each once."""
    monkeypatch.setattr(similarity, "LIST", most)
    rng = random.Random(most)
    sets = [(i, sorted({"common", *rng.sample([f"t{x}" for x in range(12)], rng.randint(1, 9))})) for i in range(120)]
    sets += [(500 + i, [f"s{k}" for k in range(70 + i)]) for i in range(9)]  # cells of several sizes
    first = {}
    for i, s in sets:
        first[tuple(s)] = min(i, first.get(tuple(s), i))
    reps = {i: set(s) for s, i in first.items()}
    for num, den in ((1, 2), (17, 20)):
        want = sorted((a, b) for a in reps for b in reps if a < b and len(reps[a] & reps[b]) * den >= len(reps[a] | reps[b]) * num)
        got = similarity.similar_edges(spark.createDataFrame(sets, "id long, items array<string>"), num, den).collect()
        assert sorted((r["a"], r["b"]) for r in got) == want


@pytest.mark.parametrize(("threshold", "limit", "n_words"), [(0.5, 3, 1), (0.7, 10, 2), (0.85, 2, 1)])
def test_bit_index_against_all_pairs(spark, threshold, limit, n_words):
    rng = random.Random(limit)
    sign = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    base = [[rng.getrandbits(64) for _ in range(n_words)] for _ in range(40)]
    rows = [(i, list(w)) for i, w in enumerate(base)]
    for i in range(160):  # near copies and copies
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(n_words)] ^= 1 << rng.randrange(64)
        rows.append((100 + i, w))
    rows += [rows[3], rows[3], (3, base[5]), (900, [0] * n_words)]
    rows = [(i, [sign(x) for x in w]) for i, w in rows] + [(901, None), (None, [1] * n_words)]
    df = spark.createDataFrame(rows, "id long, words array<long>").repartition(3)
    bits = lambda w: {64 * k + b for k, x in enumerate(w) for b in range(64) if x >> b & 1}
    known = [(i, bits(w)) for i, w in rows if i is not None and w is not None]
    for asked in (df, df.where("id % 3 = 0")):
        want = []
        for q, a in {(i, frozenset(b)) for i, b in known if asked is df or i % 3 == 0}:
            hits = sorted((-len(a & b) / len(a | b), x) for x, b in known if x != q and a | b and len(a & b) / len(a | b) > threshold)
            want += [(q, hits_) for hits_ in hits]
        best = {}
        for q, (s, x) in want:
            best.setdefault(q, []).append((s, x))
        want = sorted((q, x, -s) for q, h in best.items() for s, x in sorted(h)[:limit])
        got = sorted((r["query"], r["id"], r["similarity"]) for r in similarity.sim_search_indexed(df, asked, threshold, limit).collect())
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 6e-5 for a, b in zip(got, want))
    assert similarity.sim_search_indexed(df, df.limit(0), threshold, limit).collect() == []


def test_bit_index_is_chosen_by_size(spark, monkeypatch):
    df = spark.createDataFrame([(1, [7]), (2, [7]), (3, [15]), (4, [8])], "id long, words array<long>")
    few = sorted(map(tuple, similarity.sim_search_batch(df, df, 0.7).collect()))
    monkeypatch.setattr(similarity, "BLOCK", 2)
    assert sorted(map(tuple, similarity.sim_search_batch(df, df, 0.7).collect())) == few == [(1, 2, 1.0), (1, 3, 0.75), (2, 1, 1.0), (2, 3, 0.75), (3, 1, 0.75), (3, 2, 0.75)]
    assert similarity._radii(11, 4) == [2, 2, 2, 2] and similarity._radii(12, 4) == [3, 2, 2, 2] and similarity._radii(1, 4) == [0, 0, -1, -1]


@pytest.mark.parametrize("n_words", [1, 2])
def test_best_hits_in_tiles_against_brute_force(spark, monkeypatch, n_words):
    """Many ties, equal sets, repeated rows and queries, sets without bits; small blocks and pieces. Only hits leave a task."""
    monkeypatch.setattr(nearest, "QUERIES", 9)
    monkeypatch.setattr(nearest, "PIECE", 13)
    rng = random.Random(n_words)
    word = lambda: rng.getrandbits(63) & rng.getrandbits(63) if rng.random() < 0.5 else -rng.getrandbits(3) - 1
    rows = [(i, [word() for _ in range(n_words)]) for i in range(150)]
    rows += [(200 + i, w) for i, w in rows[:40]] + rows[:5] + [(300 + i, rows[7][1]) for i in range(30)] + [(400, [0] * n_words), (401, None), (None, [1] * n_words), (402, [None] * n_words)]
    df = spark.createDataFrame(rows, "id long, words array<long>").repartition(3)
    asked = df.where("id % 3 = 0 or id is null")
    bits = [(i, [x & (1 << 64) - 1 for x in w]) for i, w in rows if i is not None and w is not None and None not in w]
    queries = sorted({(i, tuple(w)) for i, w in bits if i % 3 == 0})
    total = lambda a, b, f: sum(f(x, y).bit_count() for x, y in zip(a, b))

    def want(t, inclusive, limit, with_self, queries=queries):
        out = []
        for q, a in queries:
            hits = [(-total(a, b, int.__and__) / u, i) for i, b in bits if (u := total(a, b, int.__or__)) and (with_self or i != q)]
            out += [(q, i, pytest.approx(-s, abs=6e-5)) for s, i in sorted(hits)[: len(hits)] if -s > t or (inclusive and -s == t)][:limit]
        return out

    told = lambda found: [x[:3] for x in sorted(map(tuple, found.collect()), key=lambda x: (x[0], -x[2], x[1]))]
    key = lambda x: (x[0], -round(getattr(x[2], "expected", x[2]), 4), x[1])
    for got, expected in (
        (similarity.knn(df, asked, 6), want(-1.0, False, 6, False)),
        (similarity.sim_search(df, asked, 0.3, 50), want(0.3, False, 50, True)),
        (similarity.sim_search(df, asked, 0.5, 4, inclusive=True), want(0.5, True, 4, True)),
        (similarity.sim_search_batch(df, asked, 0.4, 3), want(0.4, False, 3, False)),
        (similarity.sim_search_indexed(df, df, 0.5, 5), want(0.5, False, 5, False, sorted({(i, tuple(w)) for i, w in bits}))),
    ):
        assert told(got) == sorted(expected, key=key)
    plan = similarity.knn(df, asked, 6)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and plan.index("Window") < plan.index("MapInArrow") < plan.index("CartesianProduct")
    monkeypatch.setattr(similarity, "TILED", 0)  # the index gives the same
    assert told(similarity.sim_search_indexed(df.where("id <> 402"), df.where("id <> 402"), 0.5, 5)) == sorted(want(0.5, False, 5, False, sorted({(i, tuple(w)) for i, w in bits})), key=key)


def test_bits(spark):
    df = spark.createDataFrame([(1, [0, 5, 63, 64]), (2, [5, 63]), (3, []), (4, [1])], "id long, bits array<int>").withColumn("words", similarity.packed(F.col("bits"), 2))
    got = {r["id"]: r["words"] for r in df.collect()}
    assert got[2] == [(1 << 5) - (1 << 63), 0] and got[1][1] == 1 and got[3] == [0, 0]
    pair = df.alias("x").join(df.alias("y")).where("x.id = 1 and y.id = 2").select(similarity.tanimoto(F.col("x.bits"), F.col("y.bits")), similarity.tanimoto_words(F.col("x.words"), F.col("y.words"))).first()
    assert pair[0] == pair[1] == 0.5
    hits = {(r["query"], r["id"]) for r in similarity.search(df, df, 0.5).collect()}
    assert hits == {(1, 1), (2, 2), (4, 4)}  # strictly over the threshold; empty sets match nothing
    assert (1, 2) in {(r["query"], r["id"]) for r in similarity.search(df, df, 0.5, inclusive=True).collect()}
    assert {(r["query"], r["id"]) for r in similarity.containment_screen(df, df.where("id = 2")).collect()} == {(2, 1), (2, 2)}
    assert similarity.search(df, df.limit(0), 0.5).collect() == []


def test_fingerprints_of_text(spark):
    df = spark.createDataFrame([("CCO",), ("cco",), ("C",), (None,), ("CCOCCO",)], "s string").select(similarity.fp_build(F.col("s"), 3, 64).alias("b"))
    b = [r["b"] for r in df.collect()]
    assert b[0] == b[1] and len(b[0]) == 1 and b[2] == [] and not b[3] and b[0][0] in b[4]


def test_rules(spark):
    rules = [classify.Rule("x", "A", "B$"), classify.Rule("y", "A"), classify.Rule("z", "C", "D")]
    rows = [("A>>B", None), ("A>>D", None), ("C>>D", None), ("C>>E", None), ("Q>>B", None), ("AB", None), (None, None), ("A>>B", "old")]
    df = spark.createDataFrame(rows, "t string, c string")
    got = [r["c"] for r in classify.classify_rules(df, rules, "t", "c").collect()]
    # a left side alone decides in the rules' order: x comes before y
    assert got == ["x", "x", "z", "z", "unclassified", "unclassified", None, "old"]


def test_many_rules_by_their_literals(spark):
    """The first rule that matches, as trying them in turn finds it: literals inside others, whole words, rules of no literal."""
    import random

    rng = random.Random(5)
    words = ["gear", "gear box", "gea", "box", "boxes", "rod", "ro", "d1", "x_y", "é", "GEAR"]
    parts = [rf"\b{w}\b" if k else w for w in words if w != "é" for k in (0, 1)]
    rules = [classify.Rule(f"r{i}", rng.choice([*parts, "ro.*x", "^box", ""]), rng.choice([*parts, r"\d$", "", ""])) for i in range(150)]
    seps = [" ", "", ".", "é", "_", "  "]
    side = lambda: "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(4)))
    texts = [side() + rng.choice([">>", ">>", ">>", ">", ">>>>"]) + side() for _ in range(600)] + ["", ">>", None, "gear>>" + "rod " * 20_000 + "7"]

    def in_turn(rules):  # word boundaries beside letters such as é are what the engine's own expressions take them for
        left, right = (F.get(F.split("t", ">>", 2), k) for k in (0, 1))
        tried = [F.when(left.rlike(r.left) & right.rlike(r.right), r.name) for r in rules if r.right] + [F.when(left.rlike(r.left), r.name) for r in rules]
        return F.when(F.col("t").isNotNull(), F.when(F.size(F.split("t", ">>", 2)) == 2, F.coalesce(*tried, F.lit("unclassified"))).otherwise("unclassified"))

    df = spark.createDataFrame([(t, None) for t in texts], "t string, c string")
    few = [r for r in rules if r.left not in ("", "^box", "ro.*x")][:25]
    for chosen in (rules, few, [r for r in rules if r.left in ("^box", "ro.*x")], []):
        got = [r["c"] for r in classify.classify_rules(df, chosen, "t", "c").collect()]
        assert got == [r[0] for r in df.select(in_turn(chosen)).collect()] and (not chosen or len(set(got)) > 4)
    more = [classify.Rule(f"{a}{i}", rf"\b{a}{i}\b") for a in words[:4] for i in range(300)]
    plan = lambda rs: classify.classify_rules(df, rs, "t", "c")._jdf.queryExecution().analyzed().toString()
    assert plan(more).count("RLIKE") == plan(more[:5]).count("RLIKE") and plan(more).count("regexp_extract_all") == plan(more[:5]).count("regexp_extract_all")


def test_registered_precursors_reach_depth_three(spark):
    m = Model(spark, "/root/testdata/sf0.001")
    ys = {r["reaction_id"]: r["yield_pct"] for r in m.reactions.collect()}
    used, made = {}, {}
    for r in m.components.collect():
        side = used if r["role"] == "reactant" else made if r["role"] == "product" else {}
        side.setdefault(r["reaction_id"], set()).add(r["inchikey"])
    best = {}
    for i, sources in used.items():
        for a, b in itertools.product(sources, made.get(i, ())):
            if a != b:
                best.setdefault(a, {}).setdefault(b, []).append(ys[i])
    best = {a: {b: max((y for y in v if y is not None), default=None) for b, v in to.items()} for a, to in best.items()}
    want, path = {}, [((a, b), y) for a, to in best.items() for b, y in to.items()]
    for depth in (2, 3):
        path = [((*ms, b), None if y is None or z is None else y * z / 100) for ms, y in path for b, z in best.get(ms[-1], {}).items() if b not in ms]
        for ms, y in path:
            want.setdefault((ms[0], ms[-1], depth), []).append(y)
    got = {(r["src"], r["dst"], r["step_count"]): r["total_yield"] for r in QUERIES["precursor_edges_depth3"](spark, m.sf_dir).collect()}
    assert set(got) == set(want) and any(k[2] == 3 for k in got)
    for k, v in want.items():
        top = max((y for y in v if y is not None), default=None)
        assert got[k] == (top if top is None else pytest.approx(top, abs=0.0051))


def test_registered_routes_reach_four_steps(spark, tmp_path):
    # 101 -> 102 -> 103 -> 104 -> 120, and 105 -> 103: routes of three and four steps to the target 120 only
    steps = [(1, 101, 102), (2, 102, 103), (3, 103, 104), (4, 104, 120), (5, 105, 103)]
    sizes = {101: 1, 105: 1}
    parts = [(k, "n", "b", "t", 1.0, sizes.get(k, 40)) for k in (101, 102, 103, 104, 105, 120)]
    lines = [(r, k, 1.0, 0.0, 0.0, n, flag, "O") for r, a, b in steps for n, (k, flag) in enumerate(((a, "A"), (b, "N")))]
    tables = {
        "part": (parts, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double, p_size int"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_quantity double, l_tax double, l_discount double, l_linenumber int, l_returnflag string, l_linestatus string"),
        "orders": ([(r, 1, "1-URGENT", "O") for r, _, _ in steps], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string"),
        "customer": ([(1, "M")], "c_custkey long, c_mktsegment string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["steps"], r["reaction_ids"], r["molecules"]) for r in QUERIES["route_search_depth8"](spark, str(tmp_path)).collect()}
    assert got == {(3, "5,3,4", "105,103,104,120"), (4, "1,2,3,4", "101,102,103,104,120")}
    ids = {r["id"] for r in QUERIES["route_elements_depth8"](spark, str(tmp_path)).collect() if r["kind"] == "node"}
    assert ids == {f"m{k}" for k in (101, 102, 103, 104, 105, 120)} | {f"r{r}" for r in range(1, 6)}


def test_registered_screen_takes_the_query_set(spark, tmp_path):
    rng = random.Random(5)
    on = {i: {b for b in range(64) if rng.random() < (0.04 if i % 20 == 0 else 0.6)} for i in range(200)}
    on[40] = set()
    rows = [(i, [1.0 if b in s else -1.0 for b in range(64)]) for i, s in on.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query"], r["id"]) for r in QUERIES["substructure_screen_batch"](spark, str(tmp_path)).collect()}
    # a query without bits asks for all rows that have any
    want = {(q, i) for q in on if q % 20 == 0 for i in on if on[q] <= on[i] and on[i]}
    assert got == want and any(q != i for q, i in want)


def test_profile_has_similar_molecules(spark):
    bits = {1: range(20), 2: range(19), 3: range(20), 4: range(30, 40), **{i: range(i - 9, 20) for i in range(10, 16)}, **{i: range(20) for i in range(50, 60)}}
    fps = spark.createDataFrame([(i, list(b)) for i, b in bits.items()], "id long, bits array<int>").select("id", similarity.packed(F.col("bits"), 1).alias("words"))
    molecules = spark.createDataFrame([(i,) for i in (1, 2, 4, 99)], "inchikey long")
    none = lambda s: spark.createDataFrame([], "inchikey long, " + s)
    reactions = spark.createDataFrame([(7, "c", 50.0)], "reaction_id long, reaction_class string, yield_pct double")
    components = spark.createDataFrame([(1, 7, "product")], "inchikey long, reaction_id long, role string")
    rows = profiles.molecule_profile(molecules, components, reactions, none("activity_type string, assay long, value double"), none("signal_word string, ghs_codes array<string>"), similar=similarity.sim_search_batch(fps, fps))
    got = {r["inchikey"]: [(x["id"], x["similarity"]) for x in r["similar"]] for r in rows.collect()}
    for i in (1, 2, 4, 99):
        a = set(bits.get(i, ()))
        scored = [(-len(a & set(b)) / len(a | set(b)), j) for j, b in bits.items() if j != i]
        assert got[i] == [(j, round(-s, 4)) for s, j in sorted(scored) if -s > 0.7][:10]
    assert len(got[1]) == 10 and got[4] == got[99] == []


def test_search_in_blocks_gives_the_same(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.getrandbits(63) & rng.getrandbits(63), rng.getrandbits(20)]) for i in range(120)] + [(120, [0, 0]), (121, None), (None, [1, 1]), (5, [7, 7])]
    df = spark.createDataFrame(rows, "id long, words array<long>")
    asked = df.where("id % 3 = 0 or id is null")
    told = lambda: [sorted(map(tuple, similarity.search(df, asked, t, inclusive=i, contain=c).collect())) for t, i, c in ((0.3, False, False), (0.25, True, False), (-1.0, False, False), (0.0, False, True))]
    whole = told()
    for size, cell in ((7, 16), (1, 5)):
        monkeypatch.setattr(similarity, "BLOCK", size)
        monkeypatch.setattr(similarity, "ROW_BLOCK", 11)
        monkeypatch.setattr(similarity, "CELL", cell)
        assert told() == whole
    bits = [(i, sum(w.bit_count() for w in x), x) for i, x in rows if i is not None and x is not None]
    want = sorted((q, i) for q, nq, a in bits if q % 3 == 0 for i, n, b in bits if n and sum((u & v).bit_count() for u, v in zip(a, b)) / sum((u | v).bit_count() for u, v in zip(a, b)) > 0.3)
    assert [(q, i) for q, i, _ in whole[0]] == sorted(want)


def test_fingerprints_of_all_names_against_brute_force(spark):
    parts = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    for r in QUERIES["fp_build_text"](spark, "/root/testdata/sf0.001").collect():
        name = parts[r["id"]].lower()
        grams = {name[i : i + 3].encode() for i in range(len(name) - 2)}
        hashed = sorted({(xxhash.xxh64_intdigest(g, seed=42) - (1 << 64) * (xxhash.xxh64_intdigest(g, seed=42) >> 63)) % 2048 for g in grams})
        assert (r["n_bits"], r["bits"]) == (len(hashed), ",".join(map(str, hashed)))
