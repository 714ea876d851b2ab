"""Tanimoto similarity of sets: sparse ones (token arrays) by prefix-filtered joins, dense ones (bit sets) by a query set in
blocks against all rows, the best hits of each in tiles (nearest.py)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molquarry.operators.nearest import nearest
from molquarry.sources.scratch import discard, written

#: Queries that are sent to all tasks at once; rows of a block, and numbers of bits of a cell, where there are more.
BLOCK, ROW_BLOCK, CELL = 32_768, 1_000_000, 16
#: Pairs that tiles compare in the time that an index takes for a key or a candidate.
TILED = 100
#: Sets of a block of an item that more sets have in their prefixes.
LIST = 2_048
#: Bits of a place in the sketch of items' counts; candidate pairs that are sent to all tasks.
SKETCH, PAIRS = 20, 1_000_000


def fp_build(text: Column, k: int = 3, n_bits: int = 2048) -> Column:
    """Sorted on-bits of the hashed k-grams of a string."""
    t = F.lower(text)
    starts = F.when(F.length(t) >= k, F.sequence(F.lit(1), F.length(t) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(t, i, F.lit(k))), F.lit(n_bits)).cast("int"))))


def sign_bits(embedding: Column) -> Column:
    """On-bits of a vector: the places of its positive values."""
    return F.filter(F.sequence(F.lit(0), F.size(embedding) - 1), lambda i: F.get(embedding, i) > 0)


def packed(bits: Column, n_words: int) -> Column:
    """On-bits as an array of 64-bit words."""
    word = lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))))
    return F.array(*(word(w) for w in range(n_words)))


def tanimoto(a: Column, b: Column) -> Column:
    """Of two sets of bits; null for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both, F.size(a) + F.size(b) - both)


def tanimoto_words(a: Column, b: Column) -> Column:
    """The same of two packed arrays."""
    count = lambda x: F.aggregate(x, F.lit(0), lambda s, w: s + F.bit_count(w))
    both = count(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    return F.try_divide(both, count(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))))


def shingles(text: Column, k: int = 3) -> Column:
    """Sorted distinct 64-bit hashes of the k-word runs of a text, words being what stands between spaces; null for a null text,
    empty with fewer words."""
    words = F.array_remove(F.split(F.lower(text), " "), "")

    def runs(w: Column) -> Column:
        n = F.greatest(F.size(w) - (k - 1), F.lit(0))
        # the struct of a run's words is hashed as its words in turn
        return F.transform(F.arrays_zip(*(F.slice(w, F.lit(i + 1), n).alias(f"w{i}") for i in range(k))), lambda run: F.xxhash64(run))

    # a lambda over an array of one, so that the words are made once a text
    return F.sort_array(F.array_distinct(F.flatten(F.transform(F.when(words.isNotNull(), F.array(words)), runs))))


def _named(sets: DataFrame) -> DataFrame:
    """(id, n, k1, k2, tokens) of the non-empty sets (id, items): items as sorted 64-bit hashes, and two hashes of them all."""
    tokens = "items" if dict(sets.dtypes)["items"] == "array<bigint>" else F.sort_array(F.transform("items", lambda x: F.xxhash64(x)))
    rows = sets.where(F.size("items") > 0).select("id", F.size("items").alias("n"), F.col(tokens) if isinstance(tokens, str) else tokens.alias("tokens"))
    rows = rows.withColumnRenamed("items", "tokens")
    return rows.select("id", "n", F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit(7), "tokens").alias("k2"), "tokens")


def memberships(sets: DataFrame) -> DataFrame:
    """(id, representative, members) of every non-empty set: the smallest id that has an equal set, and how many have it.

    Sets are equal if 128 bits of hashes are. sets: id, items (sorted, distinct)."""
    named = written(_named(sets).select("id", "k1", "k2"), "sets")
    reps = named.groupBy("k1", "k2").agg(F.min("id").alias("representative"), F.count("*").alias("members"))
    return named.join(reps, ["k1", "k2"]).select("id", "representative", "members")


def _hashed(sets: DataFrame) -> DataFrame:
    """(id, items) with items as sorted 64-bit hashes; sets without an id go."""
    sets = sets.where("id is not null")
    return sets.select("id", "items" if dict(sets.dtypes)["items"] == "array<bigint>" else F.sort_array(F.transform("items", lambda x: F.xxhash64(x))).alias("items"))


def _sketch(sets: DataFrame) -> np.ndarray:
    """How many sets have an item of each of 2^SKETCH places (the hash's low bits)."""
    items = sets.select(F.explode_outer("items").alias("item"))  # explode() would make the sets twice, to filter empty ones first
    counts = items.groupBy(F.col("item").bitwiseAND(F.lit((1 << SKETCH) - 1)).cast("int").alias("place")).agg(F.least(F.count("item"), F.lit(2**31 - 1)).cast("int").alias("f"))
    counts = counts.where("place is not null").toArrow()
    out = np.zeros(1 << SKETCH, np.int32)
    out[counts.column("place").to_numpy()] = counts.column("f").to_numpy()
    return out


def _prefixes(sketch: Broadcast, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sets (id, items) that are not empty: 128 bits that name the set (k1, k2), id, size, and the rarest items that a partner shares one of, in order;
    items that no other set has come first and are only counted (skipped)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                lists = batch.column("items")
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                values = lists.flatten().to_numpy()
                ends = np.cumsum(size)
                row, f = np.repeat(np.arange(len(size)), size), sketch.value[values & (len(sketch.value) - 1)]
                order = np.lexsort((values, f, row))
                at = np.arange(len(values)) - np.repeat(ends - size, size)  # places in the order
                chosen = (at < np.repeat(size + (-num * size) // den + 1, size)) & (f[order] > 1)
                alone = np.bincount(row[f == 1], minlength=len(size))
                offsets = np.r_[0, np.cumsum(np.bincount(row[chosen], minlength=len(size)))]
                names = np.array([np.frombuffer(blake2b(values[e - n : e].tobytes(), digest_size=16).digest(), np.int64) for e, n in zip(ends, size)]).reshape(-1, 2)
                some = pa.record_batch([pa.array(names[:, 0]), pa.array(names[:, 1]), batch.column("id"), pa.array(size.astype(np.int32)), pa.array(alone.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[order][chosen]))], names=["k1", "k2", "id", "n", "skipped", "items"])
                yield some.filter(pa.array(size > 0))

    return run


def similar_edges(sets: DataFrame, num: int, den: int, max_neighbours: int | None = None) -> DataFrame:
    """(a, b, similarity) with a < b of the representatives (the smallest id of each different set) whose Tanimoto similarity is at
    least num/den, four digits. sets: id, items (sorted, distinct); null and empty sets have no edges.

    Exact: two such sets share one of the rarest n - ceil(t n) + 1 items of each, in an order by a sketch of the items' counts
    (any one order is exact; the sketch has 2^SKETCH places for any number of items) and then by item. So only these prefixes
    are written, and of them only the items that several sets have there go on; whole sets are made again from `sets` where
    they are looked at, and only those of candidates are shuffled. Sets under one item meet by
    cells of size, the smaller with the larger: the place of the item in the smaller set's order tells how large a partner
    may be with which it is the first shared one, and the smaller set only goes to the cells up to that size. So an item that
    all sets share, which comes late in every order, makes few pairs. An item that many sets have in their prefixes is
    split into blocks of about LIST sets by LIST sets. Items are compared as 64-bit hashes."""
    sets = _hashed(sets)
    sent = sets.sparkSession.sparkContext.broadcast(_sketch(sets))  # 2^SKETCH counts
    kind = sets.schema["id"].dataType.simpleString()
    every_set = written(sets.mapInArrow(_prefixes(sent, num, den), f"k1 bigint, k2 bigint, id {kind}, n int, skipped int, items array<bigint>"), "sets")
    of = every_set.groupBy("k1", "k2").agg(F.min(F.struct("id", "n", "skipped", "items")).alias("x")).select("x.*")
    reps = written(of, "representatives")
    discard(every_set)
    items = reps.select("id", "n", "skipped", F.posexplode("items").alias("i", "item"))
    common = items.groupBy("item").agg(F.count("*").alias("f")).where("f > 1").select("item")
    rows = items.join(common, "item").select("id", "n", "item", (F.col("skipped") + F.col("i") + 1).alias("pos"))
    listed = written(rows, "prefixes")
    discard(reps)
    parts = listed.groupBy("item").agg(F.count("*").alias("f")).where(f"f > {LIST}").select("item", F.expr(f"cast((f + {LIST - 1}) div {LIST} as int)").alias("parts"))
    rows = listed.join(parts, "item", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))
    # sizes up to 64 are cells of their own, above there are 32 an octave
    cell = lambda size: F.expr(f"cast(if({size} < 64, {size}, 64 + floor(32 * log2({size} / 64D))) as int)")
    reach = F.expr(f"least((n + 1 - pos) * {num + den} div {num} - n, n * {den} div {num})")
    smaller = rows.withColumn("reach", reach).where("reach >= n").withColumn("cell", F.explode(F.sequence(cell("n"), cell("reach")))).withColumn("other", every)
    smaller = smaller.select("item", "cell", F.col("own").alias("block_s"), F.col("other").alias("block_l"), F.col("id").alias("s"), F.col("n").alias("ns"), F.col("pos").alias("ps"))
    larger = rows.withColumn("cell", cell("n")).withColumn("other", every)
    larger = larger.select("item", "cell", F.col("other").alias("block_s"), F.col("own").alias("block_l"), F.col("id").alias("l"), F.col("n").alias("nl"), F.col("pos").alias("pl"))
    fits = (F.col("ns") < F.col("nl")) | ((F.col("ns") == F.col("nl")) & (F.col("s") < F.col("l")))
    fits &= F.col("nl") * num <= F.col("ns") * den
    fits &= (1 + F.least(F.col("ns") - F.col("ps"), F.col("nl") - F.col("pl"))) * (num + den) >= (F.col("ns") + F.col("nl")) * num
    pairs = smaller.join(larger, ["item", "cell", "block_s", "block_l"]).where(fits).select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    discard(listed)
    few = pairs.count() <= PAIRS
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    tokens = sets.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", F.col("items").alias("tokens"))
    tokens = written(tokens.withColumn("n", F.size("tokens")), "candidates")
    x, y = (tokens.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("tokens").alias(f"{c}_tokens")) for c in ("a", "b"))
    found = (F.broadcast(pairs) if few else pairs).join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("a_tokens", "b_tokens")).alias("s"), (F.col("a_n") + F.col("b_n")).alias("both"))
    found = found.withColumn("u", F.col("both") - F.col("s")).where(F.col("s") * den >= F.col("u") * num)
    found = written(found.select("a", "b", F.round(F.col("s") / F.col("u"), 4).alias("similarity")), "edges")
    discard(pairs, tokens)
    if max_neighbours is not None:
        order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_neighbours).drop("rank")
    return found


def search(fps: DataFrame, queries: DataFrame, threshold: float = 0.0, inclusive: bool = False, contain: bool = False) -> DataFrame:
    """(query, id, similarity) over all rows for every query; both tables are (id long, words array<long>), all arrays equally long.

    Rows without bits, with null words or a null id match nothing; repeated queries count once, repeated rows each. Up to
    BLOCK queries go to all tasks, so that the rows stay where they are. More are dealt into blocks by their number of bits, and the
    rows into blocks of ROW_BLOCK; a row goes to the blocks whose numbers of bits can match it, and each pair of blocks meets
    in one equi-join."""
    asked = queries.select(F.col("id").alias("query"), F.col("words").alias("asked")).where("query is not null and asked is not null").distinct()
    known = fps.select("id", "words").where("id is not null and words is not null")
    some = asked.select(F.size("asked")).first()
    if some is None:
        return asked.select("query", F.col("query").alias("id"), F.lit(0.0).alias("similarity")).limit(0)
    bits = lambda of: reduce(Column.__add__, (F.bit_count(of(i)) for i in range(max(1, some[0]))))
    asked = asked.withColumn("nq", bits(lambda i: F.get("asked", F.lit(i))))
    known = known.withColumn("nx", bits(lambda i: F.get("words", F.lit(i))))
    both = bits(lambda i: F.get("words", F.lit(i)).bitwiseAND(F.get("asked", F.lit(i))))
    score = F.try_divide(both, F.col("nx") + F.col("nq") - both)
    if contain:
        match = (F.col("nx") >= F.col("nq")) & (F.col("nx") > 0) & (both == F.col("nq"))
    else:
        match = (score >= threshold if inclusive else score > threshold) & (F.col("nx") + F.col("nq") > 0)
    n = asked.count()
    if n <= BLOCK:
        met = known.join(F.broadcast(asked), match)
    else:
        salts, rows = -(-n // BLOCK), known.count() // ROW_BLOCK + 1
        low = F.lit(0) if contain else F.floor(F.col("nx") * max(0.0, threshold))
        high = F.col("nx") if contain else F.least(F.floor(F.col("nx") / threshold) + 1, F.lit(64 * some[0])) if threshold > 0 else F.lit(64 * some[0])
        deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k))
        span = lambda k: F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")
        x = known.withColumn("row_block", deal("id", rows)).withColumn("cell", F.explode(F.sequence((low / CELL).cast("int"), (high / CELL).cast("int")))).withColumn("salt", F.explode(span(salts)))
        q = asked.withColumn("cell", (F.col("nq") / CELL).cast("int")).withColumn("salt", deal("query", salts)).withColumn("row_block", F.explode(span(rows)))
        met = x.join(q, ["cell", "salt", "row_block"]).where(match)
    return met.select("query", "id", score.alias("similarity"))


def top_hits(hits: DataFrame, limit: int, with_self: bool = True) -> DataFrame:
    """The best `limit` hits of each query by similarity, then id; similarity gets four digits."""
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    hits = hits if with_self else hits.where("query <> id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "id", F.round("similarity", 4).alias("similarity"))


def _best_hits(fps: DataFrame, queries: DataFrame, threshold: float, limit: int, inclusive: bool = False, with_self: bool = True) -> DataFrame:
    """top_hits() of search(), without making the hits that are not among the best, see nearest.nearest()."""
    asked = queries.select(F.col("id").alias("query"), F.col("words").alias("asked")).where("query is not null and asked is not null").distinct()
    known = fps.select("id", "words").where("id is not null and words is not null")
    some = asked.select(F.size("asked")).first()
    if some is None or some[0] == 0 or any(dict(x.dtypes)[c] != "bigint" for x, c in ((asked, "query"), (known, "id"))):
        return top_hits(search(fps, queries, threshold, inclusive), limit, with_self)
    return top_hits(nearest(known, asked, some[0], limit, threshold, inclusive, with_self), limit, with_self)


def sim_search(fps: DataFrame, queries: DataFrame, threshold: float = 0.7, limit: int = 50, inclusive: bool = False) -> DataFrame:
    return _best_hits(fps, queries, threshold, limit, inclusive)


def sim_search_batch(fps: DataFrame, queries: DataFrame, threshold: float = 0.7, limit: int = 10) -> DataFrame:
    """The same without the query itself. More than BLOCK queries may be looked up in an index of bit blocks, see sim_search_indexed()."""
    if threshold >= 0.5 and queries.limit(BLOCK + 1).count() > BLOCK:
        return sim_search_indexed(fps, queries, threshold, limit)
    return _best_hits(fps, queries, threshold, limit, with_self=False)


def _ball(width: int, radius: int) -> int:
    """Numbers of `width` bits with at most `radius` bits set."""
    return sum(math.comb(width, i) for i in range(radius + 1))


def _radii(apart: int, blocks: int) -> list[int]:
    """Bits that may differ in each block (-1: the block is not needed), such that two sets with `apart` different bits at most are within them
    in one block at least."""
    return [(apart + 1) // blocks - 1 + (i < (apart + 1) % blocks) for i in range(blocks)]


def _blocks(sizes: dict[int, int], n_words: int, threshold: float) -> int:
    """Blocks a word that need the fewest looked-up keys and expected candidates, for sets by their number of bits."""
    return min((2, 4, 8, 16), key=lambda each: _looked_at(each, sizes, n_words, threshold))


def _looked_at(each: int, sizes: dict[int, int], n_words: int, threshold: float) -> float:
    """Looked-up keys and expected candidates with so many blocks a word."""
    width, total = 64 // each, sum(sizes.values())
    keys = lambda n: sum(_ball(width, r) for r in _radii(_apart(n, threshold), each * n_words))
    return sum(k * keys(n) * (1 + total / 2**width) for n, k in sizes.items())


def _apart(n: int, threshold: float) -> int:
    """The most bits by which a set of n bits differs from one of n bits or fewer at that similarity."""
    return int(2 * n * (1 - threshold) / (1 + threshold) + 1e-9)


def sim_search_indexed(fps: DataFrame, queries: DataFrame, threshold: float = 0.7, limit: int = 10, inclusive: bool = False) -> DataFrame:
    """(query, id, similarity) as sim_search_batch(), exact for any number of queries, without comparing all pairs.

    Rows with equal bits are one set with its smallest ids. The bits are cut into blocks; two sets of the wanted similarity
    differ in so few bits that in one block they differ in a radius' bits at most (pigeonhole). The larger set of a pair
    looks up all values within the radius of its own in each block, the smaller one is listed under its value; a pair is
    made by the first block that fits and is compared on all bits. Width and radius are chosen by the sets' number and
    sizes, so that lists stay short: candidates grow with the number of sets times the looked-up values, not with its
    square. Where the index would look at more than 1/TILED of all pairs, as with a low threshold, pairs are compared in
    tiles instead, see nearest.nearest(). Made for dense bits; of sparse ones most blocks are empty, and similar_edges() is the join for them. Rows
    without bits, with null words or a null id match nothing; repeated queries count once, repeated rows each."""
    known = fps.select("id", "words").where("id is not null and words is not null")
    asked = queries.select("id", "words").where("id is not null and words is not null").distinct()
    some = asked.select(F.size("words")).first()
    if some is None:
        return asked.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("similarity")).limit(0)
    n_words, keep = some[0], limit + 1
    bits = reduce(Column.__add__, (F.bit_count(F.get("words", F.lit(i))) for i in range(n_words)))
    smallest = known.groupBy("words", "id").agg(F.least(F.count("*"), F.lit(limit)).cast("int").alias("times"))
    smallest = smallest.withColumn("r", F.row_number().over(Window.partitionBy("words").orderBy("id"))).where(F.col("r") <= keep)
    ids = smallest.groupBy("words").agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat("id", F.col("times"))))).alias("ids"))
    sets = ids.join(asked.select(F.col("words").alias("w")).distinct(), F.col("words") == F.col("w"), "full_outer")
    sets = sets.select(F.coalesce("words", "w").alias("words"), "ids", F.col("w").isNotNull().alias("asked")).withColumn("n", bits).where("n > 0")
    sets = written(sets, "bit-sets")
    sizes = {r["n"]: r["count"] for r in sets.groupBy("n").count().collect()}  # one a number of bits
    each = _blocks(sizes, n_words, threshold)
    if dict(known.dtypes)["id"] == dict(asked.dtypes)["id"] == "bigint" and TILED * _looked_at(each, sizes, n_words, threshold) > float(sum(sizes.values())) ** 2:
        discard(sets)
        return top_hits(nearest(known, asked.select(F.col("id").alias("query"), F.col("words").alias("asked")), n_words, limit, threshold, inclusive, False), limit, with_self=False)
    width, blocks = 64 // each, each * n_words
    value = lambda words, i: F.call_function("shiftrightunsigned", F.get(words, F.lit(i // each)), F.lit(width * (i % each))).bitwiseAND(F.lit((1 << width) - 1))
    radii = F.array(*(F.array(*(F.lit(r) for r in _radii(_apart(n, threshold), blocks))) for n in range(max(sizes, default=0) + 1)))
    most = max((r for n in sizes for r in _radii(_apart(n, threshold), blocks)), default=0)
    flips = [sorted(x for x in _within(width, r)) for r in range(most + 1)]
    masks = sets.sparkSession.createDataFrame([(r, x) for r, xs in enumerate(flips) for x in xs], "radius int, flip long")  # 2^width a radius at most
    own = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), value("words", i).alias("value")) for i in range(blocks))))
    listed = sets.select(F.col("words").alias("ws"), F.col("ids").alias("ids_s"), F.col("asked").alias("asked_s"), F.col("n").alias("ns"), own.alias("at")).select("ws", "ids_s", "asked_s", "ns", "at.*")
    looked = sets.select(F.col("words").alias("wl"), F.col("ids").alias("ids_l"), F.col("asked").alias("asked_l"), F.col("n").alias("nl"), F.get(radii, F.col("n")).alias("radii"), own.alias("at"))
    looked = looked.select("wl", "ids_l", "asked_l", "nl", "radii", "at.block", F.col("at.value").alias("centre"), F.get("radii", F.col("at.block")).alias("radius"))
    looked = looked.join(F.broadcast(masks), "radius").withColumn("value", F.col("centre").bitwiseXOR(F.col("flip"))).drop("flip", "centre", "radius")
    ordered = (F.col("nl") > F.col("ns")) | ((F.col("nl") == F.col("ns")) & (F.col("wl") > F.col("ws")))
    useful = (F.col("asked_l") & F.col("ids_s").isNotNull()) | (F.col("asked_s") & F.col("ids_l").isNotNull())
    differ = lambda i: F.bit_count(value("wl", i).bitwiseXOR(value("ws", i)))
    earlier = reduce(Column.__or__, ((F.lit(i) < F.col("block")) & (differ(i) <= F.get("radii", F.lit(i))) for i in range(blocks)))
    shared = reduce(Column.__add__, (F.bit_count(F.get("wl", F.lit(i)).bitwiseAND(F.get("ws", F.lit(i)))) for i in range(n_words)))
    score = shared / (F.col("nl") + F.col("ns") - shared)
    good = score >= threshold if inclusive else score > threshold
    # a set that nobody asks for meets asked ones alone
    meets = lambda a, b: a.join(b, ["block", "value"]).where(ordered & useful & (F.col("ns") >= F.floor(F.col("nl") * threshold)) & good & ~earlier)
    pairs = meets(looked.where("asked_l"), listed).unionByName(meets(looked.where("not asked_l"), listed.where("asked_s")))
    pairs = written(pairs.select("wl", "ids_l", "asked_l", "ws", "ids_s", "asked_s", score.alias("similarity")), "pairs")
    side = lambda q, x: pairs.where(f"asked_{q} and ids_{x} is not null").select(F.col(f"w{q}").alias("words"), "similarity", F.col(f"ids_{x}").alias("ids"))
    equal = sets.where("asked and ids is not null").select("words", F.lit(1.0).alias("similarity"), "ids")
    if threshold >= 1.0 and not inclusive:
        equal = equal.limit(0)
    near = side("l", "s").unionByName(side("s", "l")).unionByName(equal)
    first = Window.partitionBy("words").orderBy(F.desc("similarity"), F.get("ids", F.lit(0)))
    near = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep).select("words", "similarity", F.explode("ids").alias("id"))
    hits = asked.select(F.col("id").alias("query"), "words").join(near, "words").where("query <> id")
    found = top_hits(hits.select("query", "id", "similarity"), limit)
    found = written(found, "hits")
    discard(sets, pairs)
    return found


def _within(width: int, radius: int) -> list[int]:
    """All numbers of `width` bits with at most `radius` bits set."""
    return [sum(1 << i for i in places) for r in range(radius + 1) for places in combinations(range(width), r)]


def knn(fps: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """The k nearest other rows of every query."""
    return _best_hits(fps, queries, -1.0, k, with_self=False)


def containment_screen(fps: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id) of the rows that have all bits of a query."""
    return search(fps, queries, contain=True).select("query", "id")
