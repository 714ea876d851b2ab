"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

Sets. A text's set is its distinct k-word shingles as 64-bit hashes (shingles.py); documents with equal sets are one
node of the join, named by a 128-bit hash of the set, so exact copies never meet as pairs. Half of that name is enough to
find candidates: where two sets share it, both are verified.

Order. Shingles are ordered from rare to frequent by a sketch of document frequencies: counts in 2^bits hash buckets
over all documents, of a fixed size whatever the input's. Any order is right; rare-first makes prefixes selective.

Prefixes. Two sets of sizes n, m that link share at least a = ceil(t / (1 + t) * (n + m)) shingles, so for any l <= a
the first (size - a + l) shingles of both share at least l. A document's prefix is long enough for its smallest possible
partner; a match counts only where it lies in the prefixes that the pair's own sizes give. Each document picks its
own l: one more prefix shingle costs its bucket's count to scan, and l matches divide the candidates it may have. A
pair has to share as many prefix shingles as the smaller of both l before it is verified.

Lists. The documents under one prefix shingle make pairs while they are few. A longer list (a large group of near
copies) first is compared with a few pivots only; what links to a pivot is one component and needs no pairs inside.
Then the pairs of the list across different components are made: exact, without the pairs within a group. They are made by size:
the place of the list's shingle in a document's order says how large a partner may be with which this is the first
match, so a document only meets those of the sizes that it reaches; many documents around one common passage which
differ too much to link are out of each other's reach.

Candidates are verified on their whole sets. Pairs that share a rare shingle by chance grow faster than the input, so the sets of a
pair are gathered only if their parities leave a link open: every document keeps, for as many places as it has shingles
or up to twice as many, whether an odd number of them falls there. Where two sets differ in a place's parity they differ in a shingle of it,
so more such places than a linking pair may have shingles on one side only rule the pair out; nothing that links is dropped.
No pair of equal component is needed twice, no list is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import among, discard, passes, places_filter, row_key, settled, sparing, unused, written
from molquarry.llm.components import components
from molquarry.llm.shingles import shingle_sets


@dataclass(frozen=True)
class JaccardJoin:
    """k-word shingles; link if den * |x & y| >= num * |x | y|."""

    k: int = 4
    num: int = 85
    den: int = 100
    sketch_bits: int = 20
    most_matches: int = 4
    verify_cost: float = 20.0
    short_list: int = 24
    pivots: int = 3
    sent_pairs: int = 1_000_000

    def probe_prefix(self, n):
        """Length of the prefix (for one match) of a set of n, whose partners may be as small as the threshold allows."""
        return n - -(-self.num * n // self.den) + 1

    def least_shared(self, sizes):
        """The fewest shingles that two sets of `sizes` together share if they link."""
        return -(-self.num * sizes // (self.num + self.den))


def _counts(raw: bytes, places: int) -> np.ndarray:
    """Counts of `places` places that _packed() stored."""
    raw = zlib.decompress(raw)
    return np.frombuffer(raw, f"<u{len(raw) // places}")


def _packed(counts: np.ndarray) -> bytes:
    """The counts in as few bytes each as the largest needs, compressed, as a small task has mostly zeros."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << 8 * w)
    return zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def frequency_sketch(texts: DataFrame, join: JaccardJoin, fan: int = 64) -> np.ndarray:
    """Document counts of all shingles in 2^sketch_bits buckets (the hash's top bits). `texts` has one string column.

    Every task counts its texts, in a byte a bucket or less; the arrays are cut into segments and summed by a tree of
    sums of `fan`, so that no task holds more than `fan` segments."""
    size, pieces = 1 << join.sketch_bits, 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for _, sets in shingle_sets(batches, 0, join.k):
            total += np.bincount((np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - join.sketch_bits)).astype(np.int64), minlength=size).astype(np.uint32)
        at = TaskContext.get().partitionId()
        if total.any():
            yield pa.RecordBatch.from_pydict({"at": pa.array([at] * pieces, pa.int32()), "segment": pa.array(range(pieces), pa.int32()), "counts": [_packed(x) for x in total.reshape(pieces, -1)]})

    def add(pdf):
        total = np.sum([_counts(c, size // pieces).astype(np.uint64) for c in pdf["counts"]], axis=0, dtype=np.uint64)
        pdf = pdf.head(1).copy()
        pdf["counts"] = [_packed(total)]
        pdf["at"] = pdf["at"] // fan
        return pdf

    parts, tasks = texts.mapInArrow(sparing(count), "at int, segment int, counts binary"), texts.rdd.getNumPartitions()
    while True:
        parts = parts.groupBy((F.col("at") / fan).cast("int").alias("g"), "segment").applyInPandas(add, "at int, segment int, counts binary")
        tasks = -(-tasks // fan)
        if tasks <= 1:
            break
    rows = sorted(parts.collect(), key=lambda r: r["segment"])  # the summed segments, 2^sketch_bits counts
    return np.minimum(np.concatenate([_counts(r["counts"], size // pieces).astype(np.uint64) for r in rows]), 0xFFFFFFFF).astype(np.uint32) if rows else np.zeros(size, np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _node(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _parity(shingles: np.ndarray) -> np.ndarray:
    """For 2^i places (the hash's low bits; at least 64 and the number of shingles) whether an odd number of shingles falls there, as 64-bit words."""
    places = max(64, 1 << (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view("<i8")


def _half(node: bytes) -> int:
    """The half of a node's name that candidates are found by."""
    return int.from_bytes(node[:8], "big", signed=True)


def prefixes(docs: DataFrame, sketch: np.ndarray, join: JaccardJoin) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n, node, half (see _half), matches (the chosen l), cold (prefix shingles that look unshared),
    tokens, its prefix in order, and parity (see _parity); tokens and parity are null where the same batch has had the same set before. Columns
    after text are kept."""
    more = docs.columns[2:]
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # 2^sketch_bits counts
    shift = np.uint64(64 - join.sketch_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value.astype(np.float32)
        usual = float(counts.mean() + 3 * np.sqrt(counts.mean())) if len(counts) else 0.0
        seen: set[bytes] = set()
        for part, sets in shingle_sets(batches, 1, join.k):
            out = {"n": [], "node": [], "half": [], "matches": [], "cold": [], "tokens": [], "parity": []}
            for s in sets:
                n, node, tokens, parity, matches, cold = len(s), _node(s), None, None, 1, 0
                if n and node not in seen:
                    f = counts[(s >> shift).astype(np.int64)]
                    base = join.probe_prefix(n)
                    most = min(join.most_matches, -(-join.num * n // join.den))
                    order = np.argsort(f, kind="stable")[: base + most - 1]
                    costs = np.cumsum(np.maximum(f[order] - usual, 0))
                    ls = np.arange(1, most + 1)
                    scanned = costs[np.minimum(base + ls - 2, len(costs) - 1)]
                    matches = int(np.argmin(scanned * (1 + join.verify_cost / ls))) + 1
                    tokens, parity = _signed(s[order[: base + matches - 1]]), _parity(s)
                    cold = int((f[order[:base]] <= usual).sum())
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(node)
                for name, v in zip(out, (n, node, node and _half(node), matches, cold, tokens, parity), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *part.columns[2:], *(pa.array(out[c], t) for c, t in (("n", pa.int64()), ("node", pa.binary()), ("half", pa.int64()), ("matches", pa.int32()), ("cold", pa.int32()), ("tokens", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))))],
                names=["doc_id", *more, *out],
            )

    kept = "".join(f"{c} {t}, " for c, t in docs.dtypes[2:])
    return docs.mapInArrow(sparing(run), f"doc_id long, {kept}n long, node binary, half long, matches int, cold int, tokens array<long>, parity array<long>")


PAIR = "kind int, token long, a long, b long, matches int, n long, pos int"
#: Kinds of rows: a prefix match of two documents; a pair with a pivot; a member of a long list (a) with its n, pos, matches.
MATCH, STAR, MEMBER = 0, 1, 2


def _lists(rows: DataFrame, join: JaccardJoin) -> DataFrame:
    """Rows (token, cold, node, n, pos, matches), sorted by token, cold, node in every partition, to PAIR rows. One pass; a
    list longer than short_list is streamed with its pivots alone kept."""

    def matched(x: dict, i: np.ndarray, j: np.ndarray, kind: int) -> pa.RecordBatch:
        n, m, l = x["n"][i], x["n"][j], np.minimum(x["matches"][i], x["matches"][j])
        least = join.least_shared(n + m)
        good = (join.den * np.minimum(n, m) >= join.num * np.maximum(n, m)) & (x["node"][i] != x["node"][j])
        good &= (x["pos"][i] <= n - least + l) & (x["pos"][j] <= m - least + l)
        i, j, l = i[good], j[good], l[good]
        return made(kind, x["token"][i], x["node"][i], x["node"][j], l, x["n"][i], x["pos"][i])

    def made(kind: int, token, a, b, l, n, pos) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(a), kind, np.int32)), "token": pa.array(token), "a": pa.array(a), "b": pa.array(b), "matches": pa.array(l.astype(np.int32)), "n": pa.array(n), "pos": pa.array(pos.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "cold", "node", "n", "pos", "matches"]
        held = {c: np.zeros(0, np.int64) for c in names}  # the rows of the last token so far, at most `limit`
        long_list = None  # the pivots of a list that is being streamed
        limit = 4096

        def whole(x: dict, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, long_list
            fresh = np.ones(len(x["token"]), bool)
            fresh[1:] = (x["token"][1:] != x["token"][:-1]) | (x["node"][1:] != x["node"][:-1])  # copies of a set from other batches
            x = {c: v[fresh] for c, v in x.items()}
            if long_list is not None and len(x["token"]):
                own = x["token"] == long_list["token"][0]
                yield from streamed({c: v[own] for c, v in x.items()}, long_list)
                if not own.all():
                    long_list = None
                x = {c: v[~own] for c, v in x.items()}
            token = x["token"]
            if not len(token):
                held = x
                return
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            lengths = np.diff(np.r_[starts, len(token)])
            if not last and lengths[-1] <= limit:
                at = starts[-1]
                held = {c: v[at:] for c, v in x.items()}
                x = {c: v[:at] for c, v in x.items()}
                starts, lengths = starts[:-1], lengths[:-1]
            else:
                held = {c: v[:0] for c, v in x.items()}
            length = np.repeat(lengths, lengths)
            short = np.flatnonzero((length > 1) & (length <= join.short_list))
            place = (np.arange(len(length)) - np.repeat(starts, lengths))[short]
            for d in range(1, join.short_list):
                i = short[place + d < length[short]]
                if not len(i):
                    break
                yield matched(x, i, i + d, MATCH)
            for at, n in zip(starts[lengths > join.short_list], lengths[lengths > join.short_list], strict=True):
                own = {c: v[at : at + n] for c, v in x.items()}
                pivots = {c: v[: join.pivots] for c, v in own.items()}
                yield from streamed(own, pivots)
                if not last and at + n == len(x["token"]) and not len(held["token"]):
                    long_list = pivots

        def streamed(x: dict, pivots: dict) -> Iterator[pa.RecordBatch]:
            if not len(x["token"]):
                return
            yield made(MEMBER, x["token"], x["node"], x["node"], x["matches"], x["n"], x["pos"])
            k = len(pivots["token"])
            y = {c: np.concatenate([pivots[c], x[c]]) for c in names}
            for p in range(k):
                yield matched(y, np.full(len(x["token"]), p), np.arange(k, k + len(x["token"])), STAR)

        for batch in batches:
            new = dict(zip(names, (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns), strict=True))
            yield from whole({c: np.concatenate([held[c], new[c]]) for c in names}, False)
        yield from whole(held, True)

    return rows.mapInArrow(sparing(run), PAIR)


def candidate_sets(docs: DataFrame, ids: DataFrame, join: JaccardJoin) -> DataFrame:
    """(id, node, shingles array<long>) of the nodes whose half names are in `ids` (id): texts are read once more, a bitmap of the ids
    lets through what may be one, and the join makes it exact."""
    ids = written(ids.distinct(), "candidates")
    rows = docs.select(F.col("doc_id"), "text")
    bits, bitmap = places_filter(ids, F.col("id").cast("string").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        mask = (1 << bits) - 1
        for _, sets in shingle_sets(batches, 1, join.k):
            own = [(node, s) for s in sets if (node := _node(s)) is not None and node not in seen]
            likely = passes(np.array([zlib.crc32(b"%d" % _half(node)) & mask for node, _ in own], np.int64), shared.value)
            found = {node: s for (node, s), good in zip(own, likely, strict=True) if good}
            seen.update(found)
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([_half(n) for n in found], pa.int64()), pa.array(found.keys(), pa.binary()), pa.array([_signed(s) for s in found.values()], pa.list_(pa.int64()))], names=["id", "node", "shingles"])

    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2^bits places, bounded
    found = rows.mapInArrow(sparing(run), "id long, node binary, shingles array<long>").join(ids, "id", "left_semi")
    sets = written(found.groupBy("id", "node").agg(F.first("shingles").alias("shingles")), "sets")
    discard(ids)
    return sets


def _beside(pairs: DataFrame, table: DataFrame, join: JaccardJoin) -> DataFrame:
    """The pairs (a, b) with the columns of table(id, ...) of both ends, named by the end. Pairs are 16 bytes each: up to `sent_pairs` of them
    go to all tasks, the rows of one side stay where they are and only the rows that pairs need on the other are shuffled;
    more are shuffled."""
    x, y = (table.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in table.columns if c != "id")) for end in "ab")
    if pairs.count() <= join.sent_pairs:
        y, pairs = y.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi"), F.broadcast(pairs)
    return x.join(pairs, "a").join(y, "b")


def alike(pairs: DataFrame, parities: DataFrame, join: JaccardJoin) -> DataFrame:
    """The pairs (a, b) that may link, by parities(id, node, n, parity). Words of the longer parity are added up (modulo 2) to as many as the
    shorter one has, which is the parity of its places there. Where several sets share an id, a pair stays if any of them may link."""
    both = _beside(pairs, parities.select("id", "n", "parity"), join)
    words = "least(size(parity_a), size(parity_b))"
    word = lambda p: f"aggregate(sequence(j, size({p}) - 1, {words}), 0L, (s, i) -> s ^ {p}[i])"
    apart = f"aggregate(sequence(0, {words} - 1), 0, (t, j) -> t + bit_count({word('parity_a')} ^ {word('parity_b')}))"
    least = f"({join.num} * (n_a + n_b) + {join.num + join.den - 1}) div {join.num + join.den}"
    return both.where(f"{apart} <= n_a + n_b - 2 * ({least})").select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, join: JaccardJoin) -> DataFrame:
    """(a, b, node_a, node_b, shared, size_a, size_b) of the pairs (a, b) that link."""
    both = _beside(pairs, sets, join)
    sizes = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long").alias("shared"), F.size("shingles_a").cast("long").alias("size_a"), F.size("shingles_b").cast("long").alias("size_b")
    return both.select("a", "b", "node_a", "node_b", *sizes).where(f"{join.den} * shared >= {join.num} * (size_a + size_b - shared)")


def linked_nodes(docs: DataFrame, join: JaccardJoin = JaccardJoin()) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of docs(doc_id, text, ...): nodes has doc_id, the columns after text, n and node (null for an empty set) of every row;
    links has verified pairs (node_a, node_b, shared, size_a, size_b) that connect each component of the threshold graph."""
    more = docs.columns[2:]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    sketch = frequency_sketch(docs.select("text"), join)
    table = written(prefixes(docs, sketch, join), "prefixes")
    tokens = table.where("tokens is not null").select("cold", F.col("half").alias("node"), F.col("n").cast("int").alias("n"), "matches", F.posexplode("tokens").alias("pos", "token"))
    tokens = tokens.select("token", "cold", "node", "n", (F.col("pos") + 1).alias("pos"), "matches")
    rows = written(_lists(tokens.repartition("token").sortWithinPartitions("token", "cold", "node"), join), "lists")
    nodes = written(table.select("doc_id", *more, "n", "node"), "nodes")
    parities = written(table.where("tokens is not null").select(F.col("half").alias("id"), "node", "n", "parity").dropDuplicates(["id", "node"]), "parities")
    discard(table)  # the prefixes are in the lists now
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    matches = rows.where(f"kind = {MATCH}").select(*pair, "matches")
    enough = matches.groupBy("a", "b").agg(F.count("*").alias("found"), F.min("matches").alias("matches")).where("found >= matches").select("a", "b")
    members = rows.where(f"kind = {MEMBER}")
    first = written(enough.union(rows.where(f"kind = {STAR}").select(*pair)).distinct(), "pairs")
    likely = written(alike(first, parities, join), "pairs")
    ends = likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id")))
    sets = candidate_sets(docs, ends.union(members.select(F.col("a").alias("id"))), join)
    links = written(verified(likely, sets, join), "links-verified")
    more = across_components(members, matches, first, links, join)
    if more is not None:
        more = written(alike(more, parities, join), "pairs")
        links = written(links.union(verified(more, sets, join)), "links-verified")
    for done in (rows, parities, first, likely, sets):
        discard(done)
    return nodes, links


def across_components(members: DataFrame, matches: DataFrame, done: DataFrame, links: DataFrame, join: JaccardJoin) -> DataFrame | None:
    """Pairs with a match in a long list whose ends are in different components after the pivots were compared; None if no
    list has two components.

    A pair that links has a match in the prefixes for one match, and as many as its l in those for l. Pairs come from
    the first condition (in a long list, or among the short lists' pairs); their matches are then counted."""
    known = components(links.select("a", "b"))
    member = members.select("token", F.col("a").alias("id"), "n", "pos", "matches").join(known, "id", "left")
    member = member.withColumn("component", F.coalesce("component", "id"))
    main = member.groupBy("token", "component").count().groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("parts"))
    member = written(member.join(main.where("parts > 1").drop("parts"), "token"), "unlinked")
    if member.isEmpty():
        return None
    x = member.select("token", *(F.col(c).alias(f"{c}_x") for c in ("id", "n", "pos", "matches", "component")), F.expr("component <> main").alias("apart_x"))
    y = member.select("token", *(F.col(c).alias(f"{c}_y") for c in ("id", "n", "pos", "matches", "component")), F.expr("component <> main").alias("apart_y"))
    least = F.expr(f"({join.num} * (n_x + n_y) + {join.num + join.den - 1}) div {join.num + join.den}")
    near = F.lit(join.den) * F.least("n_x", "n_y") >= F.lit(join.num) * F.greatest("n_x", "n_y")
    inside = lambda l: (F.col("pos_x") <= F.col("n_x") - least + l) & (F.col("pos_y") <= F.col("n_y") - least + l)
    apart = F.col("component_x") != F.col("component_y")
    # the smaller one (y) meets the larger ones (x) in the cells of the sizes that it reaches
    cell = lambda size: f"cast(if({size} < 64, {size}, 64 + floor(64 * log2({size} / 64))) as int)"
    reach = f"least((n_y + 1 - pos_y) * {join.num + join.den} div {join.num} - n_y, n_y * {join.den} div {join.num})"
    larger = x.withColumn("cell", F.expr(cell("n_x")))
    smaller = y.withColumn("reach", F.expr(reach)).where("reach >= n_y").withColumn("cell", F.explode(F.expr(f"sequence({cell('n_y')}, {cell('reach')})"))).drop("reach")
    ordered = (F.col("n_x") > F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") > F.col("id_y")))
    meet = lambda a, b: a.join(b, ["token", "cell"]).where(ordered & apart & near & inside(1))
    single = meet(larger.where("apart_x"), smaller).unionByName(meet(larger.where("not apart_x"), smaller.where("apart_y")))
    pairs = single.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))
    ids = member.select("id").distinct()
    short = matches.groupBy("a", "b").agg(F.count("*").alias("other"), F.min("matches").alias("l"))
    some = short.where("other < l").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    pairs = pairs.union(some.select("a", "b")).distinct().join(done, ["a", "b"], "left_anti")
    counted = pairs.join(x.withColumnRenamed("id_x", "a"), "a").join(y.withColumnRenamed("id_y", "b"), ["b", "token"])
    l = F.least("matches_x", "matches_y")
    long = counted.where(apart & near & inside(l)).groupBy("a", "b").agg(F.count_distinct("token").alias("found"), F.min(l).alias("l"))
    enough = long.join(short.drop("l"), ["a", "b"], "left").where("found + coalesce(other, 0) >= l").select("a", "b")
    return written(enough, "pairs")


def jaccard_components(docs: DataFrame, join: JaccardJoin = JaccardJoin()) -> DataFrame:
    """Per row of docs: doc_id, n_shingles (set size), component_id: the smallest doc_id that links reach.

    Null and empty texts and texts without words have an empty set, link with nothing and are their own component. Rows
    that repeat a doc_id are rows of their own; a null doc_id is reported as null and is never the smallest of a group
    that has another. Only doc_id and text are read. An empty table gives no rows."""
    return settled(lambda: _components_of(docs.select("doc_id", "text"), join), "components")


def _components_of(docs: DataFrame, join: JaccardJoin) -> DataFrame:
    rows, least = _grouped(docs, join)
    return rows.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _grouped(docs: DataFrame, join: JaccardJoin) -> tuple[DataFrame, DataFrame]:
    """(rows of linked_nodes() with their component, null for an empty set; the smallest doc_id of each component)."""
    nodes, links = linked_nodes(docs, join)
    known = components(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    rows = nodes.join(known.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return rows, rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))


def near_duplicates_removed(docs: DataFrame, join: JaccardJoin) -> DataFrame:
    """`docs` with one row of each component: that of the smallest doc_id, null ids last, of several such rows that of the smallest row_key().
    Rows with an empty set stay, but rows that repeat both id and text stay once.

    Rows are named by row_key(), so repeated and null ids change nothing. Only rows that go, or that occur several times, are
    shuffled with their texts; all others stay where they are. Columns keep their names and values, whatever they are called."""
    key = unused(docs, "row")
    rows, _ = _grouped(docs.select("doc_id", "text", row_key().alias(key)), join)
    # one row a key: what the component keeps is the key of its smallest (id, key)
    keys = rows.groupBy(key).agg(F.first("doc_id").alias("doc_id"), F.first("component").alias("component"), F.count("*").alias("times"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", key)
    best = keys.where("component is not null").groupBy("component").agg(F.min_by(key, order).alias("best"))
    told = keys.join(best, "component", "left").select(key, (F.col("component").isNull() | (F.col(key) == F.col("best"))).alias("stays"), "times")
    told = written(told.where("times > 1 or not stays").drop("times"), "told")
    asked, rest = among(docs.withColumn(key, row_key()), key, places_filter(told, F.col(key)))
    stay = unused(docs, "stays")
    asked = asked.dropDuplicates([key]).join(told.withColumnRenamed("stays", stay), key, "left").where(F.coalesce(F.col(stay), F.lit(True)))
    return asked.select(*docs.columns).union(rest.select(*docs.columns))
