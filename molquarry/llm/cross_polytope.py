"""Approximate nearest neighbours by cross-polytope hashing, with multiprobe tables and exact reranking.

Nodes. Rows with equal vectors are one node with its smallest ids, so a large group of copies is searched, and found, once.
Nothing is lost: of equal vectors those with the smallest ids come first, and no query needs more than k + 1 of them.

Hash. A unit vector is rotated by three rounds of random signs and a fast Hadamard transform (padded to a power of two)
and assigned to the nearest of the signed axes, the one of its largest component. A table's bucket is the axis of one
such rotation, or of two where the nodes are many. Every node is in one bucket of every table.

Probes. A query visits the buckets of each table in the order of its own rotated components (their sum, with two rotations).
How many is not guessed: for a bounded sample of queries the true neighbours are found by a scan of all nodes, and the
number of probes is the least that reaches `recall` of them. So the index fits itself to the vectors' distribution.

Search. Nodes and queries meet by bucket; a bucket with many rows or queries is split into tiles of some rows by some queries, so
that no task holds more than a tile's queries and a batch of rows. A tile keeps the nearest k + 1 nodes of each query.
Distances select by a matrix product and are then taken anew from the differences, in doubles. Queries that find fewer than
they could (in small tables) are searched in all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molquarry.llm.common import settled, written
from molquarry.llm.vectors import matrices, usual_length

#: Stands for a null id, so that it comes last.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class CrossPolytope:
    """k neighbours; `tables` tables of one rotation, or of two from `wide` nodes on; the sample that sets the number of probes, unless that
    is given."""

    k: int = 10
    tables: int = 4
    recall: float = 0.95
    probes: int | None = None
    sample: int = 256
    wide: int = 4_000_000
    tile_rows: int = 1_000_000
    tile_queries: int = 4096
    seed: int = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


class Rotations:
    """tables x depth pseudo-random rotations of vectors of length dim."""

    def __init__(self, dim: int, depth: int, index: CrossPolytope):
        self.size, self.depth, self.tables = 1 << max(0, dim - 1).bit_length(), depth, index.tables
        rng = np.random.default_rng(index.seed)
        self.signs = rng.choice([-1.0, 1.0], (index.tables, depth, 3, self.size))
        self.axes = 2 * self.size
        self.buckets = self.axes**depth

    def turned(self, x: np.ndarray, table: int, place: int) -> np.ndarray:
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = unit
        for signs in self.signs[table, place]:
            y = hadamard(y * signs)
        return y

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row: the signed axis nearest to it, for each rotation in turn."""
        out = np.zeros(len(x), np.int64)
        for place in range(self.depth):
            y = self.turned(x, table, place)
            axis = np.abs(y).argmax(axis=1)
            out = out * self.axes + 2 * axis + (y[np.arange(len(y)), axis] > 0)
        return out

    def scores(self, x: np.ndarray, table: int) -> np.ndarray:
        """(rows, buckets): how near each bucket's axes are to each row; the highest first is the order of probes."""
        out = np.zeros((len(x), 1))
        for place in range(self.depth):
            y = self.turned(x, table, place)
            signed = np.stack([-y, y], axis=2).reshape(len(x), -1)
            out = (out[:, :, None] + signed[:, None, :]).reshape(len(x), -1)
        return out


def _valid(rows: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    """(vec_id, v): ids with their vectors as 8-byte components, of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, 1, dim, zero=False):
            x = x + 0.0  # -0.0 is 0.0
            raw = x.astype("<f8").tobytes()
            size = 8 * dim
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())], names=["vec_id", "v"])

    ids = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("vec_id"), F.col(vector).alias("v"))
    return ids.mapInArrow(run, "vec_id long, v binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def nodes_of(rows: DataFrame, index: CrossPolytope) -> DataFrame:
    """(key, v, ids) of rows(vec_id, v): one row a different vector, with its k + 1 smallest ids (repeated ones too). No task gets more than
    that many rows of a vector from each other task."""
    order = Window.partitionBy("key").orderBy("vec_id")
    first = rows.select(F.unhex(F.md5("v")).alias("key"), "v", "vec_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= index.k + 1)
    return first.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def true_neighbours(nodes: DataFrame, asked: list, dim: int, k: int) -> DataFrame:
    """(s, key, v, d) of the k nodes nearest to each of a few nodes (key, v), itself left out, by a scan of all."""
    q, own = np.frombuffer(b"".join(bytes(r["v"]) for r in asked), "<f8").reshape(-1, dim), [bytes(r["key"]) for r in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, x = batch.column(0).to_pylist(), _matrix(batch.column(1), dim)
            at = {key: i for i, key in enumerate(keys)}
            d = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * q @ x.T
            for s, key in enumerate(own):
                if key in at:
                    d[s, at[key]] = np.inf
            best = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            s = np.repeat(np.arange(len(q)), best.shape[1])
            j = best.ravel()
            keep = np.isfinite(d[s, j])
            s, j = s[keep], j[keep]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), batch.column(0).take(pa.array(j)), batch.column(1).take(pa.array(j)), pa.array(d[s, j])], names=["s", "key", "v", "d"])

    found = nodes.select("key", "v").mapInArrow(run, "s int, key binary, v binary, d double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("d", "key"))).where(F.col("r") <= k).drop("r")


def fitted_probes(nodes: DataFrame, asked: DataFrame, turns: Rotations, dim: int, index: CrossPolytope) -> tuple[int, float]:
    """(probes a table, recall of the sample): the least number of probes whose buckets hold `recall` of the sample's true neighbours."""
    some = asked.orderBy("key").limit(index.sample).collect()  # keys are hashes; `sample` nodes
    if not some:
        return 1, 1.0
    near = true_neighbours(nodes, some, dim, index.k).collect()  # sample x k rows
    if not near:
        return turns.buckets, 1.0
    q = np.frombuffer(b"".join(bytes(r["v"]) for r in some), "<f8").reshape(-1, dim)
    x = np.frombuffer(b"".join(bytes(r["v"]) for r in near), "<f8").reshape(-1, dim)
    s, place = np.array([r["s"] for r in near]), np.full(len(near), turns.buckets)
    for table in range(turns.tables):
        own, at = turns.scores(q, table), turns.bucket(x, table)
        for i in range(len(q)):
            mine = np.flatnonzero(s == i)
            better = len(own[i]) - np.searchsorted(np.sort(own[i]), own[i][at[mine]], side="right")
            place[mine] = np.minimum(place[mine], better)
    needed = np.sort(place)
    probes = int(needed[min(len(needed) - 1, int(np.ceil(index.recall * len(needed))) - 1)]) + 1
    return probes, float((place < probes).mean())


FOUND = "q binary, key binary, ids array<long>, d double"


def _tiles(dim: int, index: CrossPolytope):
    """Over rows (tile, kind, key, v, ids) sorted by tile and kind, queries (kind 0) before nodes: the k + 1 nodes nearest to each query of a tile."""
    most = index.k + 1

    def nearest(q: np.ndarray, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, squared distance) of pairs, among them all that are in the k + 1 nearest rows of a query and not beyond `bound`."""
        with np.errstate(over="ignore", invalid="ignore"):
            qq, xx = (q * q).sum(axis=1)[:, None], (x * x).sum(axis=1)[None]
            rough = qq + xx - 2 * q @ x.T
            slack = 1e-9 * (qq[:, 0] + xx.max())  # far more than the product's rounding
            limit = np.partition(rough, most - 1, axis=1)[:, most - 1] if len(x) > most else np.full(len(q), np.inf)
            i, j = np.nonzero(~(rough > (np.minimum(limit, bound) + slack)[:, None]))
            apart = q[i] - x[j]
            return i, j, np.einsum("ij,ij->i", apart, apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asked, q = None, [], np.zeros((0, dim))
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, object))  # query, distance, smallest id, key, ids

        def flush() -> Iterator[pa.RecordBatch]:
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in best[0]], pa.binary()), pa.array(list(best[3]), pa.binary()), pa.array(list(best[4]), pa.list_(pa.int64())), pa.array(best[1])], names=["q", "key", "ids", "d"])

        def take(batch: pa.RecordBatch) -> None:
            nonlocal best
            x, keys, ids = _matrix(batch.column(3), dim), batch.column(2), batch.column(4)
            step = max(1, 2_000_000 // max(1, len(asked)))
            for at in range(0, len(x), step):
                bound = np.full(len(asked), np.inf)
                full = np.bincount(best[0], minlength=len(asked)) >= most
                worst = np.zeros(len(asked))
                np.maximum.at(worst, best[0], best[1])
                bound[full] = worst[full]
                i, j, d = nearest(q, x[at : at + step], bound)
                rows = pa.array(j + at)
                own = ids.take(rows).to_pylist()
                new = (i, d, np.array([o[0] for o in own], np.int64), np.fromiter(keys.take(rows).to_pylist(), object, len(own)), np.fromiter(own, object, len(own)))
                both = [np.concatenate([a, b]) for a, b in zip(best, new, strict=True)]
                order = np.lexsort((both[2], both[1], both[0]))
                who = both[0][order]
                starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
                place = np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)]))
                best = tuple(c[order[place < most]] for c in both)

        for batch in batches:
            tiles, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1])])
            for at, to in zip(cuts, np.r_[cuts[1:], len(tiles)], strict=True):
                part = batch.slice(at, to - at)
                if tiles[at] != tile:
                    yield from flush()
                    tile, asked, q, best = tiles[at], [], np.zeros((0, dim)), tuple(c[:0] for c in best)
                if kinds[at] == 0:
                    asked += part.column(2).to_pylist()
                    q = np.concatenate([q, _matrix(part.column(3), dim)])
                elif asked:
                    take(part)
        yield from flush()

    return run


def _met(nodes: DataFrame, asked: DataFrame, turns: Rotations, probes: int, dim: int, index: CrossPolytope) -> DataFrame:
    """(q, key, ids, d): the nearest nodes of each query (key, v) in each tile of the buckets that it probes."""
    tables, buckets = turns.tables, turns.buckets

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield batch, np.stack([turns.bucket(_matrix(batch.column(1), dim), t) + t * buckets for t in range(tables)], axis=1)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        step = max(1, 4_000_000 // buckets)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x, out = _matrix(batch.column(1), dim), []
                for t in range(tables):
                    scores = turns.scores(x, t)
                    first = np.argpartition(-scores, min(probes, buckets) - 1, axis=1)[:, :probes] if probes < buckets else np.broadcast_to(np.arange(buckets), scores.shape)
                    out.append(first + t * buckets)
                yield batch, np.concatenate(out, axis=1)

    def counted(find):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(tables * buckets, np.int64)
            for _, at in find(batches):
                total += np.bincount(at.ravel(), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

        return run

    def counts(rows: DataFrame, find) -> np.ndarray:
        out = np.zeros(tables * buckets, np.int64)
        for r in rows.select("key", "v").mapInArrow(counted(find), "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # tables x buckets rows
            out[r["b"]] = r["n"]
        return out

    n_rows, n_asked = counts(nodes, own), counts(asked, probed)
    parts, blocks = -(-n_rows // index.tile_rows), -(-n_asked // index.tile_queries)
    parts = np.maximum(parts, 1)
    first = np.r_[0, np.cumsum(parts * blocks)]

    def dealt(find, kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, at in find(batches):
                salt = np.frombuffer(b"".join(k[:8] for k in batch.column(0).to_pylist()), "<u8")[:, None]
                p, b = parts[at], blocks[at]
                place = (salt % p.astype(np.uint64) if kind else salt % np.maximum(b, 1).astype(np.uint64)).astype(np.int64)
                many = b if kind else p  # a node meets all blocks of queries, a query all parts of a bucket
                row = np.repeat(np.repeat(np.arange(len(at)), at.shape[1]), many.ravel())
                base, width = np.repeat((first[at] + (place * b if kind else place)).ravel(), many.ravel()), np.repeat((np.ones_like(b) if kind else b).ravel(), many.ravel())
                run_at = np.arange(len(row)) - np.repeat(np.cumsum(many.ravel()) - many.ravel(), many.ravel())
                for s in range(0, len(row), 20_000):
                    take = pa.array(row[s : s + 20_000])
                    ids = batch.column(2).take(take) if kind else pa.nulls(len(take), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array((base + width * run_at)[s : s + 20_000]), pa.array(np.full(len(take), kind, np.int32)), batch.column(0).take(take), batch.column(1).take(take), ids], names=["tile", "kind", "key", "v", "ids"])

        return run

    schema = "tile long, kind int, key binary, v binary, ids array<long>"
    both = asked.select("key", "v").mapInArrow(dealt(probed, 0), schema).unionByName(nodes.select("key", "v", "ids").mapInArrow(dealt(own, 1), schema))
    return both.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(_tiles(dim, index), FOUND)


def _best(met: DataFrame, index: CrossPolytope) -> DataFrame:
    """(q, hits) with hits the k + 1 nearest (d, vec_id) of each query node, over all tiles; a query has a bounded number of them."""
    each = met.dropDuplicates(["q", "key"]).select("q", "d", F.explode("ids").alias("vec_id"))
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("r") <= index.k + 1)
    return each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "vec_id"))).alias("hits"))


def neighbours(rows: DataFrame, queries: str, index: CrossPolytope = CrossPolytope(), id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest by Euclidean distance that are found for every row whose id fulfils the SQL condition
    `queries` (on vec_id), ties to the smaller id; all other rows are candidates.

    Rows whose vector is null, zero, of another length than the usual one, or holds null or non-finite components take no
    part. A row with a null id is no query and is found with a null id, after others at the same distance. Repeated ids
    and rows are rows of their own: equal vectors are each other's neighbours at distance 0, and a query row that occurs
    twice has its results twice. Other columns are not read. A query finds all candidates if there are k or fewer; a
    table without other rows gives none. Squares beyond the range of doubles count as infinite."""
    return settled(lambda: _neighbours(rows, queries, index, id_col, vector), "neighbours")


def _neighbours(rows: DataFrame, queries: str, index: CrossPolytope, id_col: str, vector: str) -> DataFrame:
    dim = usual_length(rows, vector)
    if not dim:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = _valid(rows, id_col, vector, dim)
    nodes = written(nodes_of(valid, index), "nodes")
    asked = written(valid.where(F.expr(queries) & (F.col("vec_id") < LAST)).select("vec_id", F.unhex(F.md5("v")).alias("key"), "v"), "asked")
    search = written(asked.groupBy("key").agg(F.first("v").alias("v")), "asked-nodes")
    turns = Rotations(dim, 2 if nodes.count() >= index.wide else 1, index)
    probes = min(index.probes, turns.buckets) if index.probes else fitted_probes(nodes, search, turns, dim, index)[0]
    best = written(_best(_met(nodes, search, turns, probes, dim, index), index), "best")
    total = nodes.select(F.size("ids").alias("n")).limit(index.k + 1).agg(F.sum("n")).first()[0] or 0
    enough = best.where(F.size("hits") >= min(total, index.k + 1))
    short = written(search.join(enough.select(F.col("q").alias("key")), "key", "left_anti"), "short")
    if not short.isEmpty():
        best = written(enough.unionByName(_best(_met(nodes, short, turns, turns.buckets, dim, index), index)), "best")
    # the query's own row is one of those at distance 0 with its id, if it is among the first at all
    own = F.array_position("hits", F.struct(F.lit(0.0).alias("d"), F.col("query_id").alias("vec_id"))).cast("int")
    rest = F.when(own > 0, F.concat(F.slice("hits", F.lit(1), own - 1), F.slice("hits", own + 1, F.lit(index.k)))).otherwise(F.slice("hits", 1, index.k))
    found = asked.select(F.col("vec_id").alias("query_id"), "key").join(best.withColumnRenamed("q", "key"), "key").select("query_id", F.posexplode(rest).alias("rank", "hit"))
    return found.select("query_id", (F.col("rank") + 1).alias("rank"), F.nullif(F.col("hit.vec_id"), F.lit(LAST)).alias("vec_id"), F.sqrt("hit.d").alias("score"))
