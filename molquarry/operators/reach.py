"""Paths of up to four steps by blocks of starts. A task takes the starts of one block and reads all hops, packed, once a step, in
stretches by the molecule that a hop leads to; so all paths between two molecules meet in one task, and no table of paths is
written, sent or sorted outside of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.sources.scratch import discard, written

#: Hops of a packed piece and of a stretch; rows that a block keeps between two steps; paths that are looked at together.
PIECE, STRETCH, ROWS, CHUNK = 1_024, 4_000_000, 1_000_000, 400_000
#: Molecules are whole numbers below this, so that a place among the starts fits beside one.
MOST = 1 << 40
#: In place of a yield: not known; no such path.
UNKNOWN, NONE = -1.0, -2.0


class Rows(NamedTuple):
    """Paths from v0 to `at`, by v0: the yields of the kept ones and the molecules between that a next step has to avoid."""

    v0: np.ndarray
    at: np.ndarray
    y: np.ndarray  # (rows, kept paths)
    m: np.ndarray  # (rows, kept paths, molecules)


class Stretch(NamedTuple):
    """Hops by the molecule that they start from: that of place i has hops first[i] to first[i + 1]."""

    near: np.ndarray
    first: np.ndarray
    far: np.ndarray
    z: np.ndarray


def reached(hop: DataFrame, max_depth: int, min_depth: int) -> DataFrame:
    """(near, far, step_count, total_yield), unrounded pairs none: one row a pair and number of steps, from min_depth (or max_depth) to max_depth,
    3 or 4, with the best product of yields, two digits. hop: near, far (bigint from 0 below MOST), y, start (paths begin there),
    one row a pair of different molecules, a written table.

    A block has so many starts that it keeps about ROWS rows between steps; a stretch has about STRETCH hops. The only table
    that is written are the packed hops, about 5 bytes each; blocks read them by a cartesian product. The result is lazy and
    reads them."""
    n = hop.count()
    weight = hop.groupBy("near").agg(F.count("*").cast("double").alias("w"))
    for _ in range(max_depth - 2):  # paths that start at a molecule
        ahead = hop.join(weight.withColumnRenamed("near", "far"), "far")
        weight = ahead.groupBy("near").agg(F.sum("w").alias("w"))
    starts = hop.where("start").select("near").distinct()
    paths = starts.join(weight, "near").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    every = float(starts.count()) * hop.select("far").distinct().count()
    spark = hop.sparkSession
    blocks = int(max(2 * spark.sparkContext.defaultParallelism, -(-min(paths, every) // ROWS)))
    pieces = written(_pieces(hop, max(1, -(-n // STRETCH))), "hops-packed")
    work = spark.range(0, blocks * max_depth, 1, blocks).withColumnRenamed("id", "work")  # a block a partition: its steps in order
    ordered = pieces.coalesce(1).sortWithinPartitions("stretch", "place")
    both = work.hint("shuffle_replicate_nl").crossJoin(ordered).select("work", "stretch", "n", "hops")
    return both.mapInArrow(_walk(blocks, max_depth, min_depth), "near bigint, far bigint, step_count int, total_yield double")


def _pieces(hop: DataFrame, stretches: int) -> DataFrame:
    """The hops as (stretch, place, n, hops): packed pieces, in order of near within a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last, place = None, 0

        def out(rows: np.ndarray, stretch: int, place: int) -> pa.RecordBatch:
            cut = [rows[:, i : i + PIECE] for i in range(0, rows.shape[1], PIECE)]
            packed = [_pack(x) for x in cut]
            return pa.record_batch([pa.array([stretch] * len(cut), pa.int32()), pa.array(range(place, place + len(cut)), pa.int64()), pa.array([x.shape[1] for x in cut], pa.int32()), pa.array(packed, pa.binary())], names=["stretch", "place", "n", "hops"])

        for batch in batches:
            stretch = batch.column("stretch").to_numpy()
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(t).view(np.int64) for c, t in (("near", np.int64), ("far", np.int64), ("y", np.float64), ("start", np.int64))])
            for part in np.split(np.arange(len(stretch)), np.flatnonzero(np.diff(stretch)) + 1):
                if not len(part):
                    continue
                if held and last != stretch[part[0]]:
                    yield out(np.concatenate(held, 1), last, place)
                    held, place = [], 0
                last = int(stretch[part[0]])
                held.append(rows[:, part])
                if sum(x.shape[1] for x in held) >= 64 * PIECE:
                    all_ = np.concatenate(held, 1)
                    whole = all_.shape[1] // PIECE * PIECE
                    yield out(all_[:, :whole], last, place)
                    place += whole // PIECE
                    held = [all_[:, whole:]] if whole < all_.shape[1] else []
        if held:
            yield out(np.concatenate(held, 1), last, place)

    rows = hop.select(F.pmod(F.xxhash64("far"), F.lit(stretches)).cast("int").alias("stretch"), "near", "far", F.coalesce("y", F.lit(UNKNOWN)).alias("y"), "start")
    rows = rows.repartition(stretches, "stretch").sortWithinPartitions("stretch", "near", "far")
    return rows.mapInArrow(run, "stretch int, place bigint, n int, hops binary")


def _pack(rows: np.ndarray) -> bytes:
    """Four columns of 64-bit values, padded to PIECE, byte by byte: equal bytes of neighbouring values stand together."""
    padded = np.zeros((4, PIECE), np.int64)
    padded[:, : rows.shape[1]] = rows
    return pa.compress(np.ascontiguousarray(padded.view(np.uint8).reshape(4, PIECE, 8).transpose(0, 2, 1)).tobytes(), codec="lz4", asbytes=True)


def _unpacked(packed: list[bytes], sizes: np.ndarray) -> np.ndarray:
    size = 32 * PIECE
    raw = b"".join(pa.decompress(x, decompressed_size=size, codec="lz4", asbytes=True) for x in packed)
    planes = np.frombuffer(raw, np.uint8).reshape(len(packed), 4, 8, PIECE)
    whole = np.empty((4, len(packed), PIECE, 8), np.uint8)
    whole[...] = planes.transpose(1, 0, 3, 2)
    used = (np.arange(PIECE) < sizes[:, None]).ravel()
    return whole.view(np.int64).reshape(4, -1)[:, used]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(work, hops of a whole stretch), in order."""
    held: list[np.ndarray] = []
    now = None
    for batch in batches:
        work, stretch, sizes, packed = batch.column("work").to_numpy(), batch.column("stretch").to_numpy(), batch.column("n").to_numpy(), batch.column("hops")
        ends = [0, *(np.flatnonzero(np.diff(work).astype(bool) | np.diff(stretch).astype(bool)) + 1), len(work)]
        for a, b in zip(ends, ends[1:]):
            if a == b:
                continue
            if now is not None and now != (work[a], stretch[a]):
                yield int(now[0]), np.concatenate(held, 1)
                held = []
            now = (work[a], stretch[a])
            for i in range(a, b, 256):
                held.append(_unpacked(packed[i : min(i + 256, b)].to_pylist(), sizes[i : min(i + 256, b)]))
    if now is not None:
        yield int(now[0]), np.concatenate(held, 1)


def _walk(blocks: int, max_depth: int, min_depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, found, now = None, [], -1
        for work, (near, far, y, start) in _stretches(batches):
            block, step = divmod(work, max_depth)
            if work != now:
                kept, found, now = (_joined(found) if step else None), [], work
            z = y.view(np.float64)
            if not step:  # the block's starts
                mine = start.astype(bool) & ((near.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(blocks) == np.uint64(block))
                if mine.any():
                    found.append(Rows(near[mine], far[mine], z[mine, None], np.zeros((mine.sum(), 1, 0), np.int64)))
                continue
            if kept is None:
                continue
            change = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
            table = Stretch(near[change], np.r_[change, len(near)], far, z)
            depth = step + 1
            for rows, hops in _chunks(kept, table):
                if depth == max_depth:
                    v0, v, best = _best(kept, table, rows, hops, max_depth)
                else:
                    more = (_two if step == 1 else _three)(kept, table, rows, hops, max_depth)
                    found.append(more)
                    v0, v, best = more.v0, more.at, more.y[:, 0]
                if len(v0) and depth >= min(min_depth, max_depth) and depth > 1:
                    yield pa.record_batch([pa.array(v0), pa.array(v), pa.array(np.full(len(v), depth, np.int32)), pa.array(_rounded(best), mask=best < 0)], names=["near", "far", "step_count", "total_yield"])

    return run


def _joined(parts: list[Rows]) -> Rows | None:
    """The rows of all stretches, by v0."""
    if not parts:
        return None
    whole = Rows(*(np.concatenate(c) for c in zip(*parts)))
    parts.clear()
    order = np.argsort(whole.v0, kind="stable")
    return Rows(*(c[order] for c in whole))


def _chunks(rows: Rows, table: Stretch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hops that go on from them), all of a start together, about CHUNK at once."""
    place = np.minimum(np.searchsorted(table.near, rows.at), len(table.near) - 1)
    count = np.where(table.near[place] == rows.at, table.first[place + 1] - table.first[place], 0)
    total = np.cumsum(count)
    begins = np.flatnonzero(np.r_[True, rows.v0[1:] != rows.v0[:-1]])  # each start's first row
    group = (total[begins] - count[begins]) // CHUNK
    cuts = [*begins[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])], len(rows.v0)]
    for a, b in zip(cuts, cuts[1:]):
        n = count[a:b]
        if not n.any():
            continue
        row = np.repeat(np.arange(a, b), n)
        skip = np.cumsum(n) - n
        yield row, np.arange(len(row)) + np.repeat(table.first[place[a:b]] - skip, n)


def _times(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.where((y < 0) | (z < 0), np.where(y == NONE, NONE, UNKNOWN), y * z / 100)


def _keys(v0: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the starts, one number for each pair), v0 in order."""
    begins = np.flatnonzero(np.r_[True, v0[1:] != v0[:-1]])[: len(v0)]
    code = np.zeros(len(v0), np.int64)
    code[begins[1:]] = 1
    return v0[begins], np.cumsum(code) * MOST + v


def _pairs(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return starts[keys // MOST], keys % MOST


def _firsts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)]


def _two(one: Rows, table: Stretch, rows: np.ndarray, hops: np.ndarray, max_depth: int) -> Rows:
    """The best middle molecules of each pair, one more than may be forbidden."""
    apart = one.v0[rows] != table.far[hops]
    rows, hops = rows[apart], hops[apart]
    starts, keys = _keys(one.v0[rows], table.far[hops])
    y = _times(one.y[rows, 0], table.z[hops])
    order = np.lexsort((-y, keys))
    keys, y, m = keys[order], y[order], one.at[rows[order]]
    first = _firsts(keys)
    size = np.diff(np.r_[first, len(keys)])
    width = max_depth - 1
    ys, ms = np.full((len(first), width), NONE), np.full((len(first), width, 1), -1)
    for k in range(width):
        has = size > k
        ys[has, k], ms[has, k, 0] = y[first[has] + k], m[first[has] + k]
    return Rows(*_pairs(starts, keys[first]), ys, ms)


def _three(two: Rows, table: Stretch, rows: np.ndarray, hops: np.ndarray, max_depth: int) -> Rows:
    """Of each pair the best path of three steps, the best one without its first and the best one without its second molecule."""
    v = table.far[hops]
    on = [two.m[rows, k, 0] == v for k in range(2)]
    first, second = np.where(on[0], 1, 0), np.where(on[0] | on[1], 2, 1)
    rows, hops, pick = np.tile(rows, 2), np.tile(hops, 2), np.r_[first, second]
    fits = (two.y[rows, pick] != NONE) & (two.v0[rows] != table.far[hops])
    order = np.flatnonzero(fits)
    order = order[np.argsort(rows[order], kind="stable")]
    rows, hops, pick = rows[order], hops[order], pick[order]
    starts, keys = _keys(two.v0[rows], table.far[hops])
    y = _times(two.y[rows, pick], table.z[hops])
    order = np.lexsort((-y, keys))
    rows, keys, y, v1 = rows[order], keys[order], y[order], two.m[rows[order], pick[order], 0]
    v2 = two.at[rows]
    at = _firsts(keys)
    size = np.diff(np.r_[at, len(keys)])
    group = np.repeat(np.arange(len(at)), size)
    ys, ms = np.full((len(at), 3), NONE), np.zeros((len(at), 3, 2), np.int64)
    ys[:, 0], ms[:, 0, 0], ms[:, 0, 1] = y[at], v1[at], v2[at]
    for k in (1, 2):
        gone = ms[group, 0, k - 1]
        left = np.flatnonzero((v1 != gone) & (v2 != gone))
        left = left[_firsts(group[left])]
        ys[group[left], k] = y[left]
    return Rows(*_pairs(starts, keys[at]), ys, ms[:, :1])


def _best(kept: Rows, table: Stretch, rows: np.ndarray, hops: np.ndarray, max_depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v0, v, best yield) of the last step."""
    v = table.far[hops]
    if max_depth == 3:
        pick = np.where(kept.m[rows, 0, 0] == v, 1, 0)
    else:
        pick = np.where(kept.m[rows, 0, 0] == v, 1, np.where(kept.m[rows, 0, 1] == v, 2, 0))
    y = kept.y[rows, pick]
    fits = (y != NONE) & (kept.v0[rows] != v)
    rows, hops, y = rows[fits], hops[fits], y[fits]
    starts, keys = _keys(kept.v0[rows], table.far[hops])
    order = np.argsort(keys)
    keys, y = keys[order], _times(y, table.z[hops])[order]
    at = _firsts(keys)
    return *_pairs(starts, keys[at]), np.maximum.reduceat(y, at) if len(at) else y


def _rounded(y: np.ndarray) -> np.ndarray:
    """Two digits, half up as decimals are written (that is how Spark rounds)."""
    t = y * 100
    whole = np.floor(t + 0.5)
    out = whole / 100
    near = np.flatnonzero(np.abs(t - np.floor(t) - 0.5) < 1e-6)
    if len(near):
        some, back = np.unique(y[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(x))).quantize(Decimal("0.01"), ROUND_HALF_UP)) for x in some])[back]
    return out
