"""The nearest bit sets of every query by comparing all pairs in tiles. A task takes a block of queries, reads all rows, packed, and keeps
the best hits of each query, so only results leave it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molquarry.sources.scratch import written

#: Queries of a block at most; rows of a packed piece and of a tile; hits that are held before the best are picked.
QUERIES, PIECE, TILE, HELD = 1_024, 1_024, 4_096, 400_000


def nearest(known: DataFrame, asked: DataFrame, n_words: int, limit: int, threshold: float, inclusive: bool, with_self: bool) -> DataFrame:
    """(query, id, similarity): at least the best `limit` hits of each query, by Tanimoto similarity over the threshold (or at it), then id, and no
    wrong ones; a query that comes with several sets has those of each. known: id, words; asked: query, asked (distinct), neither
    null, ids bigint, words n_words 64-bit words; other arrays match nothing.

    Exact: every pair is compared, as one row of a product of matrices; that is quadratic by nature, but takes a few
    nanoseconds a pair, and memory for one block of queries and a tile of rows. Of equal sets only as many rows are compared
    as a query can need. Nothing is shuffled but the rows and queries themselves, 8 bytes a word."""
    whole = lambda c: (F.size(c) == n_words) & ~F.exists(c, lambda x: x.isNull())
    known, asked = known.where(whole("words")), asked.where(whole("asked"))
    rows = known.groupBy("words", "id").agg(F.least(F.count("*"), F.lit(limit)).cast("int").alias("times"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("words").orderBy("id"))).where(F.col("r") <= limit + 1)
    rows = rows.select("words", F.explode(F.array_repeat("id", F.col("times"))).alias("id"))
    packed = "n int, ids binary, words binary"
    rows = written(rows.select("id", "words").mapInArrow(_packs(n_words, PIECE), packed), "rows-packed")
    asked = written(asked.select(F.col("query").alias("id"), F.col("asked").alias("words")), "asked")
    cores = asked.sparkSession.sparkContext.defaultParallelism
    block = int(min(QUERIES, max(1, -(-asked.count() // (4 * cores)))))
    blocks = written(asked.mapInArrow(_packs(n_words, block), packed), "asked-packed").repartition(4 * cores)
    q = blocks.select(F.monotonically_increasing_id().alias("block"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("words").alias("qwords"))
    # block by block: the rows in one partition, so that a task has a block's hits together
    met = q.hint("shuffle_replicate_nl").crossJoin(rows.coalesce(1))
    return met.mapInArrow(_hits(n_words, limit, threshold, inclusive, with_self), "query bigint, id bigint, similarity double")


def _packs(n_words: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, words) as pieces of `size`: (n, ids, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words = np.zeros(0, np.int64), np.zeros((0, n_words), np.int64)

        def piece(ids: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([words.tobytes()], pa.binary())], names=["n", "ids", "words"])

        for batch in batches:
            ids = np.r_[ids, batch.column("id").to_numpy()]
            words = np.r_[words, batch.column("words").flatten().to_numpy().reshape(-1, n_words)]
            while len(ids) >= size:
                yield piece(ids[:size], words[:size])
                ids, words = ids[size:], words[size:]
        if len(ids):
            yield piece(ids, words)

    return run


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.float32)


class _Block:
    """A block of queries with the best hits so far. Words are unsigned: of a negative number numpy counts the bits of its absolute value."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, limit: int, threshold: float, inclusive: bool, with_self: bool):
        self.ids, self.words, self.limit, self.threshold, self.inclusive, self.with_self = ids, words, limit, threshold, inclusive, with_self
        self.n = np.bitwise_count(words).sum(1, dtype=np.int64)
        self.bits = np.c_[_bits(words), np.zeros((len(ids), 2), np.float32)]
        self.least = np.full(len(ids), threshold)  # the similarity that a hit needs
        self.hits = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        self.new: list[tuple[np.ndarray, ...]] = []
        self.held = self.seen = 0
        self._aim()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, ids, similarities)"""
        self._pick()
        q, score, ids = self.hits
        return self.ids[q], ids, score

    def _aim(self) -> None:
        """similarity >= t if common bits >= t / (1 + t) of both sets' bits: the last two columns make the product the difference."""
        t = np.maximum(self.least, 0)
        self.bits[:, -2], self.bits[:, -1] = -(t / (1 + t)), -(t / (1 + t)) * self.n

    def meet(self, ids: np.ndarray, words: np.ndarray) -> None:
        """A tile of rows; the first one in growing steps, as nothing tells good hits from bad before."""
        a = 0
        while a < len(ids):
            b = a + max(4 * self.limit, self.seen)
            self._step(ids[a:b], words[a:b])
            if self.held > HELD or self.seen < TILE:
                self._pick()
            self.seen, a = self.seen + len(ids[a:b]), b

    def _step(self, ids: np.ndarray, words: np.ndarray) -> None:
        n = np.bitwise_count(words).sum(1, dtype=np.int64)
        margin = self.bits @ np.c_[_bits(words), n.astype(np.float32), np.ones(len(ids), np.float32)].T
        near = np.flatnonzero(margin > -(1e-3 + 64e-6 * words.shape[1]))  # float32 rounds; what is near enough is compared exactly
        q, r = np.divmod(near, len(ids))
        both = np.bitwise_count(self.words[q] & words[r]).sum(1, dtype=np.int64)
        all_ = self.n[q] + n[r] - both
        score = both / np.maximum(all_, 1)
        fits = (all_ > 0) & (score >= self.least[q]) & (score >= self.threshold if self.inclusive else score > self.threshold)
        if not self.with_self:
            fits &= self.ids[q] != ids[r]
        q, r, score = q[fits], r[fits], score[fits]
        self.new.append((q, score, ids[r]))
        self.held += len(q)

    def _pick(self) -> None:
        q, score, ids = (np.concatenate([old, *more]) for old, more in zip(self.hits, zip(*self.new) if self.new else ((), (), ())))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, np.arange(len(self.ids)))
        rank = np.arange(len(q)) - first[q]
        last = rank == self.limit - 1
        self.least[q[last]] = score[last]
        keep = rank < self.limit
        self.hits, self.new, self.held = [q[keep], score[keep], ids[keep]], [], 0
        self._aim()


def _hits(n_words: int, limit: int, threshold: float, inclusive: bool, with_self: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now, ids, words, held = None, None, [], [], 0

        def meet() -> None:
            nonlocal ids, words, held
            if held:
                block.meet(np.concatenate(ids), np.concatenate(words))
                ids, words, held = [], [], 0

        def told() -> pa.RecordBatch:
            meet()
            return pa.record_batch([pa.array(x) for x in block.best()], names=["query", "id", "similarity"])

        whole = lambda x: np.frombuffer(x.as_buffer(), np.int64)
        for batch in batches:
            for i, at in enumerate(batch.column("block").to_pylist()):
                if at != now:
                    if block is not None:
                        yield told()
                    now, block = at, _Block(whole(batch.column("qids")[i]), whole(batch.column("qwords")[i]).reshape(-1, n_words).view(np.uint64), limit, threshold, inclusive, with_self)
                ids.append(whole(batch.column("ids")[i]))
                words.append(whole(batch.column("words")[i]).reshape(-1, n_words).view(np.uint64))
                held += len(ids[-1])
                if held >= TILE:
                    meet()
        if block is not None:
            yield told()

    return run
