"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and all other characters outside ASCII, without regard to case. Seeds are the k-word runs of the benchmark items; a document's
runs that are seeds join it with the items that have them. Each such pair is tiled with Running Karp-Rabin: windows
of a search length are matched by their hashes and extended, the longest matches are marked first on both sides, and
the search length falls until it is k; no word is marked twice. The share of an item's words that are marked is its
coverage in the document, however its parts are ordered there.

The benchmark is counted first and dealt into blocks of about `block_words` words by a hash of the item, each
collected and broadcast in turn, so what a task holds is bounded by the setting; documents are never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import WordHashes, gram_hashes, sparing

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Rows of an Arrow batch that are turned into Python strings together; bits of the map that most runs fail to pass.
ROWS, MAP_BITS = 500, 22


@dataclass(frozen=True)
class Tiling:
    """k: words of the shortest tile and of seeds (an item of fewer words is one seed); an item is found in a document if
    100 * marked words >= coverage_percent * its words."""

    k: int = 5
    coverage_percent: int = 80
    block_words: int = 1_000_000


def _folded(text: str) -> str:
    """The text without case, composed; case folding may leave composed letters apart and is composed again."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


def _words(text: str | None) -> list[bytes]:
    return WORD.findall(_folded(text).encode("utf-8", "replace")) if text else []


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """(length, place in a, place in b) of the longest matches at equal windows of s unmarked words."""

    def windows(x, free):
        if len(x) < s:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(np.convolve(free, np.ones(s, int), "valid") == s)
        return at, gram_hashes(x, s)[at]

    at_a, hash_a = windows(a, free_a)
    at_b, hash_b = windows(b, free_b)
    places: dict[int, list[int]] = {}
    for p, h in zip(at_a.tolist(), hash_a.tolist(), strict=True):
        places.setdefault(h, []).append(p)
    found = []
    for q, h in zip(at_b.tolist(), hash_b.tolist(), strict=True):
        for p in places.get(h, ()):
            if p and q and free_a[p - 1] and free_b[q - 1] and a[p - 1] == b[q - 1]:
                continue  # inside a match that begins earlier
            n = 0
            while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and free_a[p + n] and free_b[q + n]:
                n += 1
            if n >= s:
                found.append((n, p, q))
    return found


def greedy_tiles(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(length, place in a, place in b) of the tiles of two arrays of word hashes, longest first."""
    free_a, free_b = np.ones(len(a), int), np.ones(len(b), int)
    tiles, s = [], max(k, len(a))
    while len(a) and len(b):
        found = _matches(a, b, free_a, free_b, s)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for n, p, q in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_a[p : p + n].all() and free_b[q : q + n].all():
                free_a[p : p + n] = free_b[q : q + n] = 0
                tiles.append((n, p, q))
            else:
                again = True  # what is left of it may still be long enough
        if again and any(_matches(a, b, free_a, free_b, s)):
            continue
        if s <= k or not free_a.any():
            break
        s = max(k, s // 2)
    return tiles


class Index:
    """The seeds of a block of benchmark items (id, text), by their length in words.

    All marked words of an item are under seeds that the document has. So a document that covers an item has a seed outside any
    choice of seeds under which too few of the item's words are. The choice that is left out begins with the seeds that most
    items share; only the others are looked up, so a sentence of many items does not join its documents with all of them."""

    def __init__(self, items: list[tuple], spec: Tiling):
        hashes = WordHashes()
        self.ids = [i for i, _ in items]
        self.words = [hashes.of(_words(t)) for _, t in items]
        self.grams = [gram_hashes(w, spec.k) for w in self.words]  # an item of fewer words is one seed
        self.seeds = {}
        for k in sorted({min(spec.k, len(w)) for w in self.words if len(w)}):
            own = [i for i, w in enumerate(self.words) if min(spec.k, len(w)) == k]
            every = np.concatenate([np.unique(self.grams[i]) for i in own])
            every.sort()
            looked = [self._rare(g := self.grams[i], np.searchsorted(every, g, "right") - np.searchsorted(every, g, "left"), len(self.words[i]), k, spec) for i in own]
            grams = np.concatenate(looked)
            order = np.argsort(grams, kind="stable")
            passing = np.zeros(1 << MAP_BITS, bool)
            passing[(every >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
            self.seeds[k] = grams[order], np.repeat(own, [len(g) for g in looked])[order], passing, np.unique(every)

    @staticmethod
    def _rare(grams: np.ndarray, shared: np.ndarray, n: int, k: int, spec: Tiling) -> np.ndarray:
        """The seeds that stay when the most shared ones are left out while less than the coverage of n words is under them."""
        order = np.argsort(-shared, kind="stable").tolist()
        under, covered = bytearray(n), 0
        for out, p in enumerate(order):
            covered += k - sum(under[p : p + k])
            if 100 * covered >= spec.coverage_percent * n:
                return np.unique(grams[order[out:]])
            under[p : p + k] = b"\1" * k
        return np.unique(grams)

    def found(self, words: np.ndarray, spec: Tiling) -> Iterator[tuple[int, int, int]]:
        """(item number, marked words, tiles) of the items that a document of these word hashes covers enough."""
        for k, (grams, item, passing, every) in self.seeds.items():
            if len(words) < k:
                continue
            runs = gram_hashes(words, k)
            at = np.flatnonzero(passing[(runs >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
            if len(at):
                at = at[every[np.minimum(np.searchsorted(every, runs[at]), len(every) - 1)] == runs[at]]
            if not len(at):
                continue
            seen = np.unique(runs[at])
            low, high = np.searchsorted(grams, seen, "left"), np.searchsorted(grams, seen, "right")
            sizes = high - low
            place = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for i in np.unique(item[place]).tolist():
                target, own = self.words[i], self.grams[i]
                least = spec.coverage_percent * len(target)
                under = np.zeros(len(target) + k, bool)
                for d in range(k):
                    under[np.flatnonzero(np.isin(own, seen)) + d] = True
                if 100 * int(under.sum()) < least:
                    continue  # too few of its words are under seeds
                places = at[np.isin(runs[at], own)]
                # only the words under seeds can be in a tile; stretches are kept apart by a hash of their place
                covered = np.zeros(len(words) + 1, bool)
                for d in range(k):
                    covered[places + d] = True
                stretch = np.flatnonzero(covered)
                gaps = np.flatnonzero(np.diff(stretch) > 1) + 1
                text = np.insert(words[stretch], gaps, ~words[stretch[gaps]] if len(gaps) else [])
                tiles = greedy_tiles(target, text, k)
                marked = sum(n for n, _, _ in tiles)
                if 100 * marked >= least:
                    yield i, marked, len(tiles)


def _blocks(items: DataFrame, spec: Tiling) -> Iterator[Index]:
    """The benchmark's blocks, one at a time."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    words = items.agg(F.coalesce(F.sum(F.octet_length("text") / 4), F.lit(0))).first()[0]
    n = int(words // spec.block_words) + 1
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()  # about block_words words
        if rows:
            yield Index([tuple(r) for r in sorted(rows, key=str)], spec)


def contaminated(docs: DataFrame, items: DataFrame, spec: Tiling = Tiling()) -> DataFrame:
    """(doc_id, item_id, item_words, marked_words, n_tiles, coverage) of every document and benchmark item found in it.

    docs: doc_id, text; items: item_id, text. Rows with null, empty or wordless texts are never found. Repeated documents
    give rows each; repeated items count once. Empty tables give no rows. Other columns are not read."""
    out = "doc_id long, item_id long, item_words int, marked_words int, n_tiles int, coverage double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.withColumn("item_id", F.col("item_id").cast("long"))
    parts = []
    for index in _blocks(items, spec):
        parts.append(rows.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(index), spec), out))
    found = parts[0] if parts else docs.sparkSession.createDataFrame([], out)
    for part in parts[1:]:
        found = found.union(part)
    return found


def _search(shared, spec: Tiling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = shared.value, WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for i, marked, n in index.found(hashes.of(_words(text)), spec):
                        size = len(index.words[i])
                        out.append((doc_id, index.ids[i], size, marked, n, marked / size))
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "item_words", "marked_words", "n_tiles", "coverage"])

    return sparing(run)


def decontaminated(docs: DataFrame, items: DataFrame, spec: Tiling = Tiling()) -> DataFrame:
    """The rows of docs in which no benchmark item is found; columns stay."""
    place = docs.columns.index("text")
    for index in _blocks(items, spec):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hashes = shared.value, WordHashes()
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    clean = [not any(True for _ in index.found(hashes.of(_words(t)), spec)) for t in part.column(place).to_pylist()]
                    yield part.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(sparing(run), docs.schema)
    return docs
