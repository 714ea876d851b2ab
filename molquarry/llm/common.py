"""Small helpers that the text operators share: tables that cut lineage, bitmaps of keys, slices of texts, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.sources.scratch import discard, fresh_path, settled, shared_dir, written  # noqa: F401

#: Distinct words whose hashes a task keeps; a task that meets more starts the table again.
WORD_CACHE = 150_000

MASK64 = 0xFFFFFFFFFFFFFFFF


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of an id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def place_of(key: Column, bits: int) -> Column:
    """One of 2^bits places (bits <= 32) for a binary key."""
    return F.crc32(key).bitwiseAND(F.lit((1 << bits) - 1))


def places_filter(keys: DataFrame, key: Column) -> tuple[int, np.ndarray]:
    """(bits, bitmap of 2^bits places as 64-bit words) of the binary keys of a written table: about 64 places a key, 2^30 places (128 MB) at
    most. What passes it may be one of the keys; a join has to make that exact."""
    bits = min(30, max(16, (64 * keys.count()).bit_length()))
    places = keys.select(place_of(key, bits).alias("place"))
    words = places.groupBy(F.expr("cast(place div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("v"))
    parts = words.groupBy(F.expr("word div 4096").alias("p")).agg(F.collect_list("word").alias("w"), F.collect_list("v").alias("v"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in parts.toLocalIterator():
        out[np.array(r["w"])] = r["v"]
    return bits, out


def passes(places: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which places are set in the bitmap."""
    return (bitmap[places >> 6] >> (places & 63) & 1).astype(bool)


def row_key() -> Column:
    """Names a row by its doc_id and text; rows that repeat both share a key."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def among(docs: DataFrame, key: str, places: tuple[int, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """(the rows whose binary `key` passes a places_filter(), the others); neither is shuffled. What passes may be another key."""
    bits, bitmap = places
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2^bits places, bounded
    place = unused(docs, "place")

    def chosen(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passes(batch.column(0).to_numpy(), shared.value) == want))

        rows = docs.select(place_of(F.col(key), bits).alias(place), *docs.columns)
        return rows.mapInArrow(sparing(run), rows.schema).drop(place)

    return chosen(True), chosen(False)


def give_back() -> None:
    """Hands free memory of this process back to the system. A Python worker stays for the tasks of later stages, so what it keeps adds to
    what those take."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def sparing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow(), that gives memory back when its task ends: after its own tables are gone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def text_slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 500, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the bytes of their texts (null: none): `rows` rows and `most` bytes at most, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            part = batch.slice(at, min(rows, max(1, to - at)))
            yield part, [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
            at += part.num_rows
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def local_path(uri: str) -> str | None:
    """The path of a file:// address or a plain path; None where the file lies in another store."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path)
    return None


class WordTable:
    """Values of distinct words, made in bulk by make(list of words) -> dict. Words met in two slices of text or more stay
    while there is room, so that the many words met once push out each other only. Memory is bounded by 2 * room words."""

    def __init__(self, make: Callable[[list], dict], room: int = 250_000):
        self.make, self.room, self.hot, self.recent = make, room, {}, {}

    def clear(self) -> None:
        self.hot, self.recent = {}, {}

    def of(self, words: set) -> dict:
        found, missing, hot, recent = {}, [], self.hot, self.recent
        for w in words:
            v = hot.get(w)
            if v is None:
                v = recent.get(w)
                if v is None:
                    missing.append(w)
                    continue
                hot[w] = v
            found[w] = v
        made = self.make(missing)
        if len(recent) + len(made) > self.room:
            recent.clear()
        recent.update(made)
        if len(hot) > self.room:
            self.hot = {w: v for w, v in found.items() if w in hot}
        found.update(made)
        return found


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the whole text, given in UTF-8, with A-Z lower-cased.

    bytes.split() and bytes.lower() know ASCII only, which is just that pattern and that lower-casing."""
    return text.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that every bit depends on all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes; a shorter, non-empty sequence is one run."""
    if not len(ids):
        return ids
    k = min(k, len(ids))
    out = np.zeros(len(ids) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i]
    return mixed(out)
