"""Exact removal of repeated byte strings by prefix-free parsing.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus.

Parse. A rolling hash of `gram` bytes is looked at in every window of `length` bytes; the position of its smallest value
(the leftmost of equals) is the window's trigger. The stretch of consecutive windows with one trigger is a phrase:
phrases overlap by length - 1 bytes, so every string of `length` bytes lies in just one phrase, at a place that the
string itself decides. Equal strings have equal triggers, whatever surrounds them, and even text without variety
has a trigger in every window. A phrase is 2 * length - gram bytes at most. Long texts are parsed in pieces whose windows do
not overlap; a phrase over a border is two phrases then, which changes no result.

Dictionary and parse. As every window lies in one phrase, two suffixes of the corpus agree in `length` bytes only if the
suffixes of their phrases do: the suffix array of the dictionary (its distinct phrases), with each phrase counted as often as
it stands in the parse, is the corpus order as deep as it is needed. Phrases under different triggers share no window, so
the suffix array falls into parts by trigger:
  a trigger that occurs once   nothing of the phrase repeats;
  one phrase for the trigger   the phrase is in the parse twice or more: all of it repeats;
  several phrases              the suffix array of the trigger's phrases is built by prefix doubling on their bytes; suffixes
                               of equal rank at depth `length` are one string, which repeats if the phrases it lies in
                               stand in the parse twice or more together.
Only phrases of the last kind need their bytes again; they are fetched from one occurrence each.

What is compared. Strings within a trigger are compared by their bytes. Phrases are named by a 128-bit hash of their bytes and
rows by a 128-bit hash of id and text: two of n different ones share a name with a chance of n^2 / 2^129. Two different triggers
with one 64-bit hash would only be looked at together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import MASK64, among, discard, mixed, passes, place_of, places_filter, row_key, settled, sparing, text_slices, unused, written

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Windows of a piece of a long text, and bytes of pieces that are hashed together. Both together stay below 2^PLACE_BITS bytes,
#: so that a window's trigger is the same wherever it is computed.
PIECE, SLICE_BYTES, PLACE_BITS = 1_000_000, 1_500_000, np.uint64(22)
#: Phrases under one trigger up to which one task orders their suffixes; beyond, the suffixes are dealt by a 128-bit hash.
CROWD = 20_000
#: Phrases whose suffixes are ordered together (triggers stay whole).
TOGETHER = 3_000
ROWS = 500
NAME = ["gram", "phrase", "check"]


@dataclass(frozen=True)
class Repeats:
    length: int = 200
    gram: int = 48


def _first_powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base & MASK64, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


@cache
def _steps(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of `base` modulo 2^64, of exponents below 2^11 and of the multiples of 2^11 below 2^PLACE_BITS: all that a worker keeps."""
    half = int(PLACE_BITS) // 2
    return _first_powers(base, 1 << half), _first_powers(pow(base, 1 << half, 1 << 64), 1 << int(PLACE_BITS) - half)


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of `base` modulo 2^64, of exponents below n."""
    low, high = _steps(base)
    return np.multiply.outer(high[: -(-n // len(low))], low).ravel()[:n]


def _rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all substrings of `length` bytes."""
    scattered = mixed(np.arange(1, 257, dtype=np.uint64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(scattered[data] * _powers(BASE, len(data)), out=sums[1:])
    n = len(sums) - length
    return mixed((sums[length:] - sums[:n]) * _powers(INVERSE, n))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _names(data: bytes, begins: list[int], ends: list[int]) -> np.ndarray:
    """128-bit hashes of data[begin:end] as rows of two int64."""
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(begins, ends, strict=True)]), np.int64).reshape(-1, 2)


def _phrases(pieces: list[bytes], spec: Repeats) -> tuple[np.ndarray, ...]:
    """(piece number, first window, number of windows, trigger hash, phrase name) of the phrases of the pieces."""
    lengths = np.array([len(t) for t in pieces], np.int64)
    joined = b"".join(pieces)
    data = np.frombuffer(joined, np.uint8)
    usable = lengths >= spec.length
    if not usable.any():
        return (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)), np.zeros((0, 2), np.int64))
    begins = np.cumsum(lengths) - lengths
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begins[usable]] += 1
    inside[begins[usable] + lengths[usable] - spec.length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    grams = _rolling(data, spec.gram)
    ranked = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    trigger = _sliding_least(ranked, spec.length - spec.gram + 1)[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = windows[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(windows)])
    place = (trigger[new] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    name = _names(joined, first.tolist(), (first + count - 1 + spec.length).tolist())
    piece = np.searchsorted(begins, first, side="right") - 1
    return piece, first - begins[piece], count, grams[place], name


def _pieces(texts: list[bytes], spec: Repeats) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(text numbers, places in the texts, pieces) of about SLICE_BYTES together."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - spec.length + 1), PIECE):
            held.append((i, at, t[at : at + PIECE + spec.length - 1]))
            size += len(held[-1][2])
            if size >= SLICE_BYTES:
                yield np.array([x[0] for x in held]), np.array([x[1] for x in held]), [x[2] for x in held]
                held, size = [], 0
    if held:
        yield np.array([x[0] for x in held]), np.array([x[1] for x in held]), [x[2] for x in held]


def parse(docs: DataFrame, spec: Repeats) -> DataFrame:
    """(gram, phrase, check, row, start, windows, times) of the phrases of docs(row, text), combined where they are read: a phrase
    that a slice of texts has several times is one row with its count, and as all of it is known to repeat, the stretches of
    text under such phrases are told at once, as rows without a name."""
    kinds = {"gram": pa.int64(), "phrase": pa.int64(), "check": pa.int64(), "row": pa.binary(), "start": pa.int32(), "windows": pa.int32(), "times": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 1, ROWS):
            for number, place, group in _pieces(texts, spec):
                piece, first, count, gram, name = _phrases(group, spec)
                text, first = number[piece], first + place[piece]
                order = np.lexsort((name[:, 1], name[:, 0]))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (name[order[1:]] != name[order[:-1]]).any(axis=1)
                same = np.zeros(len(order), np.int64)
                same[order] = np.cumsum(fresh) - 1
                times, at = np.bincount(same), order[fresh]
                again = np.flatnonzero(times[same] > 1)
                own, a, b = text[again], first[again], first[again] + count[again]
                new = np.ones(len(again), bool)
                new[1:] = (own[1:] != own[:-1]) | (a[1:] > b[:-1] + spec.length - 1)
                start = np.flatnonzero(new)
                end = np.r_[start[1:], len(again)][: len(start)] - 1
                none = np.zeros(len(start), np.int64)
                columns = {
                    "gram": np.r_[gram[at].view(np.int64), none], "phrase": np.r_[name[at, 0], none], "check": np.r_[name[at, 1], none],
                    "start": np.r_[first[at], a[start]], "windows": np.r_[count[at], b[end] - a[start]], "times": np.r_[times, none],
                }
                told = np.r_[np.zeros(len(at), bool), np.ones(len(start), bool)]
                rows = part.column(0).take(pa.array(np.r_[text[at], own[start]]))
                yield pa.RecordBatch.from_arrays([rows if c == "row" else pa.array(columns[c].astype(t.to_pandas_dtype()), t, mask=told if c in NAME else None) for c, t in kinds.items()], names=list(kinds))

    return docs.mapInArrow(sparing(run), "gram long, phrase long, check long, row binary, start int, windows int, times int")


def _fetched(docs: DataFrame, reps: DataFrame, spec: Repeats) -> DataFrame:
    """(gram, phrase, check, times, body binary) of the phrases of the written table `reps` (gram, phrase, check, times, row, start,
    windows)."""
    wanted = reps.groupBy("row").agg(F.collect_list(F.struct(*NAME, "times", "start", "windows")).alias("wanted"))
    schema = pa.schema([*((c, pa.int64()) for c in (*NAME, "times")), ("body", pa.binary())])
    # rows that repeat a key have equal texts: a phrase fetched twice is the same phrase

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 0, ROWS):
            out = []
            for raw, wanted in zip(texts, part.column(1).to_pylist(), strict=True):
                out += [(*(w[c] for c in (*NAME, "times")), raw[w["start"] : w["start"] + w["windows"] - 1 + spec.length]) for w in wanted]
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema=schema)

    found = among(docs, "row", places_filter(reps, F.col("row")))[0].join(wanted, "row").select("text", "wanted")
    return found.mapInArrow(sparing(run), "gram long, phrase long, check long, times long, body binary").dropDuplicates(NAME)


def suffix_ranks(data: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """The rank among data[s : s + length] of every start s: equal strings, and they alone, have equal ranks, and ranks are in byte order.

    Prefix doubling: from the order of the first n bytes at all places to that of 2n, as each is a pair of ranks of n."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    depth, n = min(8, length), len(data)
    key = np.zeros(n, np.uint64)
    for i in range(depth):
        key = key << np.uint64(8) | padded[i : i + n].astype(np.uint64)
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while depth < length:
        step = min(depth, length - depth)  # the last pair overlaps
        places = starts if depth + step == length else np.arange(n - step)
        pair = rank[places] << np.uint64(32) | rank[np.minimum(places + step, n - 1)]
        depth += step
        found = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        if depth == length:
            return found
        rank = np.r_[found, np.zeros(step, np.uint64)]  # places without `depth` bytes are in no string that is asked for
    return np.unique(rank[starts], return_inverse=True)[1]


def _windows(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body number, offset in the body, offset in the joined bodies) of the suffixes of at least `length` bytes."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    counts = sizes - length + 1
    body = np.repeat(np.arange(len(bodies)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return body, offset, (np.cumsum(sizes) - sizes)[body] + offset


def _runs(body: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, first, last) of the runs of consecutive offsets of sorted (body, offset)."""
    new = np.ones(len(body), bool)
    new[1:] = (body[1:] != body[:-1]) | (offset[1:] != offset[:-1] + 1)
    at = np.flatnonzero(new)
    return body[at], offset[at], offset[np.r_[at[1:], len(body)] - 1] if len(at) else offset[:0]


RUNS = "gram long, phrase long, check long, first int, last int"


def _ordered(dictionary: DataFrame, spec: Repeats) -> DataFrame:
    """RUNS: the runs of repeated suffixes of the phrases (gram, phrase, check, times, body), whose triggers have CROWD phrases at
    most. Partitions are sorted by trigger; a task holds a batch and the phrases of one trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks()
            grams = table.column(0).to_numpy()
            if not len(grams):
                continue
            cut = int(np.flatnonzero(grams != grams[-1])[-1]) + 1 if (grams != grams[-1]).any() else 0
            if cut:
                yield from whole(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()[0]
        if held is not None:
            yield from whole(pa.Table.from_batches([held]))

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        grams, times = table.column(0).to_numpy(), table.column(3).to_numpy()
        ends = np.r_[np.flatnonzero(grams[1:] != grams[:-1]) + 1, len(grams)]
        begin = 0
        while begin < len(grams):  # whole triggers
            end = int(ends[min(np.searchsorted(ends, begin + TOGETHER), len(ends) - 1)])
            part = table.slice(begin, end - begin)
            bodies = part.column(4).to_pylist()
            body, offset, place = _windows(bodies, spec.length)
            rank = suffix_ranks(b"".join(bodies), place, spec.length)
            repeated = np.bincount(rank.astype(np.int64), weights=times[begin:end][body])[rank.astype(np.int64)] >= 2
            b, first, last = _runs(body[repeated], offset[repeated])
            yield pa.RecordBatch.from_arrays([*(pa.array(part.column(i).to_numpy()[b]) for i in range(3)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=[*NAME, "first", "last"])
            begin = end

    return dictionary.repartition("gram").sortWithinPartitions("gram").mapInArrow(sparing(run), RUNS)


def _dealt(dictionary: DataFrame, spec: Repeats) -> DataFrame:
    """The same for triggers with more phrases, which no task could hold: each suffix is a row, and equal ones meet by the 128-bit
    hash of their first `length` bytes, with counts summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                bodies = part.column(4).to_pylist()
                body, offset, place = _windows(bodies, spec.length)
                name = _names(b"".join(bodies), place.tolist(), (place + spec.length).tolist())
                own = [pa.array(part.column(i).to_numpy()[body]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(name[:, 0]), pa.array(name[:, 1]), *own, pa.array(offset.astype(np.int32))], names=["s0", "s1", *NAME, "times", "first"])

    rows = dictionary.mapInArrow(sparing(run), "s0 long, s1 long, gram long, phrase long, check long, times long, first int")
    repeated = rows.groupBy("s0", "s1").agg(F.sum("times").alias("n")).where("n >= 2").select("s0", "s1")
    return rows.join(repeated, ["s0", "s1"], "left_semi").select(*NAME, "first", F.col("first").alias("last"))


def repeated_spans(docs: DataFrame, spec: Repeats = Repeats()) -> DataFrame:
    """(row, spans array<struct<a, b>>): per key of docs(row, text) the byte ranges [a, b) to remove, sorted, still overlapping; a
    written table. The tables it was made by are deleted."""
    phrases = written(parse(docs, spec), "parse")
    sides = [f(c).alias(f"{f.__name__}_{c}") for c in ("phrase", "check") for f in (F.min, F.max)]
    triggers = phrases.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("n"), *sides).where("n >= 2")
    triggers = triggers.select("gram", F.expr("min_phrase = max_phrase and min_check = max_check").alias("alone"))
    known = written(phrases.join(triggers, "gram"), "repeated")
    several = known.where("not alone")
    reps = several.groupBy(*NAME).agg(F.sum("times").cast("long").alias("times"), F.min(F.struct("row", "start", "windows")).alias("at"))
    reps = written(reps.select(*NAME, "times", "at.*"), "dictionary")
    crowds = reps.groupBy("gram").agg(F.count("*").alias("n")).where(f"n > {CROWD}").select("gram")
    dictionary = written(_fetched(docs, reps, spec), "bodies")
    runs = _ordered(dictionary.join(crowds, "gram", "left_anti"), spec).union(_dealt(dictionary.join(crowds, "gram", "left_semi"), spec))
    told = phrases.where("gram is null").select("row", "start", "windows")
    spans = known.where("alone").select("row", "start", "windows").union(told).select("row", F.col("start").alias("a"), (F.col("start") + F.col("windows") - 1 + spec.length).alias("b"))
    inner = several.join(runs, NAME).select("row", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + spec.length).alias("b"))
    found = written(spans.union(inner).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans")
    for done in (phrases, known, reps, dictionary):
        discard(done)
    return found


def _merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return out


def _kept(raw: bytes, runs: list[list[int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeat_digests(docs: DataFrame, spec: Repeats = Repeats()) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes that stay.

    Null texts are empty. Rows that repeat id and text are each other's repeats, as are overlapping places in one text; rows
    with null ids count as all others. Other columns are not read. An empty table gives no rows."""
    return settled(lambda: _digests(docs, spec), "digests")


def _digests(docs: DataFrame, spec: Repeats) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(rows.select(row_key().alias("row"), "text"), spec)
    bits, bitmap = places_filter(spans, F.col("row"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2^bits places, bounded

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # texts without spans are not shuffled
        for part, texts in text_slices(batches, 3, ROWS):
            likely = passes(part.column(2).to_numpy(), shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t if x else None for t, x in zip(texts, likely, strict=True)], pa.binary())], names=["doc_id", "row", "n_bytes", "whole", "raw"])

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 3, ROWS):
            columns = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "n_bytes", "whole", "spans"))
            out = []
            for raw, doc_id, n, whole, spans in zip(texts, *columns, strict=True):
                runs = _merged(spans)
                kept = hashlib.sha256(_kept(raw, runs)).hexdigest() if runs else whole
                out.append((doc_id, n, sum(b - a for a, b in runs), len(runs), kept))
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema=schema)

    keyed = rows.select("doc_id", row_key().alias("row"), "text")
    looked_at = keyed.select("doc_id", "row", place_of(F.col("row"), bits).alias("place"), "text").mapInArrow(sparing(looked), "doc_id long, row binary, n_bytes long, whole string, raw binary")
    joined = looked_at.join(spans, "row", "left").select("doc_id", "n_bytes", "whole", "raw", "spans")
    return joined.mapInArrow(sparing(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeats_removed(docs: DataFrame, spec: Repeats = Repeats()) -> DataFrame:
    """`docs` with the repeated bytes cut out of text and n_chars counted anew; other columns stay. A character that loses
    some of its bytes goes; rows whose text goes wholly stay with an empty text, a null text stays null. All places of a
    repeated string go, the first one too. Rows are told apart by doc_id and text. An empty table gives no rows."""
    spans = repeated_spans(docs.select(row_key().alias("row"), "text"), spec)
    schema, names = docs.schema, docs.columns
    row, told = unused(docs, "row"), unused(docs, "spans")
    touched, whole = among(docs.withColumn(row, row_key()), row, places_filter(spans, F.col("row")))  # texts without spans stay where they are
    joined = touched.join(spans.select(F.col("row").alias(row), F.col("spans").alias(told)), row, "left").drop(row)
    whole = whole.drop(row)
    if "n_chars" in names:
        whole = whole.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raws in text_slices(batches, text_at, ROWS):
            columns, null = list(part.columns[:-1]), part.column(text_at).is_null().to_pylist()
            texts = [
                None if gone else (_kept(raw, _merged(s)) if s else raw).decode("utf-8", "ignore")
                for raw, gone, s in zip(raws, null, part.column(len(columns)).to_pylist(), strict=True)
            ]
            columns[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(sparing(cut), schema).union(whole.select(*names))
