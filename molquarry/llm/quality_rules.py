"""Quality rules: counts of a text's words, lines and repeats, and its divergence from its language's usual histograms.

References. For every language: the mean over its documents of the histogram of character classes, and that of its most
frequent words (by documents' counts over the whole corpus) with one more bin for all other words. Documents with
fewer than `min_words` words do not count towards a reference.

Verdict. A document of at least `min_words` words is compared with the reference of its language, or, where it has none,
with the nearest reference, by Jensen-Shannon distance (the root of the divergence in bits, 0 to 1). It fails if
the distance of its characters is over `max_chars` or that of its words over `max_words`. Shorter documents are not
judged: their histograms say too little.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = 500
#: Distinct words that a task counts before it hands the counts on.
COUNTED = 300_000
SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: Classes of characters, told by their bytes: of a character outside ASCII the lead byte is of one class, the others of another.
CLASSES = 12


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the verdict."""

    least_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    common: int = 60
    min_words: int = 20
    max_chars: float = 0.30
    max_words: float = 0.55


def _class_table() -> np.ndarray:
    table = np.full(256, 11, np.int64)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[[32]], table[[10, 13]], table[[9, 11, 12]] = 3, 4, 5
    table[[ord(c) for c in ".,;:'\"-()?!"]] = 6
    table[ord("!")] = 7
    table[[ord(c) for c in "#*$%&|<>"]] = 8
    table[0x80:0xC0], table[0xC0:] = 9, 10
    return table


TABLE = _class_table()


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def counts(raw: bytes, rules: Rules) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text in UTF-8."""
    words = raw.split()  # splits at ASCII white space: \x20 and \x09-\x0D
    n = len(words)
    chars = sum(len(w.decode("utf-8", "replace")) for w in words) if not raw.isascii() else sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    k, repeats = rules.window, 0
    if n >= k:
        windows = list(zip(*(words[i:] for i in range(k)), strict=False))
        if len(set(windows)) < len(windows):
            found = Counter(windows)
            covered = np.zeros(n, bool)
            at = np.fromiter((i for i, w in enumerate(windows) if found[w] > 1), np.int64)
            for d in range(k):
                covered[at + d] = True
            repeats = int(covered.sum())
    return n, chars, len(SYMBOLS.findall(raw)), len(lines) - len(set(lines)), repeats


def _histogram(raw: bytes) -> np.ndarray:
    h = np.bincount(TABLE[np.frombuffer(raw, np.uint8)], minlength=CLASSES).astype(np.float64)
    return h / max(1.0, h.sum())


def _word_histogram(words: list[bytes], bins: dict[bytes, int], size: int) -> np.ndarray:
    h = np.zeros(size + 1)
    for w, c in Counter(words).items():
        h[bins.get(w, size)] += c
    return h / max(1, len(words))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance in bits."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def _lower(raw: bytes) -> list[bytes]:
    return [w.strip(b".,;:!?\"'()") for w in raw.lower().split()]


def common_words(docs: DataFrame, rules: Rules) -> dict[str, list[bytes]]:
    """The `common` most frequent words of each language over all of docs(lang, text); ties go to the smaller word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, c) for lang, own in found.items() for w, c in own.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["lang", "word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found.setdefault(lang, Counter()).update(_lower(_raw(text)))
                if sum(map(len, found.values())) > COUNTED:
                    # words met once here are most of the table and never common: they are handed on like all others
                    yield flush()
        yield flush()

    words = docs.where("lang is not null").select("lang", "text").mapInArrow(count, "lang string, word binary, n long").where("length(word) > 0").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # the best of each of 64 parts of a language's words, then the best of those
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(F.desc("n"), "word")
    best = words.withColumn("r", F.row_number().over(parts)).where(F.col("r") <= rules.common).drop("r")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= rules.common)
    out: dict[str, list[bytes]] = {}
    for r in best.orderBy("lang", "r").collect():  # `common` rows a language
        out.setdefault(r["lang"], []).append(bytes(r["word"]))
    return out


def references(docs: DataFrame, rules: Rules) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """Per language (character histogram, places of its common words, word histogram): means over all its documents."""
    chosen = {lang: {w: i for i, w in enumerate(words)} for lang, words in common_words(docs, rules).items()}
    width = CLASSES + rules.common + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = _raw(text)
                    words = _lower(raw)
                    if len(words) >= rules.min_words and lang in chosen:
                        own = sums.setdefault(lang, np.zeros(width + 1))
                        own[:CLASSES] += _histogram(raw)
                        own[CLASSES:width] += _word_histogram(words, chosen[lang], rules.common)
                        own[width] += 1
        rows = [(lang, i, float(v)) for lang, own in sums.items() for i, v in enumerate(own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64()))], names=["lang", "place", "v"])

    total = docs.where("lang is not null").select("lang", "text").mapInArrow(add, "lang string, place int, v double").groupBy("lang", "place").agg(F.sum("v").alias("v"))
    sums: dict[str, np.ndarray] = {}
    for r in total.collect():  # CLASSES + common + 2 rows a language
        sums.setdefault(r["lang"], np.zeros(width + 1))[r["place"]] = r["v"]
    return {lang: (s[:CLASSES] / s[width], chosen[lang], s[CLASSES:width] / s[width]) for lang, s in sums.items()}


def judged(docs: DataFrame, known: dict, rules: Rules = Rules()) -> DataFrame:
    """Per row of docs(doc_id, lang, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, char_distance and word_distance (null where the text is too short to be judged or no reference is known).

    Null texts have no words and fail the base rules. Rows are judged one by one, repeated ones alike. Other columns
    are not read. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # a few hundred numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = []
                for doc_id, lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = _raw(text)
                    found = counts(raw, rules)
                    failed = found[0] < rules.least_words or 100 * found[4] > rules.repeat_percent * found[0]
                    chars = words = None
                    if found[0] >= rules.min_words and refs:
                        h, split = _histogram(raw), _lower(raw)
                        near = [(distance(h, c), distance(_word_histogram(split, bins, rules.common), w)) for c, bins, w in ([refs[lang]] if lang in refs else refs.values())]
                        chars, words = min(near, key=sum)
                    good = chars is None or (chars <= rules.max_chars and words <= rules.max_words)
                    out.append((doc_id, *found, failed, not failed and good, chars, words))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def quality_digests(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rules with references from `docs` (doc_id, lang, text) itself; rows as judged() gives them.

    Null texts have no words and fail. Rows without a language teach nothing and are held against the nearest reference. Repeated
    rows count each in the references and are judged alike; of equally frequent words the smaller is common. Very long
    texts count whole. Other columns are not read. An empty table gives no rows."""
    return judged(docs, references(docs, rules), rules)
