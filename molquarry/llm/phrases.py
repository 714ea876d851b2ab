"""Phrase collocations by dynamic itemset counting.

Shards. The documents are dealt into a few shards, written once, and scanned in a cycle: step t reads shard t mod S. All words are
counted in the first cycle. A longer phrase starts to be counted at the step after both its subphrases (without its last
and without its first word) have reached the threshold, even if their own counting still goes on, and it is counted for one
full cycle from there. So lengths are interleaved: a step counts short phrases that are still open and long ones that have
just started. Scanning ends when no phrase is open; a phrase that starts late costs a cycle, not a pass for each length.

Filters. What has reached the threshold is known to the tasks by a bitmap of bounded size (at most 2^filter_bits places), and a
second one says what reached it within the last cycle: a phrase is open if both subphrases are in the first and one is in
the second. A bitmap may let more phrases through, never fewer. That does no harm: a count is kept for each shard once (a mask
of shards in the state), so a phrase that is counted early or twice adds nothing wrong, and one whose subphrases are
not frequent cannot reach the threshold.

State. One table (lang, length, phrase, count, mask of shards, step of reaching) is rewritten at each step with what the step
counted; phrases below the threshold that were not seen for a full cycle leave it. Phrases are compared as bytes, never by hash.

Counting. Texts are split once: a shard's rows are stretches of text of one language as word numbers, with the stretch's own words
and their hashes. Which phrases of a stretch are open is told place by place by the filters; equal ones are combined in the
task (by hash, then compared word by word), and again before and after the shuffle by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from molquarry.llm.common import discard, fresh_path, settled, text_slices, written

#: Ends of pieces become full stops, which are in no word; A-Z is lower-cased.
_PIECES = bytes(0x2E if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text in a stretch, about.
STRETCH = 12_000_000


@dataclass(frozen=True)
class PhraseMining:
    """Phrases of 2 to `longest` words with a count of `least`; `shards` scanned in a cycle; a phrase inside a longer one with `share` % of its count goes; `top` a language."""

    longest: int = 5
    least: int = 100
    shards: int = 3
    share: int = 100
    top: int = 2000
    filter_bits: int = 28


def cut(text: bytes, most: int = STRETCH) -> Iterator[bytes]:
    """A text in stretches of about `most` bytes, cut at ends of pieces only."""
    text, at = text.translate(_PIECES), 0
    while len(text) - at > most:
        to = text.rfind(b".", at, at + most) + 1 or text.find(b".", at + most) + 1 or len(text)
        yield text[at:to]
        at = to
    if at < len(text):
        yield text[at:]


class _Numbers(dict):
    """Words by number in the order of their first occurrence, from 1; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


def encoded(rows: DataFrame, mining: PhraseMining) -> DataFrame:
    """Stretches of rows(lang, text): (lang, shard, ids, words, hashes), words without the end of a piece, by number."""

    def stretch(lang: str, texts: list[bytes], shard: int) -> Iterator[pa.RecordBatch]:
        salt = lang.encode("utf-8", "surrogatepass") + b"\0"
        for i, text in enumerate(cut(b"\n".join(texts))):
            tokens, numbers = text.replace(b".", b" . ").split(), _Numbers({b".": 0})
            ids = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
            words = list(numbers)[1:]
            if words:
                hashes = np.array([0] + [xxhash.xxh3_64_intdigest(salt + w) for w in words], np.uint64)
                yield pa.RecordBatch.from_pydict({"lang": [lang], "shard": pa.array([(shard + i) % mining.shards], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "words": pa.array([b" ".join(words)], pa.binary()), "hashes": pa.array([hashes.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        shard = TaskContext.get().partitionId()
        for part, texts in text_slices(batches, 1, rows=5000, most=STRETCH // 4):
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            full = [lang for lang in held if sizes[lang] >= STRETCH] if sum(sizes.values()) < 4 * STRETCH else list(held)
            for lang in full:
                yield from stretch(lang, held.pop(lang), shard)
                sizes.pop(lang)
                shard += 1
        for lang, own in held.items():
            yield from stretch(lang, own, shard)
            shard += 1

    return rows.mapInArrow(run, "lang string, shard int, ids binary, words binary, hashes binary")


ROW = "lang string, k int, phrase binary, h long, c long"


def _equal(h: np.ndarray, places: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first, count) of each different k-word phrase among those that start at `places`, with hashes h."""
    codes, _ = pd.factorize(h)
    first = np.zeros(codes.max(initial=-1) + 1, np.int64)
    first[codes[::-1]] = places[::-1]
    if all((ids[places + i] == ids[first[codes] + i]).all() for i in range(k)):
        return first, np.bincount(codes, minlength=len(first))
    _, at, c = np.unique(ids[places[:, None] + np.arange(k)], axis=0, return_index=True, return_counts=True)  # two phrases share a hash
    return places[at], c


def counted(shard: DataFrame, seen: tuple[int, np.ndarray, np.ndarray] | None, first: bool, mining: PhraseMining) -> DataFrame:
    """Counts of open phrases in stretches: rows (lang, k, phrase, h, c), several a phrase. In the first cycle (`first`) of all words too, and of all
    word occurrences (k = 0). seen: (bits, bitmap of what reached the threshold, bitmap of what did lately)."""
    shared = None if seen is None else shard.sparkSession.sparkContext.broadcast(seen)  # bounded by filter_bits

    def known(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits, all_, late = shared.value
        at = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
        word, bit = at >> 6, at & 63
        return (all_[word] >> bit & 1).astype(bool), (late[word] >> bit & 1).astype(bool)

    def counts(ids: np.ndarray, names: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(k, phrases, hashes, counts) of one stretch."""
        if first:
            c = np.bincount(ids, minlength=len(names))
            yield 0, np.array([b""], object), np.zeros(1, np.uint64), c[1:].sum(keepdims=True)
            yield 1, names[1:], hashes[1:], c[1:]
        if shared is None:
            return
        ok, late = known(hashes)
        ok[0] = late[0] = False
        ok, late, sums = ok[ids], late[ids], hashes[ids]
        places = np.flatnonzero(ok)  # where an open or finished phrase of k - 1 words starts
        late, sums = late[places], sums[places]
        for k in range(2, mining.longest + 1):
            next_ = np.flatnonzero(places[1:] == places[:-1] + 1)  # where another one starts a word later
            lately = late[next_] | late[next_ + 1]
            at = places[next_]
            sums = sums[next_] * _FACTOR + hashes[ids[at + k - 1]]
            h = sums ^ sums >> np.uint64(29)
            if lately.any():
                start, c = _equal(h[lately], at[lately], ids, k)
                text = names[ids[start]]
                for i in range(1, k):
                    text = text + b" " + names[ids[start + i]]
                yield k, text, _hash(hashes[ids[start[:, None] + np.arange(k)]]), c
            if k < mining.longest:
                ok, late = known(h)
                places, late, sums = at[ok], late[ok], sums[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, ids, words, hashes in zip(*batch.columns, strict=True):
                lang, names = lang.as_py(), np.array([b".", *words.as_py().split(b" ")], object)
                for k, phrases, h, c in counts(np.frombuffer(ids.as_buffer(), np.int32), names, np.frombuffer(hashes.as_buffer(), np.uint64)):
                    for at in range(0, len(c), 50_000):
                        some = slice(at, at + 50_000)
                        n = len(c[some])
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(np.full(n, k, np.int32)), pa.array(list(phrases[some]), pa.binary()), pa.array(h[some].view(np.int64)), pa.array(c[some].astype(np.int64))], names=["lang", "k", "phrase", "h", "c"])

    return shard.mapInArrow(run, ROW)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hash(h: np.ndarray) -> np.ndarray:
    """One hash for each row of word hashes."""
    out = h[:, 0]
    for i in range(1, h.shape[1]):
        out = out * _FACTOR + h[:, i]
    return out ^ out >> np.uint64(29)


def _stepped(state: DataFrame, step: int, mining: PhraseMining) -> tuple[DataFrame, tuple[int, np.ndarray, np.ndarray] | None]:
    """(the state as a table, filters for the step after `step`): the filters are (bits, bitmap of what has reached the threshold, bitmap of what
    did within the last cycle), None if nothing did lately. About 64 places a phrase, 2^filter_bits at most."""
    key = f"reach is not null and k between 1 and {mining.longest - 1}"
    late = F.col("reach") > step - mining.shards
    sizes = Observation()  # counted in the pass that writes
    state = written(state.observe(sizes, F.count_if(F.expr(key)).alias("n"), F.count_if(F.expr(key) & late).alias("late")), "state")
    if not sizes.get["late"]:
        return state, None
    bits = min(mining.filter_bits, max(16, (64 * sizes.get["n"]).bit_length()))
    place = state.where(key).select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("at"), late.alias("late"))
    bit = "shiftleft(1L, cast(at % 64 as int))"
    words = place.groupBy(F.expr("cast(at div 64 as int)").alias("word")).agg(F.expr(f"bit_or({bit})").alias("seen"), F.expr(f"bit_or(if(late, {bit}, 0L))").alias("late"))
    out = np.zeros((2, 1 << (bits - 6)), np.int64)
    for r in words.groupBy(F.expr("word div 4096").alias("part")).agg(*(F.collect_list(c).alias(c) for c in ("word", "seen", "late"))).toLocalIterator():
        out[:, np.array(r["word"])] = r["seen"], r["late"]
    return state, (bits, out[0], out[1])


def _merged(state: DataFrame | None, new: DataFrame, step: int, mining: PhraseMining) -> DataFrame:
    """The state with a step's counts; a shard counts once for each phrase."""
    bit = 1 << step % mining.shards
    rows = new.select("lang", "k", "phrase", "h", F.lit(0).cast("long").alias("c"), F.lit(0).alias("shards"), F.lit(None).cast("int").alias("reach"), F.lit(step).alias("last"), F.col("c").alias("more"))
    if state is not None:
        rows = state.withColumn("more", F.lit(0).cast("long")).unionByName(rows)
    both = rows.groupBy("lang", "k", "phrase").agg(F.max("h").alias("h"), F.sum("c").alias("c"), F.max("shards").alias("shards"), F.max("reach").alias("reach"), F.max("last").alias("last"), F.sum("more").alias("more"))
    again = F.col("shards").bitwiseAND(F.lit(bit)) != 0
    both = both.withColumn("c", F.col("c") + F.when(again, 0).otherwise(F.col("more"))).withColumn("shards", F.when(F.col("more") > 0, F.col("shards").bitwiseOR(F.lit(bit))).otherwise(F.col("shards")))
    both = both.withColumn("reach", F.coalesce("reach", F.when(F.col("c") >= mining.least, step))).drop("more")
    return both.where(f"reach is not null or k = 0 or (last > {step - mining.shards} and shards < {(1 << mining.shards) - 1})")


def frequent_phrases(docs: DataFrame, mining: PhraseMining = PhraseMining()) -> tuple[DataFrame, DataFrame]:
    """(phrases, sizes) of docs(lang, text): (lang, k, phrase, a) of all phrases of 1 to `longest` words that occur `least` times in a language,
    and (lang, n), its word occurrences. Null texts have no words, null languages are `und`. No phrase crosses texts."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "shards")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    encoded(rows, mining).write.partitionBy("shard").parquet(folder)
    state, seen, step = None, None, 0
    while step < mining.shards or seen is not None:
        shard = spark.read.schema("lang string, ids binary, words binary, hashes binary, shard int").parquet(folder).where(F.col("shard") == step % mining.shards).drop("shard")
        before = state
        state, seen = _stepped(_merged(before, counted(shard, seen, step < mining.shards, mining), step, mining), step, mining)
        step += 1
        if before is not None:
            discard(before)
    found = written(state.where(f"k > 0 and c >= {mining.least}").select("lang", "k", F.col("phrase").cast("string").alias("phrase"), F.col("c").alias("a")), "phrases")
    sizes = written(state.where("k = 0").select("lang", F.col("c").alias("n")), "sizes")
    discard(state)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found, sizes


def scored(found: DataFrame, sizes: DataFrame, mining: PhraseMining = PhraseMining()) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates (2 words or more), with the cut of the lowest score."""
    cuts = found.where("k > 1").select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(f))
    both = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    # 38 digits hold 1000 a n up to counts of 10^17; the quotient is a 64-bit number
    both = both.withColumn("score", F.expr("(cast(a as decimal(18, 0)) * cast(n as decimal(18, 0)) * 1000BD) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x"))
    return best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def collocations(docs: DataFrame, mining: PhraseMining = PhraseMining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, count and text.

    Texts are lower-cased (A-Z), split at `.,;:!?` and ends of lines into pieces and those at blanks and tabs into words. Null and empty
    texts have no words; a null lang is `und`, as is a lang of that name. Repeated rows count each time. Ties go to the
    larger count, then to the smaller text by its bytes. Very long texts are counted whole, cut at ends of pieces. Other
    columns than lang and text are not read. An empty table gives no rows. A phrase goes if a longer candidate of its language
    holds it and has `share` % of its count: the one that is one word longer has at least that then, so it alone is asked."""
    return settled(lambda: _collocations(docs, mining), "collocations")


def _collocations(docs: DataFrame, mining: PhraseMining) -> DataFrame:
    found, sizes = frequent_phrases(docs, mining)
    rows = scored(found, sizes, mining)
    inner = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring(phrase, locate(' ', phrase) + 1)"))
    longer = found.where("k > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = rows.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * mining.share)).drop("longer")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mining.top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY 1
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS phrase
  FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), parts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f y ON c.lang = y.lang AND y.phrase = array_to_string(c.w[c.cut+1:], ' ')
  JOIN sizes s ON c.lang = s.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.cut) = 1
), kept AS (
  SELECT * FROM parts p WHERE NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = p.lang AND g.k > p.k AND g.a >= p.a AND contains(' ' || g.phrase || ' ', ' ' || p.phrase || ' '))
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS INT) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""
