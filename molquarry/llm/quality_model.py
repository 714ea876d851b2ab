"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text's words are runs of letters and digits or runs of other visible characters, so that decoration glued to
words is a word of its own. Features are, hashed into 2^bits places: the lower-cased words, pairs of
neighbouring words, triples of neighbouring word shapes (capitals, capitalised, lower case, digits, other), and
one place that counts the pairs which the text has had before.
The feature vector is the sparse vector of counts scaled to length 1; a score is the logistic function of its dot
product with the weights and a bias.

Training reads at most about `max_train` labelled documents, chosen by a hash of their id. They are dealt over groups
of about `group` documents; each group runs FTRL-proximal (per-coordinate rates, L1 and L2) over its documents a few
times, and the weights of the groups are averaged. Few documents are one group, as averaging models that have seen
little draws all scores to the middle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from molquarry.llm.common import MASK64, crc32_of_id, discard, give_back, mixed, read_table, sparing, text_slices, written

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
#: Distinct words whose hashes a task keeps.
CACHE = 150_000


@dataclass(frozen=True)
class Ftrl:
    """Settings of the learner; bits sets the number of weights, the other names are those of the algorithm."""

    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1
    epochs: int = 3
    group: int = 2_000
    max_train: int = 16_000


class Features:
    """Text to (places, values) of its sparse unit vector."""

    def __init__(self, bits: int):
        self.shift, self.known = np.uint64(64 - bits), {}

    def word(self, token: bytes) -> int:
        if len(self.known) >= CACHE:
            self.known.clear()
        if token.isdigit():
            shape = 1
        elif token.isalnum():
            shape = 2 if token.isupper() and len(token) > 1 else 3 if token[:1].isupper() else 4
        else:
            shape = 5 if token[0] < 128 else 6
        value = self.known[token] = xxhash.xxh3_64_intdigest(token.lower()) & ~7 | shape
        return value

    def __call__(self, text: str | bytes | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = TOKEN.findall(text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace"))
        get, word = self.known.get, self.word
        ids = np.fromiter((get(t) or word(t) for t in tokens), np.uint64, len(tokens))
        words, shapes = ids >> np.uint64(3), ids & np.uint64(7)
        pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
        triples = (shapes[:-2] * np.uint64(64) + shapes[1:-1] * np.uint64(8) + shapes[2:]) + np.uint64(1 << 62)
        again = np.full(len(pairs) - len(np.unique(pairs)), 3 << 62 & MASK64, np.uint64)
        places, counts = np.unique(mixed(np.concatenate([words, pairs, triples, again])) >> self.shift, return_counts=True)
        values = counts / np.sqrt((counts.astype(np.float64) ** 2).sum()) if len(counts) else counts.astype(np.float64)
        return places.astype(np.int64), values


def _ftrl(texts: list[str | None], labels: list[int], settings: Ftrl) -> np.ndarray:
    """Weights, with the bias last, after `epochs` passes over the documents in the given order."""
    n_weights = (1 << settings.bits) + 1
    z, n = np.zeros(n_weights), np.zeros(n_weights)
    features = Features(settings.bits)
    rows = [(np.append(p, n_weights - 1), np.append(v, 1.0), y) for (p, v), y in zip(map(features, texts), labels, strict=True)]

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= settings.l1, 0.0, (np.sign(z) * settings.l1 - z) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2))

    for _ in range(settings.epochs):
        for places, values, label in rows:
            zi, ni = z[places], n[places]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            z[places] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / settings.alpha * w
            n[places] = ni + g * g
    return weights(z, n).astype(np.float32)


def train_quality_model(labelled: DataFrame, settings: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> np.ndarray:
    """Weights (the bias last) from rows of id, text and 0/1 label.

    Rows with a null id or label are not used; of rows that repeat an id the smallest text is used. If only one
    label occurs the model always answers it; without rows it scores 0.5."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where("id is not null and label is not null").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    table = written(rows.withColumn("order", F.xxhash64("id")), "labelled")
    groups = max(1, -(-table.count() // settings.group))
    rows = table.withColumn("shard", F.pmod("order", F.lit(groups)))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order")
        weights = _ftrl(pdf["text"].tolist(), pdf["label"].tolist(), settings)
        give_back()
        return pd.DataFrame({"weights": [weights.tobytes()]})

    parts = rows.groupBy("shard").applyInPandas(shard, "weights binary").collect()  # one row of fixed size a group
    discard(table)
    if not parts:
        return np.zeros((1 << settings.bits) + 1, np.float32)
    return np.mean([np.frombuffer(r["weights"], np.float32) for r in parts], axis=0, dtype=np.float64).astype(np.float32)


def quality_scores(docs: DataFrame, weights: np.ndarray, settings: Ftrl = Ftrl(), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score (0 to 1, double) of every whole text; null and empty texts get the bias alone.

    `score_col` must be a new name; any other columns are kept as they are."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits + 1 floats
    place = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(settings.bits), model.value.astype(np.float64)
        for part, texts in text_slices(batches, place):
            dots = [w[p] @ v + w[-1] for p, v in map(features, texts)]
            scores = 1 / (1 + np.exp(-np.clip(np.array(dots, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, score_col])

    return docs.mapInArrow(sparing(score), StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable, max_train: int) -> DataFrame:
    """(doc_id, text, label) of about max_train documents at most that have one undisputed quality label and for whose
    id `usable` holds. The chosen ids are bounded by max_train, so they are broadcast to the documents."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
    share = min(1.0, max_train / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "label")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def learned_model(spark: SparkSession, sf_dir: str, settings: Ftrl = Ftrl()) -> np.ndarray:
    """The model of labels.quality over documents, from rows whose crc32(doc_id as text) mod 3 is not 1."""
    usable = crc32_of_id(F.col("doc_id")) % 3 != 1
    sample = labelled_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), usable, settings.max_train)
    return train_quality_model(sample, settings)


def quality_digests(spark: SparkSession, sf_dir: str, settings: Ftrl = Ftrl()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from a score of just 0.5 on).

    Null and empty texts get the bias alone; a null id counts as the empty text in the crc32 and has no label. Repeated rows are
    scored each; of labels that disagree none is used. Very long texts are read whole. Other columns are not read. An
    empty table gives no rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, learned_model(spark, sf_dir, settings), settings)
    held_out = crc32_of_id(F.col("doc_id")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
