"""Language identification by mixture inference over n-gram likelihoods.

Learning. For each language, the counts of hashed byte trigrams of the lower-cased texts of a sample of at most about
`per_language` of its labelled documents, chosen by a hash of the row; a language with fewer is learnt from all of them.
Probabilities are smoothed counts.

Inference. A document is a bag of trigrams drawn from a mixture of languages. Expectation-maximisation estimates the
proportions over all languages. Then sets of languages are compared, the largest proportion first: another language
joins the set while it raises the mixture's log-likelihood by more than `penalty` * ln(trigrams). The set's proportions
are those of expectation-maximisation within it; the prediction is the language with the largest one, its score its
proportion over all languages. Many documents are worked on together, as one matrix of distinct trigrams by languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import crc32_of_id, mixed, written

LETTER = regex.compile(r"\p{L}")
ROWS = 250
#: Tasks that count the sample; languages up to which their sizes are sent to all tasks.
PARTS, SENT = 16, 100_000


@dataclass(frozen=True)
class Mixture:
    """2^bits places for trigrams; limits of the sample and of the rounds; the price of a language."""

    bits: int = 14
    per_language: int = 4_000
    smoothing: float = 0.5
    rounds: int = 20
    penalty: float = 4.0
    settled: float = 1e-3


def trigrams(text: str | None, bits: int) -> np.ndarray:
    """Places of all byte trigrams of the lower-cased text between spaces; a text without letters has none."""
    if not text or not LETTER.search(text):
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    codes = (b[:-2] | b[1:-1] << 8 | b[2:] << 16).astype(np.uint64)
    return (mixed(codes) >> np.uint64(64 - bits)).astype(np.int64)


def learn(docs: DataFrame, usable: Column, spec: Mixture = Mixture()) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities [2^bits, languages]) from rows of docs(doc_id, text, lang) with a language, letters and
    `usable`. Without such rows there are no languages."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.least(F.lit(1 << 30), F.lit(spec.per_language * (1 << 30)) / F.col("n")).alias("share"))
    sizes = written(sizes, "languages")
    chosen = rows.join(F.broadcast(sizes) if sizes.count() <= SENT else sizes, "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share"))
    sample = chosen.select("doc_id", "text", "lang").distinct().repartition(PARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for lang, text in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = total.setdefault(lang, np.zeros(1 << spec.bits))
                    own += np.bincount(trigrams(text, spec.bits), minlength=1 << spec.bits)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(total.keys(), pa.string()), "counts": pa.array([c.tobytes() for c in total.values()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c) for c in pdf["counts"]], axis=0)
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "counts": [total.tobytes()]})

    parts = sample.mapInArrow(count, "lang string, counts binary")  # PARTS arrays of fixed size a language at most
    found = {r["lang"]: np.frombuffer(r["counts"]) for r in parts.groupBy("lang").applyInPandas(add, "lang string, counts binary").collect()}  # one a language
    langs = sorted(k for k, c in found.items() if c.any())
    if not langs:
        return [], np.zeros((1 << spec.bits, 0))
    p = np.stack([found[k] for k in langs], axis=1) + spec.smoothing
    return langs, p / p.sum(axis=0)


class Bags:
    """Distinct trigrams of some documents: rows of a matrix, those of a document side by side."""

    def __init__(self, places: list[np.ndarray], p: np.ndarray):
        found = [np.bincount(x, minlength=len(p)) for x in places]
        nonzero = [np.flatnonzero(f) for f in found]
        self.sizes = np.array([len(z) for z in nonzero])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(places)), self.sizes)
        self.count = np.concatenate([f[z] for f, z in zip(found, nonzero, strict=True)]).astype(np.float64)
        self.p = p[np.concatenate(nonzero)]
        self.total = np.add.reduceat(self.count, self.starts)

    def of(self, docs: np.ndarray) -> Bags:
        """The bags of some of the documents."""
        out = object.__new__(Bags)
        rows = np.isin(self.doc, docs)
        out.sizes = self.sizes[docs]
        out.starts = np.cumsum(out.sizes) - out.sizes
        out.doc = np.repeat(np.arange(len(docs)), out.sizes)
        out.count, out.p, out.total = self.count[rows], self.p[rows], self.total[docs]
        return out

    def log_likelihood(self, share: np.ndarray) -> np.ndarray:
        mix = np.einsum("gl,gl->g", self.p, share[self.doc])
        return np.add.reduceat(self.count * np.log(mix), self.starts)

    def proportions(self, share: np.ndarray, spec: Mixture) -> np.ndarray:
        """Expectation-maximisation from `share` [documents, languages]; languages of share 0 stay out."""
        for _ in range(spec.rounds):
            part = self.p * share[self.doc]
            part *= (self.count / part.sum(axis=1))[:, None]
            new = np.add.reduceat(part, self.starts, axis=0) / self.total[:, None]
            change = np.abs(new - share).max()
            share = new
            if change < spec.settled:
                break
        return share


def mixtures(bags: Bags, spec: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """(proportions over all languages, proportions of the chosen sets) of every document."""
    n, languages = len(bags.total), bags.p.shape[1]
    everything = bags.proportions(np.full((n, languages), 1 / languages), spec)
    order = np.argsort(-everything, axis=1, kind="stable")
    chosen = np.zeros((n, languages))
    chosen[np.arange(n), order[:, 0]] = 1.0
    best, price = bags.log_likelihood(chosen), spec.penalty * np.log(np.maximum(bags.total, 2))
    open_ = np.flatnonzero(bags.log_likelihood(everything) - best > price)  # no set can do better than all languages
    for k in range(2, languages + 1):
        if not len(open_):
            break
        some = bags.of(open_)
        share = np.zeros((len(open_), languages))
        rows = np.arange(len(open_))[:, None]
        share[rows, order[open_, :k]] = np.maximum(everything[open_[:, None], order[open_, :k]], 1e-3)
        share = some.proportions(share / share.sum(axis=1, keepdims=True), spec)
        gained = some.log_likelihood(share)
        better = gained - best[open_] > price[open_]
        open_ = open_[better]
        chosen[open_], best[open_] = share[better], gained[better]
    return everything, chosen


def identified(docs: DataFrame, langs: list[str], p: np.ndarray, spec: Mixture = Mixture()) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, lang_pred, score, langs array<string> and shares array<double> of the chosen set.

    Texts that are null or have no letter are `und` with score 0 and an empty set, as are all if no language is known.
    Rows are judged one by one. Other columns are not read. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(p)  # 2^bits numbers a language
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                places = [trigrams(t, spec.bits) for t in part.column(1).to_pylist()]
                n = len(places)
                pred, score, sets, shares = ["und"] * n, np.zeros(n), [[] for _ in range(n)], [[] for _ in range(n)]
                known = [i for i, x in enumerate(places) if len(x) and langs]
                if known:
                    everything, chosen = mixtures(Bags([places[i] for i in known], shared.value), spec)
                    for i, whole, own in zip(known, everything, chosen, strict=True):
                        top = int(own.argmax())
                        inside = np.flatnonzero(own)
                        pred[i], score[i] = langs[top], min(1.0, float(whole[top]))
                        sets[i], shares[i] = [langs[j] for j in inside], own[inside].tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred), pa.array(score), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "langs", "shares"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def language_digests(docs: DataFrame, spec: Mixture = Mixture()) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, langs, shares; learnt from rows whose crc32(doc_id as text) mod 4 is not 2.

    Rows without a language or text teach nothing; a null id counts as the empty text in the crc32. Repeated rows are learnt once
    and judged each. Texts that are null or have no letter are `und`. An empty table gives no rows."""
    langs, p = learn(docs, crc32_of_id(F.col("doc_id")) % 4 != 2, spec)
    return identified(docs, langs, p, spec).withColumn("held_out", crc32_of_id(F.col("doc_id")) % 4 == 2)
