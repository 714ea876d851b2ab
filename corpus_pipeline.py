"""A pipeline from raw documents to token ids: five stages, each a Spark job over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared folder and
reads it again for the next, so that a lost executor costs a stage's unfinished tasks at most. All but the last return
the columns of documents; columns that documents have besides stay too, whatever their names. Empty tables pass through.
Rows with null ids or texts, very long texts, ties and repeated rows are judged as each stage says. The tables that a stage
wrote on its way are deleted once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.llm.common import discard, read_table, settled, unused
from molquarry.llm.decontaminate import decontaminated
from molquarry.llm.jaccard_join import JaccardJoin, near_duplicates_removed
from molquarry.llm.prefix_free import repeats_removed
from molquarry.llm.quality_model import learned_model, quality_scores
from molquarry.llm.sentencepiece_trie import encode_pieces

#: Near-duplicates share four fifths of their five-word shingles or more.
NEAR = JaccardJoin(k=5, num=80)


#: Rows of whole texts that go to a Python worker at once: a batch is held by Spark and by the worker, coming and going.
BATCH_ROWS = 500


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score is 0.5 or more. Null and empty texts get the model's bias alone; rows are scored one by
    one, so repeated ones share their fate, and a score of just 0.5 stays. Very long texts are read whole."""
    _small_batches(spark)
    score = unused(docs, "quality_score")
    return quality_scores(docs, learned_model(spark, sf_dir), score_col=score).where(F.col(score) >= 0.5).drop(score)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more; groups are
    what links reach. Null and empty texts link with nothing and stay. Rows that repeat id and text stay once; of a group without
    an id one row stays. Rows are told apart by id and text, so repeated and null ids are no groups. Very long texts are compared
    whole."""
    _small_batches(spark)
    return near_duplicates_removed(docs, NEAR)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out bytes under 200-byte strings that occur again, at all their places; all documents stay, with an empty text if all of it
    goes. Null texts stay null. Texts of repeated rows are each other's repeats. Very long texts are parsed in pieces."""
    _small_batches(spark)
    return repeats_removed(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found, that is 80 % or more of its words, in any order of its parts. Null, empty
    and wordless texts or items are never found; repeated rows share their fate. Very long texts are searched whole."""
    _small_batches(spark)
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip of every document. Null and empty texts have no pieces; null ids stay null, repeated rows
    have a row each. Very long texts are encoded whole."""
    _small_batches(spark)
    return encode_pieces(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if name != STAGES[0][0]:
            discard(before)
    return docs


#: A learnt model and a tokenizer's file decide on the rows; the tests hold each stage against brute force instead.
ORACLE_SQL = None
