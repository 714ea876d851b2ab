"""The queries of the text operators: (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from molquarry.llm import chat, cross_polytope, phrases, quality_rules, vector_codes, warc_zip
from molquarry.llm.common import read_table
from molquarry.llm.decontaminate import contaminated
from molquarry.llm.jaccard_join import jaccard_components
from molquarry.llm.langid import language_digests
from molquarry.llm.prefix_free import repeat_digests
from molquarry.llm.quality_model import quality_digests
from molquarry.llm.sentencepiece_trie import encode_pieces
from molquarry.llm.token_bin import token_digests


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to ZIP packages of WARC records and read back; nulls and repeated rows as warc_zip.page_digests says."""
    return warc_zip.page_digests(spark, read_table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates of all documents; nulls, empty texts and repeated ids as jaccard_components says."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op3_sentencepiece_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document; null and empty texts have none, see encode_pieces."""
    return encode_pieces(read_table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; null and letterless texts are `und`, see language_digests."""
    return language_digests(read_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items found in them; null and wordless texts have none, see contaminated."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side; null roles, texts, turns and ids as chat.perspectives says."""
    return chat.perspective_digests(read_table(spark, sf_dir, "conversations"))


def op7_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 200-byte strings leave of every document; null texts are empty, see repeat_digests."""
    return repeat_digests(read_table(spark, sf_dir, "documents"))


def op8_token_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in the token files; null texts are empty, null ids come first, see token_digests."""
    return token_digests(spark, read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null texts have no words, see quality_digests of the rules."""
    return quality_rules.quality_digests(read_table(spark, sf_dir, "documents"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; null texts get the bias alone, see quality_digests of the model."""
    return quality_digests(spark, sf_dir)


def op11_dynamic_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases of highest score; null texts and languages, ties and repeated rows as phrases.collocations says."""
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector; nulls, zeros, ties and repeated rows as cross_polytope.neighbours says."""
    return cross_polytope.neighbours(read_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op13_slice_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors; nulls and rows that cannot be coded as vector_codes.code_digests says."""
    return vector_codes.code_digests(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_warc_zip": op1_warc_zip,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_sentencepiece_trie": op3_sentencepiece_trie,
    "op4_langid": op4_langid,
    "op5_decontaminate": op5_decontaminate,
    "op6_chat": op6_chat,
    "op7_prefix_free": op7_prefix_free,
    "op8_token_bin": op8_token_bin,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_model": op10_quality_model,
    "op11_dynamic_itemsets": op11_dynamic_itemsets,
    "op12_cross_polytope": op12_cross_polytope,
    "op13_slice_codes": op13_slice_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_zip": warc_zip.SQL,
    "op6_chat": chat.SQL,
    "op11_dynamic_itemsets": phrases.SQL,
    "op13_slice_codes": vector_codes.SQL,
    "op2_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared WHERE 100 * c >= 85 * (n + m - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(r.y) FROM reach r WHERE r.x = s.doc_id) AS component_id
FROM sets s
""",
}
