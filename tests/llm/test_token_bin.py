import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from molquarry.llm.token_bin import read_token_files, same_as_whole, token_digests, tokenizer_path, write_token_files

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", "  \t\n ", "it's <|endoftext|> x<|endoftext|>y", " non breaking é ΑΣ ΟΔΟΣ\x1c2024", "word " * 3000, "日本語テキスト 123", "A\x00b"]


def brute(rows):
    """(start, n, crc) of each text in the given order, from one pass of whole texts."""
    tok, at, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_words_give_the_ids_of_whole_texts():
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() if t]
    assert same_as_whole(tokenizer_path(), texts + [t for t in ODD if t])


def test_files_match_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist())
    got = token_digests(spark, spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_odd_rows(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(ODD)] + [(3, "repeat", None, 1), (None, "no id", "x", 2), (None, None, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, ids_crc32 int")
    got = sorted(map(tuple, token_digests(spark, docs).collect()), key=lambda r: r[1])
    ordered = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert got == brute(ordered)


def test_empty_table(spark):
    assert token_digests(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("parts", [1, 3])
def test_parts_and_bases(spark, tmp_path, parts):
    docs = spark.createDataFrame([(i, "one two three") for i in range(50)], "doc_id long, text string")
    manifest = write_token_files(docs, f"file://{tmp_path}/t", tokenizer_path(), parts=parts)
    rows = manifest.orderBy("part").collect()
    assert [r["base"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    data = np.memmap(tmp_path / "t" / "part-000000.bin", "<u2", "r")
    assert len(data) == rows[0]["n_tokens"]
    assert read_token_files(manifest).count() == 50
