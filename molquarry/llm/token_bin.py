"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets.

A data set is a folder of numbered parts and a manifest. Part i holds
  part-i.bin   the ids of its documents one after another, little-endian, 2 bytes each while the vocabulary
               allows it, else 4;
  part-i.idx   n + 1 little-endian int64: where each document starts, counted in ids from the part's start,
               and the part's end;
  part-i.docs  n little-endian int64 document ids, and after them n bytes: 1 where the id is null.
Parts are in ascending doc_id order. The manifest (a small Parquet table, one row a part) has every part's
counts, and the running sum of the counts before it: the part's base in the whole stream.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molquarry.llm.common import WordTable, fresh_path, local_path, written

#: Bytes of text whose distinct words are encoded together, and rows that are turned into Python strings together.
SLICE_BYTES, ROWS = 6_000_000, 500

PART = "part int, n_docs long, n_tokens long"
#: Parts for each partition that the documents are read in, and documents of a part that a task reads back at once.
PARTS_PER_SPLIT, READ_DOCS = 2, 20_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file lies; the files are installed on every machine and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts through the ids of their words.

    Where the tokenizer's pre-tokenizer drops white space and ends each piece with a mark of its own, a text's ids are
    the ids of its white-space separated words in a row. A slice's distinct words are encoded once; a document is then
    a join of byte strings. Words that are new fall into the pre-tokenizer's pieces, and new pieces are encoded many at
    a time. Other tokenizers get whole texts. `same_as_whole` compares both ways."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel parts
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.suffix = told["model"].get("end_of_word_suffix") or ""
        self.by_words = bool(self.suffix and steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"])
        if self.by_words:
            pattern = steps[0]["pattern"]["Regex"]
            self.pattern = regex.compile(pattern)
            self.ascii_pattern = re.compile(pattern.replace("\\p{L}", "A-Za-z").replace("\\p{N}", "0-9"), re.ASCII)
        added = [re.escape(x["content"].encode()) for x in told.get("added_tokens", [])]
        self.special = re.compile(b"|".join(added) or b"(?!)").search
        self.dtype, self.table, self.pieces = np.dtype(dtype), WordTable(self.encode_words, 600_000), WordTable(self.encode_pieces, 250_000)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if self.suffix and t.endswith(self.suffix)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces, told apart in the ids of many by the mark at their ends."""
        found, width = {}, self.dtype.itemsize
        groups = [pieces[at : at + 256] for at in range(0, len(pieces), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(group):
                raw = ids.tobytes()
                found.update(zip(group, [raw[a * width : b * width] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
            else:
                found.update(zip(group, self.whole(group), strict=True))
        return found

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        parts, odd = {}, []
        for w in words:
            if w.isalpha():  # ASCII letters
                parts[w] = (w.lower().decode(),)
            elif self.special(w):
                odd.append(w)
            elif w.isascii():
                parts[w] = self.ascii_pattern.findall(w.lower().decode())
            else:
                parts[w] = self.pattern.findall(self.tokenizer.normalizer.normalize_str(w.decode("utf-8", "replace")))
        known = self.pieces.of(set(chain.from_iterable(parts.values())))
        found = {w: known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p)) for w, p in parts.items()}
        found.update(zip(odd, self.whole([w.decode("utf-8", "replace") for w in odd]), strict=True))
        return found

    def documents(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian bytes; the words of some megabytes are looked at together."""
        if not self.by_words:
            yield from (self.whole([text or ""])[0] for text in texts)
            return
        split, size = [], 0
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            split.append(raw.split())
            size += len(raw)
            if size >= SLICE_BYTES:
                yield from self.joined(split)
                split, size = [], 0
        yield from self.joined(split)

    def joined(self, split: list[list[bytes]]) -> Iterator[bytes]:
        known = self.table.of(set().union(*split))
        return (b"".join(map(known.__getitem__, words)) for words in split)


@cache
def encoder_of(path: str, dtype: str) -> WordEncoder:
    """One encoder a Python worker: what it has learnt serves the worker's later tasks too."""
    return WordEncoder(path, dtype)


def same_as_whole(path: str, texts: list[str]) -> bool:
    """Whether encoding by words gives the ids that encoding whole texts gives."""
    encoder = WordEncoder(path, "<u4")
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    return all(np.frombuffer(b, "<u4").tolist() == e.ids for b, e in zip(encoder.documents(texts), whole, strict=True))


def _store(folder: str):
    """(filesystem, path) of a folder in whatever store it lies."""
    from pyarrow import fs

    path = local_path(folder)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Encodes every whole text and writes the data set into `folder`; returns its manifest.

    Rows are range-partitioned and sorted by id (nulls first; equal ids by text), so one shuffle of the texts
    gives the order, and each task streams its sorted rows into one part. Ranges are of ids and the first characters of texts, so
    that many rows of one id or none are not one part. There are `parts` parts, or PARTS_PER_SPLIT for each partition that the
    documents are read in, which Spark cuts by bytes. A part is written under a name of
    the task's attempt and moved into place at its end: a lost or repeated task leaves no half part.
    Null and empty texts are a document of the end id alone. Only `id_col` and `text_col` are read, so other
    columns may have any names. An empty table gives no parts."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = parts or PARTS_PER_SPLIT * rows.rdd.getNumPartitions()
    rows = rows.repartitionByRange(parts, "id", F.substring("text", 1, 32)).sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        context, (store, path) = TaskContext.get(), _store(folder)
        part, own = context.partitionId(), context.taskAttemptId()
        store.create_dir(path, recursive=True)
        encoder, end = encoder_of(tokenizer, dtype), np.array([end_id], dtype).tobytes()
        ends, ids, nulls, at = [np.zeros(1, "<i8")], [], [], 0
        with store.open_output_stream(f"{path}/.{own}.bin") as out:
            for b in chain([first], batches):
                lengths = []
                for found in encoder.documents(t for k in range(0, b.num_rows, ROWS) for t in b.column(1).slice(k, ROWS).to_pylist()):
                    out.write(found + end)
                    lengths.append(len(found) // encoder.dtype.itemsize + 1)
                ends.append((at + np.cumsum(lengths)).astype("<i8"))
                at = int(ends[-1][-1]) if lengths else at
                ids.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(b.column(0).is_null().to_numpy(zero_copy_only=False).astype("u1"))
        n = sum(map(len, ids))
        for kind, arrays in (("idx", ends), ("docs", ids + nulls)):
            with store.open_output_stream(f"{path}/.{own}.{kind}") as out:
                for x in arrays:
                    out.write(x.tobytes())
        for kind in ("bin", "idx", "docs"):
            store.move(f"{path}/.{own}.{kind}", f"{path}/part-{part:06d}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [n], "n_tokens": [at]})

    manifest = written(rows.mapInArrow(write, PART), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    return manifest.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), F.lit(folder).alias("folder"), F.lit(dtype).alias("dtype"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document (doc_id, start, n_tokens, ids_crc32) from the files: ranges of READ_DOCS documents of the parts are dealt over
    the tasks; a range's ids are memory-mapped (or, outside a local store, read by their place), and the part's base is
    added to its documents' offsets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            store, path = _store(row["folder"])
            name, dtype, n, at = f"{path}/part-{row['part']:06d}", np.dtype(row["dtype"]), row["n_docs"], row["first"]
            to = min(n, at + READ_DOCS)
            with store.open_input_file(f"{name}.idx") as source:
                ends = np.frombuffer(source.read_at(8 * (to - at + 1), 8 * at), "<i8")
            with store.open_input_file(f"{name}.docs") as source:
                ids, nulls = np.frombuffer(source.read_at(8 * (to - at), 8 * at), "<i8"), np.frombuffer(source.read_at(to - at, 8 * n + at), "u1")
            local = local_path(row["folder"])
            stream = np.memmap(f"{name}.bin", dtype, "r") if local else None
            source = None if local else store.open_input_file(f"{name}.bin")
            for i in range(0, to - at, 2_000):
                j = min(to - at, i + 2_000)
                lo, hi = int(ends[i]), int(ends[j])
                ids_here = stream[lo:hi] if local else np.frombuffer(source.read_at((hi - lo) * dtype.itemsize, lo * dtype.itemsize), dtype)
                cuts = (ends[i : j + 1] - lo).tolist()
                crc = [zlib.crc32(ids_here[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids[i:j], mask=nulls[i:j].astype(bool)),
                    "start": row["base"] + ends[i:j],
                    "n_tokens": np.diff(ends[i : j + 1]),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = manifest.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(READ_DOCS).cast("long"))))
    return ranges.repartition(parts, "part", "first").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the files of `docs` (doc_id, text) and reads them back: doc_id, start, n_tokens, ids_crc32 of every row.

    Null and empty texts have the end id alone; null ids come first and stay null; rows that repeat an id are documents each, in
    the order of their texts. Other columns are not read. An empty table gives no rows. The files stay in the shared folder."""
    return read_token_files(write_token_files(docs, fresh_path(spark, "tokens"), tokenizer or tokenizer_path(), end_id))
