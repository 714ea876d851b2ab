import os
import re
import weakref
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece

import corpus_pipeline as cp
from molquarry.llm import common
from molquarry.llm.common import read_table, row_key, written
from molquarry.llm.prefix_free import parse
from molquarry.llm.quality_model import Features, Ftrl, learned_model
from molquarry.llm.sentencepiece_trie import model_path
from tests.llm.test_decontaminate import split
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_prefix_free import Repeats

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def removed(texts, length=Repeats().length):
    from collections import Counter

    raws = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(r[i : i + length] for r in raws.values() for i in range(len(r) - length + 1))
    out = {}
    for k, r in raws.items():
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out[k] = bytes(b for b, g in zip(r, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages_one_by_one(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    before, kept = rows(docs), written(cp.quality_classifier(spark, docs, SF), "t")
    after = rows(kept)
    assert kept.columns == columns and all(after[i] == before[i] for i in after)
    assert all(i in after for i in before if labels.get(i) == 1)

    joined = written(cp.ngram_jaccard_join(spark, kept, SF), "t")
    groups = brute_components([(i, r["text"]) for i, r in sorted(after.items())], 5, 80, 100)
    assert joined.columns == columns and set(rows(joined)) == {c for _, _, c in groups}

    cut = written(cp.suffix_array_dedup(spark, joined, SF), "t")
    assert cut.columns == columns
    assert {i: r["text"] for i, r in rows(cut).items()} == removed({i: r["text"] for i, r in rows(joined).items()})

    clean = written(cp.benchmark_decontamination(spark, cut, SF), "t")
    items = [split(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    gone = set(rows(cut)) - set(rows(clean))
    assert clean.columns == columns
    for i, r in rows(cut).items():
        text = " ".join(w.decode("utf-8", "replace") for w in split(r["text"]))
        whole = any(" ".join(w.decode("utf-8", "replace") for w in item) in text for item in items)
        assert not whole or i in gone

    encoded = rows(cp.sentencepiece_encoding(spark, clean, SF))
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert all(encoded[i]["ids"] == library.encode(r["text"] or "") and encoded[i]["round_trip"] for i, r in rows(clean).items())


def test_classifier_rejects_by_plain_dot_products(spark):
    """On a larger table than above."""
    larger = SF.replace("0.001", "0.01")
    before = rows(read_table(spark, larger, "documents"))
    after = rows(cp.quality_classifier(spark, read_table(spark, larger, "documents"), larger))
    features, weights = Features(Ftrl().bits), learned_model(spark, larger).astype(float)
    dot = {i: sum(weights[p] * v for p, v in zip(*features(r["text"]), strict=True)) + weights[-1] for i, r in before.items()}
    assert all((dot[i] >= 0) == (i in after) for i in before if abs(dot[i]) > 1e-9)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{larger}/labels.parquet").to_pylist() if r["doc_id"] in before}
    assert all(i in after for i, q in labels.items() if q == 1)
    assert sum(i not in after for i, q in labels.items() if q == 0) > 0.5 * sum(q == 0 for q in labels.values())


def test_run_and_empty_documents(spark, tmp_path):
    for name in ("benchmark", "labels"):
        read_table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    read_table(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
    found = cp.run(spark, SF)
    assert found.columns == ["doc_id", "n_pieces", "ids", "round_trip"] and found.count() > 100


def test_columns_of_any_name_stay(spark, tmp_path):
    """Columns that the stages might use for themselves keep their names and values."""
    for name in ("benchmark", "labels"):
        read_table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    names = ("quality_score", "_row", "_spans", "row", "spans", "place", "stays", "node", "component", "Score")
    docs = read_table(spark, SF, "documents").selectExpr("*", *(f"concat('{c}', doc_id) as `{c}`" for c in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    for name, stage in cp.STAGES[:-1]:
        at = written(stage(spark, at, str(tmp_path)), "t")
        assert at.columns == docs.columns, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in at.collect() for c in names), name
    assert cp.STAGES[-1][1](spark, at, str(tmp_path)).count() == at.count()


def test_a_task_gives_memory_back_once_its_tables_are_gone(monkeypatch):
    class Table:
        pass

    tables, gone = [], []

    def run(batches):
        table = Table()
        tables.append(weakref.ref(table))
        yield from batches

    monkeypatch.setattr(common, "give_back", lambda: gone.append(tables[0]() is None))
    assert list(common.sparing(run)([1, 2])) == [1, 2] and gone == [True]


def test_workers_are_small_after_texts_were_parsed(spark):
    """What a worker keeps of a task adds to what later stages take: the suffix-array stage alone left 64 MB in each."""
    docs = read_table(spark, SF, "documents").select(row_key().alias("row"), "text").repartition(2)

    def anonymous(batches):
        for batch in batches:
            kept = sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())))
            yield pa.RecordBatch.from_arrays([pa.array([kept] * batch.num_rows), pa.array([os.getpid()] * batch.num_rows)], names=["kb", "pid"])

    def kept():
        return {r["pid"]: r["kb"] for r in spark.range(200).repartition(16).mapInArrow(anonymous, "kb long, pid long").collect()}

    before = kept()
    parse(docs, Repeats()).count()
    after = kept()
    assert all(after[p] < before[p] + 40_000 for p in before.keys() & after.keys())


def test_whole_texts_go_to_python_in_small_batches(spark):
    cp.quality_classifier(spark, read_table(spark, SF, "documents"), SF)
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
