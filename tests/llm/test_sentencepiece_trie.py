import random
from functools import lru_cache

import numpy as np
import pyarrow.parquet as pq
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from molquarry.llm.sentencepiece_trie import PieceModel, decode_pieces, encode_pieces, model_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  a  b", "▁▁x y", "    hello   world ", " " * 37 + "x" + " " * 20, "日本 語 é\tq\n\n x", "a\x00b", "a" * 300, "x" * 500, "the cat", "(((((---===", " ", "\n"]


def ids(model, texts):
    return [np.frombuffer(b, "<i4").tolist() for b in model.encode(texts)]


def texts():
    rng = random.Random(5)
    parts = ["tion", "ing", "the", "er", "an", "s", " ", "un", "able", "  ", "e", "\n", "ß", "日", ".", ",", "x", "1"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    return ODD + made + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()


def test_bpe_model_gives_the_librarys_ids():
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    model, given = PieceModel(model_path()), texts()
    want = library.encode([t or "" for t in given])
    assert ids(model, given) == want
    assert [model.decode(x) for x in want] == library.decode(want)


def test_unigram_model_gives_the_best_score(tmp_path):
    proto = pb.ModelProto()
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.1, 1), ("▁a", -3.2, 1), ("ba", -4.9, 1), ("aba", -5.5, 1), ("▁ab", -6.2, 1)]
    for piece, score, kind in pieces:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    proto.normalizer_spec.add_dummy_prefix = True
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    model = PieceModel(str(tmp_path / "m"))
    scores = {p: s for p, s, k in pieces if k == 1}

    @lru_cache(None)
    def best(word):
        return max([0.0] if not word else [best(word[: -len(p)]) + s for p, s in scores.items() if word.endswith(p)])

    rng = random.Random(1)
    words = sorted({"▁" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(300)})
    for word, found in model.walk(words):
        assert "".join(found) == word and abs(sum(map(scores.get, found)) - best(word)) < 1e-9
    assert ids(model, ["aczzb", "zz"]) == [[5, 0, 3], [1, 0]]


def test_query_columns_and_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "again", "x"), (3, "again", "x")], "doc_id long, text string, ids string")
    got = encode_pieces(docs)
    rows = got.collect()
    assert len(rows) == len(ODD) + 2 and all(r["n_pieces"] == len(r["ids"]) for r in rows)
    assert {r["doc_id"] for r in rows if not r["round_trip"]} == {3}
    back = {r["doc_id"]: r["text"] for r in decode_pieces(got.where("n_pieces > 0")).collect()}
    assert back[4] == ODD[4] and back[6] == ODD[6]
    assert encode_pieces(docs.limit(0)).collect() == []


def test_long_runs_and_long_texts():
    rng = random.Random(8)
    words = ["the", "(x", "a(b", "it's", "c++;", "{}", "e.g.,", "'tis", "\"q\"", "f(x)=y", "#1", "é,", "日,本", "...", "-", "_a_"]
    given = [" " * n + "x" for n in (38, 500, 3000)] + ["a" + " " * 2000 + "b" + " " * 777, "\n" * 500, " \n " * 300]
    given += [" ".join(rng.choice(words) for _ in range(60_000)), "".join(rng.choice("abcdefgh,.(") for _ in range(60_000))]
    library, model = sentencepiece.SentencePieceProcessor(model_file=model_path()), PieceModel(model_path())
    want = library.encode(given)
    assert ids(model, given) == want
    assert [back for _, back in model.encode_and_back(given)] == [d == t for d, t in zip(library.decode(want), given)]
    odd = ["a ▁ b", "▁", "x▁y ", "plain"]
    assert [back for _, back in model.encode_and_back(odd)] == [False, False, False, True]


def test_model_between_tasks_keeps_no_words_and_what_it_knows_of_pairs():
    texts = [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()][:60]
    model = PieceModel(model_path())
    first = list(model.encode_and_back(texts))
    pairs, spines = dict(model.pairs), dict(model.spines)
    model.rest()
    tables = model.table, model.parts
    assert not any((model.pairs, model.spines, *(t.hot for t in tables), *(t.recent for t in tables))) and 0 < len(model.kept) < 20 * len(pairs) + 200 * len(spines)
    model.resume()
    assert model.pairs == pairs and model.spines == spines and not model.kept
    assert list(model.encode_and_back(texts)) == first
