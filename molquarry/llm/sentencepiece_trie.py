"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is marked as the model's normalizer says (a mark before it and for each space) and falls apart into marked
words: no piece has a mark after another character, so words are encoded apart. Of a few thousand documents the
distinct words are sorted; walking the sorted list is a depth-first walk of their trie, in which each word keeps
the forward values of the prefix that it shares with the word before and only computes those of its own nodes.

A node's forward value depends on the kind of model:
  unigram  the best score of a segmentation of the prefix, and its last piece;
  BPE      the last piece of the prefix's own encoding. A last piece is right exactly if the encoding of what
           stands before it ends in a piece that it may follow: encoding the two pieces together leaves them
           apart. So one piece per node is enough here too, and the result is what merging by rank gives.
           (Maximising summed scores would be wrong for such models: their scores are merge ranks.)
The pieces that end at a node come from an Aho-Corasick automaton over all pieces, the longest first.
Characters without a piece become byte pieces, or the unknown piece in a model without them.

Decoding joins the bytes of pieces, so it is done once for each distinct word; only documents with a word that does not
come back as it was are decoded whole.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import WordTable, sparing

MARK = "▁"
#: Characters of text whose distinct words are sorted together, and rows that are turned into Python strings together.
SLICE_BYTES, ROWS = 3_000_000, 500
INF = float("inf")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lossy(bytes):
    """Ids of a word that decode to something else."""


class PieceModel:
    """The pieces of a SentencePiece model file and the forward values of prefixes."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        self.unigram = model.trainer_spec.model_type == model.trainer_spec.UNIGRAM
        self.prefix = model.normalizer_spec.add_dummy_prefix
        usual = [(i, p) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.ids = {p.piece: i for i, p in usual}
        self.score = {p.piece: p.score for _, p in usual}
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.unk_score = min(self.score.values(), default=0.0) - 10
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.raw = [b"" if p.type == kinds.CONTROL else bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else p.piece.encode() for p in model.pieces]
        self.raw[self.unk] = " ⁇ ".encode()
        self.spines: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        self.pairs: dict[int, bool] = {}  # by both ids in one number
        self.kept = b""
        self.table, self.parts = WordTable(self.encode_words, 150_000), WordTable(self.encode_parts, 50_000)
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.unit = self.units()
        self.longest = max(map(len, self.ids), default=1)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i, piece))
        self.automaton.make_automaton()

    def units(self) -> re.Pattern:
        """A line break, a run of marks with the characters after it, or marks alone: no piece reaches over these borders.
        Nor does one lead from another character to a mark of punctuation that no piece has after it: such marks begin
        units of their own (not where neighbouring unknown characters are one piece)."""
        points = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") if self.byte else set()
        while found := {c for x, c in self.inside if c in points and x not in points and x != MARK}:
            points -= found
        cut = re.escape("".join(sorted(points)))
        alone = f"|{MARK}*[{cut}][^{MARK}\n]*" if cut else ""
        return re.compile(f"\n|{MARK}*[^{MARK}\n{cut}]+{alone}|{MARK}+")

    def rest(self) -> None:
        """Forgets the words of a task and packs what is known of pieces and pairs: a worker stays for the tasks of other stages, which need
        its memory, and small objects that stay hold up large blocks."""
        self.table.clear()
        self.parts.clear()
        self.kept = pickle.dumps((self.pairs, self.spines), pickle.HIGHEST_PROTOCOL)
        self.pairs, self.spines = {}, {}

    def resume(self) -> None:
        """Unpacks what rest() has packed; a task that was stopped has packed nothing."""
        if self.kept:
            (self.pairs, self.spines), self.kept = pickle.loads(self.kept), b""

    # ---- merging by rank, for single pieces and runs of marks

    def merged(self, symbols: list[str]) -> tuple[list[str], list[tuple[str, str, str]]]:
        """(pieces, merges in their order) of merging the best neighbours, the leftmost of equals, until none is left."""
        parts, done = list(symbols), []
        while len(parts) > 1:
            score, at = max((self.score.get(a + b, -INF), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if score == -INF:
                break
            done.append((parts[-at], parts[-at + 1], parts[-at] + parts[-at + 1]))
            parts[-at : -at + 2] = [done[-1][2]]
        return parts, done

    def run_of_marks(self, n: int) -> list[str]:
        """Runs of marks have equal ranks: the leftmost neighbours always merge first. Each mark is looked at once."""
        done, last = [], MARK * bool(n)
        for _ in range(n - 1):
            if last + MARK in self.ids:
                last += MARK
                while done and done[-1] + last in self.ids:
                    last = done.pop() + last
            else:
                done.append(last)
                last = MARK
        return done + [last] * bool(n)

    def spine(self, piece: str, right: bool) -> list[tuple[str, float]]:
        """What stands at the piece's right (or left) edge while it is being made, each with the time it is made at: the
        worst rank among the merges that it needs. A piece that merging never makes has an empty spine."""
        if (piece, right) not in self.spines:
            parts, done = self.merged(list(piece)) if len(piece) > 1 else ([piece], [])
            if not done:
                found = [(piece, 0.0)] * (parts == [piece])
            elif parts != [piece]:
                found = []
            else:
                a, b, _ = done[-1]
                sides = self.spine(a, right), self.spine(b, right)
                found = sides[right] + [(piece, max(-self.score[piece], sides[0][-1][1], sides[1][-1][1]))]
            self.spines[piece, right] = found
        return self.spines[piece, right]

    def may_follow(self, a: str, b: str) -> bool:
        """Whether encoding a + b gives a and b: no merge across their border comes before the next merge beside it."""
        left, right, i, j = self.spine(a, True), self.spine(b, False), 0, 0
        while left and right:
            next_a = left[i + 1][1] if i + 1 < len(left) else INF
            next_b = right[j + 1][1] if j + 1 < len(right) else INF
            across = -self.score.get(left[i][0] + right[j][0], -INF)
            if across < next_a and across <= next_b and across < INF:
                return False
            if next_a == next_b == INF:
                return True
            i, j = (i + 1, j) if next_a <= next_b else (i, j + 1)
        return False

    # ---- the walk of the trie

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) of sorted, distinct words."""
        for word, sizes, _ in self.nodes(words):
            pieces, i = [], len(word)
            while i:
                n = sizes[i]
                pieces.append(word[i - n : i])
                i -= n
            yield word, pieces[::-1]

    def nodes(self, words: Iterable[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """(word, lengths, ids) of sorted, distinct words: entry i of the lists is the last piece of the first i characters (id -1: a
        character without a piece). A word shares the entries of the prefix it has in common with the one before."""
        before, sizes, last, scores = "", [0], [-1], [0.0]
        forward = self.best_scores if self.unigram else self.own_encodings
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del sizes[shared + 1 :], last[shared + 1 :], scores[shared + 1 :]
            forward(word, shared, sizes, last, scores)
            yield word, sizes, last
            before = word

    def own_encodings(self, word: str, shared: int, sizes: list[int], last: list[int], _: list[float]) -> None:
        """Appends the entries of word's prefixes longer than `shared` characters for a BPE model."""
        pairs, at = self.pairs, shared
        sizes += [1] * (len(word) - shared)
        last += [-1] * (len(word) - shared)
        for end, (n, i, piece) in self.automaton.iter(word, max(0, shared + 1 - self.longest)):
            if end < at:
                continue  # shared, or a longer piece has been found
            before = end + 1 - n
            if before:
                a = last[before]
                if a >= 0:
                    pair = a << 32 | i
                    free = pairs.get(pair)
                    if free is None:
                        if len(pairs) > 1_000_000:
                            pairs.clear()
                        free = pairs[pair] = self.may_follow(word[before - sizes[before] : before], piece)
                    if not free:
                        continue
            elif not self.spine(piece, True):
                continue
            at = end + 1
            sizes[at], last[at] = n, i

    def best_scores(self, word: str, shared: int, sizes: list[int], last: list[int], scores: list[float]) -> None:
        """The same for a unigram model: the best score of a segmentation of each prefix."""
        ends: dict[int, list[tuple[int, int, str]]] = {}
        for end, value in self.automaton.iter(word, max(0, shared + 1 - self.longest)):
            ends.setdefault(end + 1, []).append(value)
        for at in range(shared + 1, len(word) + 1):
            found = max(((scores[at - n] + self.score[piece], n, i) for n, i, piece in ends.get(at, ())), default=(-INF, 1, -1))
            if word[at - 1] not in self.ids:
                found = max(found, (scores[at - 1] + self.unk_score, 1, -1))
            scores.append(found[0])
            sizes.append(found[1])
            last.append(found[2])

    def to_ids(self, pieces: list[str]) -> list[int]:
        out, unknown = [], False
        for piece in pieces:
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.byte:
                out.extend(map(self.byte.__getitem__, piece.encode("utf-8", "replace")))
            elif not unknown:  # neighbouring unknown characters are one unknown piece
                out.append(self.unk)
            unknown = found is None
        return out

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct marked words as bytes (Lossy if decoding them gives something else). Words are cut between
        characters that no piece has side by side."""
        parts, whole, several, inside = {}, [], [], self.inside
        for w in words:
            if w[1:].isalpha():
                whole.append(w)
            elif not self.unigram and (w.startswith(MARK * 2) or w == MARK):
                several.append(w)
            else:
                cuts = [i for i in range(1, len(w)) if w[i - 1 : i + 1] not in inside] if self.byte else []  # else unknown characters stay together
                parts[w] = [w[i:j] for i, j in zip([0, *cuts], [*cuts, len(w)], strict=True)] if cuts else (w,)
        known = self.parts.of(set(chain.from_iterable(parts.values())))
        found = {w: known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p)) for w, p in parts.items()}
        found.update(self.encode_parts(whole))
        for w in several:  # all marks but the last form pieces of their own, and the last too where it stays alone
            rest = w.lstrip(MARK)
            marks = len(w) - len(rest)
            own = next(self.walk([MARK + rest]))[1] if rest else [MARK]
            own, marks = (own[1:], marks) if own[0] == MARK else (own, marks - 1)
            found[w] = self.packed(self.run_of_marks(marks) + own)
        raw = self.raw
        for w, ids in found.items():
            if b"".join(map(raw.__getitem__, array("i", ids))) != w.encode("utf-8", "replace"):
                found[w] = Lossy(ids)
        return found

    def encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        found = {}
        for word, sizes, last in self.nodes(sorted(parts)):
            ids, i = [], len(word)
            while i:
                ids.append(last[i])
                i -= sizes[i]
            if -1 in ids:
                pieces, i = [], len(word)
                while i:
                    pieces.append(word[i - sizes[i] : i])
                    i -= sizes[i]
                ids = self.to_ids(pieces[::-1])[::-1]
            found[word] = array("i", ids[::-1]).tobytes()
        return found

    def packed(self, pieces: list[str]) -> bytes:
        try:
            return array("i", map(self.ids.__getitem__, pieces)).tobytes()
        except KeyError:
            return array("i", self.to_ids(pieces)).tobytes()

    def marked(self, text: str | None) -> str:
        return (MARK * self.prefix + text.replace(" ", MARK)) if text else ""

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian int32 bytes."""
        return (ids for ids, _ in self.encode_and_back(texts))

    def encode_and_back(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, bool]]:
        """(ids, whether they decode to the text) of each text; the words of some megabytes are sorted and walked together."""
        held, size = [], 0
        for text in texts:
            held.append((text or "", self.unit.findall(self.marked(text))))
            size += len(text or "")
            if size >= SLICE_BYTES:
                yield from self.joined(held)
                held, size = [], 0
        yield from self.joined(held)

    def joined(self, held: list[tuple[str, list[str]]]) -> Iterator[tuple[bytes, bool]]:
        known = self.table.of(set().union(*(words for _, words in held)))
        lossy = {w for w, ids in known.items() if type(ids) is Lossy}
        for text, words in held:
            ids = b"".join(map(known.__getitem__, words))
            # bytes that come back word by word come back as the marked text, which the text is unless it has marks itself
            same = MARK not in text and lossy.isdisjoint(words) or self.decode(array("i", ids)) == text
            yield ids, same

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def model_of(path: str) -> PieceModel:
    """One model a Python worker, without the words that a task has met."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces int, ids array<int>, round_trip boolean) of every whole text; round_trip says whether decoding
    the ids gives the text back (not so for a text that holds the mark itself, or unknown pieces).

    Null and empty texts give an empty array. No shuffle: rows stay where they are read; repeated rows are encoded
    each. Only the two named columns are read."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        model.resume()
        for batch in batches:
            texts = (t for at in range(0, batch.num_rows, ROWS) for t in batch.column(1).slice(at, ROWS).to_pylist())
            encoded = model.encode_and_back(texts)
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found, back = zip(*islice(encoded, part.num_rows), strict=True)
                values = np.frombuffer(b"".join(found), "<i4")
                ends = np.cumsum([0] + [len(b) // 4 for b in found]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0),
                    "n_pieces": pa.array(np.diff(ends)),
                    "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32())),
                    "round_trip": pa.array(back, pa.bool_()),
                })
        model.rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sparing(run), "doc_id long, n_pieces int, ids array<int>, round_trip boolean")


def decode_pieces(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of arrays of ids; a null array gives a null text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
