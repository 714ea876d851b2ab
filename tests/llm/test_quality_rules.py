import math
import re
from collections import Counter

import pyarrow.parquet as pq

from molquarry.llm.quality_rules import Rules, distance, judged, quality_digests, references

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, rules=Rules()):
    text = text or ""
    w = WORDS.findall(text)
    n = len(w)
    windows = [tuple(w[i : i + 5]) for i in range(n - 4)]
    found = Counter(windows)
    covered = {i + d for i, x in enumerate(windows) if found[x] > 1 for d in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def words_of(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w.strip(".,;:!?\"'()") for w in WORDS.findall(lower)]


KINDS = ["lower", "upper", "digit", "space", "line end", "other space", "punctuation", "exclamation", "symbol", "first byte", "later byte", "rest"]


def kind(b):
    """The class of a byte, stated apart from the operator's table."""
    c = chr(b)
    if b >= 0x80:
        return "first byte" if b >= 0xC0 else "later byte"
    if c.isalnum():
        return "digit" if c.isdigit() else "lower" if c.islower() else "upper"
    for name, chars in (("space", " "), ("line end", "\n\r"), ("other space", "\t\v\f"), ("exclamation", "!"), ("symbol", "#*$%&|<>")):
        if c in chars:
            return name
    return "punctuation" if c in ".,;:'\"-()?" else "rest"


def js(p, q):
    return math.sqrt(max(0, sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q)) / 2))


def test_documents_against_brute_force(spark):
    rules = Rules()
    rows = [r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = {r["doc_id"]: r for r in quality_digests(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    counts = {}
    for r in rows:
        counts.setdefault(r["lang"], Counter()).update(w for w in words_of(r["text"]) if w)
    common = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: rules.common]] for k, c in counts.items()}

    def histograms(r):
        raw, w = (r["text"] or "").encode(), words_of(r["text"])
        kinds = Counter(map(kind, raw))
        chars = [kinds[k] for k in KINDS]
        c = Counter(w)
        own = [c[x] for x in common[r["lang"]]]
        return [x / max(1, len(raw)) for x in chars], [x / len(w) for x in [*own, len(w) - sum(own)]]

    mean = {}
    for lang in common:
        hs = [histograms(r) for r in rows if r["lang"] == lang and len(words_of(r["text"])) >= rules.min_words]
        mean[lang] = tuple([sum(x) / len(hs) for x in zip(*(h[i] for h in hs))] for i in (0, 1))
    for r in rows:
        g, want = got[r["doc_id"]], brute(r["text"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == want
        good = True
        if want[0] >= rules.min_words:
            c, w = (js(a, b) for a, b in zip(histograms(r), mean[r["lang"]]))
            assert abs(c - g["char_distance"]) < 1e-9 and abs(w - g["word_distance"]) < 1e-9
            good = c <= rules.max_chars and w <= rules.max_words
        assert g["kept"] == (good and not want[5])


def test_distance():
    import numpy as np

    assert distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1 and distance(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0


def test_odd_rows(spark):
    texts = [None, "", " \n\n ", "é " * 12, "a b c d e " * 3, "l 1\nl 1\n\n \nl 1\r\nl 1\r", "x" * 100_000, "w%d " * 50_000, "<|> ## word " * 12]
    docs = spark.createDataFrame([(i, None, t, 1) for i, t in enumerate(texts)] + [(None, "en", "again", 1)] * 2, "doc_id long, lang string, text string, kept int")
    got = quality_digests(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert tuple(r)[1:7] == brute(texts[r["doc_id"]])
            assert r["kept"] == (not r["base_failed"])
    assert quality_digests(docs.limit(0)).collect() == []
    assert judged(docs, references(docs.limit(0), Rules())).where("kept").count() == sum(not brute(t)[5] for t in texts)
