"""Rule classification: an ordered list of rules, the first that matches names the class.

Rules that ask for a literal text on the left side (most do) are found by one pass over it: a single expression shaped as a
trie gives the literals that start at each place, and a hash table, a constant array, gives their rules. So the cost of a row
follows its length and the literals in it, not the number of rules. Only rules of other kinds are tried one by one."""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Matches texts `left>>right` whose sides match the regular expressions; the second tier asks only for the left side."""

    name: str
    left: str
    right: str = ""


@dataclass(frozen=True)
class Literal:
    """A text that a side has to contain, as whole words or anywhere."""

    text: str
    whole: bool

    @property
    def key(self) -> str:
        return ("w" if self.whole else "s") + self.text

    def implies(self, other: Literal) -> bool:
        """Whether a place where this one starts is one where the other starts too."""
        if self.whole != other.whole or not self.text.startswith(other.text):
            return False
        ends = len(self.text) == len(other.text) or not self.whole
        return ends or _is_word(other.text[-1]) != _is_word(self.text[len(other.text)])


#: A literal of letters, digits, underscores and blanks, with or without word boundaries around it.
LITERAL = re.compile(r"(\\b)?([A-Za-z0-9_ ]+)(\\b)?")


def _is_word(c: str) -> bool:
    return c != " "


def literal_of(pattern: str) -> Literal | None:
    """The literal that a regular expression asks for and nothing else, or None."""
    m = LITERAL.fullmatch(pattern)
    return Literal(m[2], bool(m[1])) if m and bool(m[1]) == bool(m[3]) else None


def _trie(texts: set[str]) -> str:
    """An expression for the longest of `texts` at a place; beginnings that texts share are in it once."""
    heads = defaultdict(set)
    for t in texts:
        if t:
            heads[t[0]].add(t[1:])
    branches = "|".join(c + _trie(rest) for c, rest in sorted(heads.items()))
    return f"(?:{branches})" + ("?" if "" in texts else "") if branches else ""


def _found(side: Column, literals: set[Literal]) -> Column:
    """Keys of the longest literals that start at the places of a side, each once."""
    found = []
    keys = lambda texts, kind: F.transform(F.array_distinct(texts), lambda x: F.concat(F.lit(kind), x))
    for whole, kind, pattern in ((True, "w", r"\b(?=({})\b)"), (False, "s", r"(?=({}))")):
        texts = {x.text for x in literals if x.whole == whole}
        if texts:
            found.append(keys(F.regexp_extract_all(side, F.lit(pattern.format(_trie(texts))), F.lit(1)), kind))
    return F.concat(*found) if found else F.array().cast("array<string>")


ENTRY = "struct<key: string, n: int, rights: array<string>, check: string>"


def _table(rules: list[Rule], lefts: list[Literal | None], rights: list[Literal | None]) -> tuple[Column, int]:
    """(array of buckets of entries, its size, a power of two). A literal has the entries of all that it implies."""
    known, wanted = {x for x in lefts if x}, {x for x in rights if x}
    size = 1 << (2 * len(known)).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for found in sorted(known, key=lambda x: x.key):
        for i, (rule, left, right) in enumerate(zip(rules, lefts, rights, strict=True)):
            if left and found.implies(left):
                bucket = buckets[zlib.crc32(found.key.encode()) & (size - 1)]
                if rule.right:
                    keys = [x.key for x in sorted(wanted, key=lambda x: x.key) if x.implies(right)] if right else None
                    bucket.append({"key": found.key, "n": i, "rights": keys, "check": None if right else rule.right})
                bucket.append({"key": found.key, "n": len(rules) + i, "rights": None, "check": None})
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<{ENTRY}>>"), size


def class_of(text: Column, rules: list[Rule], default: str = "unclassified") -> Column:
    """Both sides first, in order of the rules; then left sides alone; a text without >> is the default."""
    sides = F.split(text, ">>", 2)
    left, right = F.get(sides, 0), F.get(sides, 1)
    lefts = [literal_of(r.left) for r in rules]
    rights = [literal_of(r.right) if r.right and a else None for r, a in zip(rules, lefts, strict=True)]
    numbers = []
    if any(lefts):
        table, size = _table(rules, lefts, rights)

        def first(s: Column) -> Column:
            place = lambda x: F.crc32(x.cast("binary")).bitwiseAND(F.lit(size - 1)).cast("int")
            entries = F.flatten(F.transform(s["l"], lambda x: F.filter(F.get(table, place(x)), lambda e: e["key"] == x)))
            good = lambda e: (e["rights"].isNull() | F.arrays_overlap(s["r"], e["rights"])) & (e["check"].isNull() | F.rlike(s["right"], e["check"]))
            return F.array_min(F.transform(F.filter(entries, good), lambda e: e["n"]))

        # a list of one row, so that both sides are scanned once
        said = F.struct(_found(left, {x for x in lefts if x}).alias("l"), _found(right, {x for x in rights if x}).alias("r"), right.alias("right"))
        numbers.append(F.get(F.transform(F.array(said), first), 0))
    others = [(i, r) for i, (r, x) in enumerate(zip(rules, lefts, strict=True)) if not x]
    tried = [F.when(left.rlike(r.left) & right.rlike(r.right), i) for i, r in others if r.right] + [F.when(left.rlike(r.left), len(rules) + i) for i, r in others]
    numbers += [F.coalesce(*tried)] if tried else []
    if not numbers:
        return F.lit(default)
    number = F.least(*numbers) if len(numbers) > 1 else numbers[0]
    name = F.get(F.array(*(F.lit(r.name) for r in rules)), number % len(rules))
    return F.when(F.size(sides) == 2, F.coalesce(name, F.lit(default))).otherwise(F.lit(default))


def classify_rules(df: DataFrame, rules: list[Rule], text_col: str, class_col: str, default: str = "unclassified") -> DataFrame:
    """Fills class_col of rows that have no class but a text."""
    found = F.when(F.col(class_col).isNull() & F.col(text_col).isNotNull(), class_of(F.col(text_col), rules, default)).otherwise(F.col(class_col))
    return df.withColumn(class_col, found)


def classify_counts(df: DataFrame, class_col: str) -> DataFrame:
    return df.groupBy(class_col).agg(F.count("*").alias("n"))
