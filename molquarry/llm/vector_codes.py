"""Product codes of vectors in whole numbers, assigned by slice-and-intersect bitmasks.

A component x counts as floor(256 x). Vectors are cut into equal parts, and every part has a codebook of at most 64 entries.

Assignment. In each dimension a codebook's entries are sorted by their coordinate, and prefix masks (uint64, a bit an entry)
tell which entries lie before a place in that order. The entry next to the value in each dimension gives a first distance, hence an
initial radius that the nearest entry cannot exceed. The radius selects a range of places in each dimension; the range's
entries are the difference of two prefix masks, and the masks of all dimensions ANDed leave the candidates: a superset of
all entries within the radius, so that the nearest one, and every entry that ties with it, is among them. Their distances
are exact, and candidates are walked in ascending order, so a tie goes to the lower index.

Training. A pass sends the codebooks to all tasks (parts x 64 entries, whatever the input's size), and every task adds up the parts
that each entry gets; sums of whole numbers do not depend on how rows are dealt. Only those sums are shuffled, and only
the new entries come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import settled, written
from molquarry.llm.vectors import matrices, usual_length

#: Scaled components are kept within this, so that all squared distances of a vector fit a 64-bit number.
LARGEST = 1 << 26


@dataclass(frozen=True)
class ProductCodes:
    """`parts` parts of vectors, `entries` (64 at most) entries a codebook, `rounds` rounds of training; labels up to `sent_labels` go to all tasks."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    sent_labels: int = 1_000_000


def scaled(x: np.ndarray, codes: ProductCodes) -> np.ndarray:
    """Components as whole numbers, rounded down: (rows, parts, components of a part)."""
    whole = np.clip(np.floor(x * codes.scale), -LARGEST, LARGEST).astype(np.int64)
    return whole.reshape(len(x), codes.parts, -1)


class Slices:
    """One codebook (entries, components) with its sorted coordinates and their prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        m, d = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.order = order
        self.coordinates = np.ascontiguousarray(np.take_along_axis(entries, order, 0).T)
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        self.prefix = np.zeros((d, m + 1), np.uint64)
        self.prefix[:, 1:] = np.bitwise_or.accumulate(bits, axis=0).T

    def distances(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        apart = x - self.entries[entry]
        return np.einsum("ij,ij->i", apart, apart)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """A mask a row, with the bits of all entries that may be the nearest."""
        n, d = x.shape
        most = np.iinfo(np.int64).max
        first = np.full(n, most)
        for j in range(d):
            at = np.minimum(np.searchsorted(self.coordinates[j], x[:, j]), len(self.entries) - 1)
            first = np.minimum(first, self.distances(x, self.order[at, j]))
        radius = np.sqrt(first.astype(np.float64)).astype(np.int64) + 1  # rounding may take one off the root
        mask = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        for j in range(d):
            low = np.searchsorted(self.coordinates[j], x[:, j] - radius, side="left")
            high = np.searchsorted(self.coordinates[j], x[:, j] + radius, side="right")
            mask &= self.prefix[j][high] ^ self.prefix[j][low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry of each row, the lowest index of several."""
        mask = self.candidates(x)
        entry, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        rows = np.arange(len(x))
        while len(rows):
            left = mask[rows]
            lowest = np.frexp((left & (~left + np.uint64(1))).astype(np.float64))[1] - 1
            d = self.distances(x[rows], lowest)
            closer = d < best[rows]
            entry[rows[closer]], best[rows[closer]] = lowest[closer], d[closer]
            left &= left - np.uint64(1)
            mask[rows] = left
            rows = rows[left != 0]
        return entry, best


def first_codebooks(rows: DataFrame, vector: str, order: str, dim: int, codes: ProductCodes) -> np.ndarray:
    """(parts, entries, components): the parts of the vectors of the smallest ids, null ids last, equal ids by their components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.where((F.size(vector) == dim) & good).orderBy(F.asc_nulls_last(order), vector).limit(codes.entries)
    x = np.array([r[0] for r in some.select(vector).collect()], np.float64).reshape(-1, dim)  # at most `entries` rows
    return scaled(x, codes).transpose(1, 0, 2)


def improved(rows: DataFrame, vector: str, dim: int, books: np.ndarray, codes: ProductCodes) -> np.ndarray:
    """The codebooks after one round over all rows; an entry that nothing is assigned to stays."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, x in matrices(batches, 0, dim, zero=True):
            whole = scaled(x, codes)
            for p, s in enumerate(slices):
                entry, _ = s.nearest(whole[:, p])
                counts[p] += np.bincount(entry, minlength=len(s.entries))
                np.add.at(sums[p], entry, whole[:, p])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    each = rows.select(vector).mapInArrow(add, "part int, entry int, n long, total array<long>")
    each = each.select("part", "entry", "n", F.posexplode("total").alias("i", "v"))
    new = books.copy()
    for r in each.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # as many as the codebooks' numbers
        new[r["part"], r["entry"], r["i"]] = r["v"] // r["n"]
    return new


def trained(rows: DataFrame, vector: str, order: str, codes: ProductCodes = ProductCodes()) -> tuple[int, np.ndarray]:
    """(length of vectors, codebooks) after all rounds; no vector can be coded if the length is 0."""
    dim = usual_length(rows, vector, codes.parts)
    books = first_codebooks(rows, vector, order, dim, codes) if dim else np.zeros((codes.parts, 0, 0), np.int64)
    for _ in range(codes.rounds if books.size else 0):
        books = improved(rows, vector, dim, books, codes)
    return dim, books


def coded(rows: DataFrame, vector: str, dim: int, books: np.ndarray, codes: ProductCodes = ProductCodes()) -> DataFrame:
    """The rows that can be coded, without their vectors, with `code` (a byte a part) and `error` (squared distances added up)."""
    rest = [c for c in rows.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for part, x in matrices(batches, len(rest), dim, zero=True):
            whole, code, error = scaled(x, codes), np.zeros((len(x), codes.parts), np.uint8), np.zeros(len(x), np.int64)
            for p, s in enumerate(slices):
                code[:, p], d = s.nearest(whole[:, p])
                error += d
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=[*rest, "code", "error"])

    rows = rows.select(*rest, vector)
    schema = rows.drop(vector).withColumn("code", F.lit(b"")).withColumn("error", F.lit(0).cast("long")).schema
    return rows.mapInArrow(run, schema) if books.size else rows.limit(0).select(*rest, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))


def decoded(code: Column, books: np.ndarray) -> Column:
    """The whole-number components that a code stands for."""
    tables = F.array(*(F.array(*(F.array(*(F.lit(int(v)) for v in entry)) for entry in part)) for part in books))
    byte = lambda p: F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int")
    return F.concat(*(F.get(F.get(tables, F.lit(p)), byte(p)) for p in range(len(books))))


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_digests(rows: DataFrame, codes: ProductCodes = ProductCodes()) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256 of every row of rows(vec_id, embedding, label) that can be coded.

    Rows without a vector, with null or non-finite components, or of another length than the usual one (the most frequent of those that the
    number of parts divides) are dropped. Zero vectors are coded. Repeated rows are rows of their own; a null id comes last
    in the order of ids and stays null; null labels are one label. Other columns are not read. Components beyond 2^18
    count as 2^18. With fewer rows than entries a codebook is as long as there are rows; an empty table gives no rows."""
    rows = rows.select("vec_id", "label", "embedding")

    def run() -> DataFrame:
        dim, books = trained(rows, "embedding", "vec_id", codes)
        found = written(coded(rows, "embedding", dim, books, codes), "codes")
        sums = written(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
        if sums.count() <= codes.sent_labels:
            sums = F.broadcast(sums)
        both = found.join(sums, F.col("label").eqNullSafe(F.col("of")))
        return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))

    return settled(run, "vector-codes")


def _sql() -> str:
    """The same as SQL: parts as rows, one pair of CTEs a round."""
    nearest = lambda k: f"""
a{k} AS (
  SELECT rid, p, e, d FROM (
    SELECT x.rid, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{k} c ON x.p = c.p
  ) QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1)"""  # noqa: E731
    moved = lambda k: f"""
m{k} AS (
  SELECT p, e, list(v ORDER BY i) AS v FROM (
    SELECT x.p, a.e, i, CAST(floor(sum(x.v[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS v
    FROM a{k} a JOIN x ON a.rid = x.rid AND a.p = x.p, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM x))) AS i) GROUP BY 1, 2, 3
  ) GROUP BY 1, 2),
c{k + 1} AS (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON c.p = m.p AND c.e = m.e)"""  # noqa: E731
    return f"""
WITH good AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda z: CAST(floor(256 * CAST(z AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0
), x AS (
  SELECT rid, p, w[p * len(w) // 16 + 1 : (p + 1) * len(w) // 16] AS v FROM good, (SELECT unnest(range(16)) AS p)
), c0 AS (SELECT p, rid - 1 AS e, v FROM x WHERE rid <= 64),
{nearest(0)},{moved(0)},{nearest(1)},{moved(1)},{nearest(2)},
coded AS (
  SELECT rid, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY 1
), per_label AS (
  SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN good USING (rid) GROUP BY 1
), book AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2
)
SELECT g.vec_id, c.code, c.error, l.label_error, b.codebooks_sha256
FROM coded c JOIN good g USING (rid) JOIN per_label l ON g.label IS NOT DISTINCT FROM l.label, book b
"""


SQL = _sql()
