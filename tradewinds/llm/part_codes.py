"""Vector codes of parts: each part of a vector is the index of its codebook's nearest entry, found with a vantage-point tree.

Components are whole numbers (floor of the component times ``scale``), so every distance is an exact whole number when squared.
The codebooks of all part positions are small (``parts`` x ``entries``); they go to every task, and each round brings back only
the number of parts per entry and the sums of their components, added up by Spark.

A vantage-point tree of a codebook keeps, at each node, one entry, and splits the others at the middle of their distances to it
into an inside and an outside. A branch is left out only if the triangle inequality, with radii rounded so that it can but err
towards looking, says that all its entries are farther than the nearest so far; equal distances are looked at, since the lower
index wins them. What is looked at is compared by its exact squared distance.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_uneven, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Whole components, times the square root of how many a vector has, must be smaller: then squared distances fit 63 bits.
LARGEST = 1 << 30
#: Entries of a node that are compared one by one instead of being split.
LEAF = 3


def _up(squared: np.ndarray) -> np.ndarray:
    """At least the square root."""
    return np.ceil(np.sqrt(squared.astype(np.float64))).astype(np.int64) + 1


def _down(squared: np.ndarray) -> np.ndarray:
    """At most the square root."""
    return np.maximum(np.floor(np.sqrt(squared.astype(np.float64))).astype(np.int64) - 1, 0)


@dataclass
class Node:
    """An entry of a codebook and what lies within ``inner`` of it and beyond ``outer``; a leaf has only ``indexes``."""

    indexes: list[int]
    split: int = 0  # squared distance up to which an entry is inside
    inner: int = 0  # at least the distance of any entry inside
    outer: int = 0  # at most the distance of any entry outside
    inside: "Node | None" = None
    outside: "Node | None" = None


def grow(entries: np.ndarray, indexes: list[int] | None = None) -> Node:
    """The tree of a codebook (a row of whole numbers per entry); entries may be equal."""
    indexes = list(range(len(entries))) if indexes is None else indexes
    if len(indexes) <= LEAF:
        return Node(indexes)
    vantage, others = indexes[0], np.array(indexes[1:])
    far = ((entries[others] - entries[vantage]) ** 2).sum(1)
    split = int(np.sort(far)[(len(far) - 1) // 2])
    within = far <= split
    if within.all():  # many at one distance
        return Node(indexes)
    return Node(
        [vantage], split, int(_up(far[within]).max()), int(_down(far[~within]).min()), grow(entries, others[within].tolist()), grow(entries, others[~within].tolist())
    )


class Search:
    """Nearest entries of many parts, all led through the tree together; ``looked`` counts the distances computed."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.tree, self.looked = entries.astype(np.int64), None, 0
        self.tree = grow(self.entries)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row, ties to the lower index."""
        self.queries = queries
        self.best = np.full(len(queries), np.iinfo(np.int64).max)
        self.index = np.full(len(queries), len(self.entries))
        self._visit(self.tree, np.arange(len(queries)))
        return self.index, self.best

    def _compare(self, k: int, rows: np.ndarray) -> np.ndarray:
        far = ((self.queries[rows] - self.entries[k]) ** 2).sum(1)
        better = (far < self.best[rows]) | (far == self.best[rows]) & (k < self.index[rows])
        at = rows[better]
        self.best[at], self.index[at] = far[better], k
        self.looked += len(rows)
        return far

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.inside is None:
            for k in node.indexes:
                self._compare(k, rows)
            return
        far = self._compare(node.indexes[0], rows)
        low, high, near = _down(far), _up(far), far <= node.split
        self._visit(node.inside, rows[near])
        self._visit(node.outside, rows[~near])
        reach = _up(self.best[rows])
        self._visit(node.inside, rows[~near & (low - node.inner <= reach)])
        self._visit(node.outside, rows[near & (node.outer - high <= reach)])


def whole_parts(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): the components as whole numbers, of the rows whose vector is complete and finite.

    Vectors must be equally long, a multiple of ``parts``, and their components within what ``LARGEST`` says.
    """
    x = F.col(vector)
    finite = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long"), "label", x.cast("array<double>").alias(vector)).where(finite & (F.size(x) > 0))
    large = F.exists(x, lambda c: F.abs(c * scale) * F.sqrt(F.size(x)) >= LARGEST)
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("int"))
    checked = F.when(large, F.raise_error(F.lit("a vector's component is too large for whole-number distances"))).when(F.size(x) % parts != 0, F.raise_error(F.lit(f"a vector can't be cut into {parts} equal parts")))
    return kept.select("vec_id", "label", F.coalesce(checked.cast("array<int>"), whole).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) != len(column) * width:
        raise ValueError("vectors must be equally long")
    return flat.reshape(len(column), width)


def learn(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position): first the parts of the rows with the smallest ids, then ``rounds`` times the means.

    The driver gets ``entries`` vectors, and for each round a count and ``position`` sums per part and entry.
    """
    first = [r["v"] for r in whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    if len({len(v) for v in first}) > 1:
        raise ValueError("vectors must be equally long")
    books = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    width = books.shape[2]

    for _ in range(rounds):

        def add(batches, books=books):
            searches = [Search(b) for b in books]
            sums = np.zeros((*books.shape[:2], width + 1), np.int64)
            for batch in batches:
                rows = _matrix(batch["v"], parts * width).reshape(-1, parts, width)
                for p, search in enumerate(searches):
                    index, _ = search.nearest(rows[:, p])
                    hot = (np.arange(len(search.entries))[:, None] == index).astype(np.float64)  # sums of a batch are exact
                    sums[p, :, :width] += (hot @ rows[:, p]).astype(np.int64)
                    sums[p, :, width] += hot.sum(1).astype(np.int64)
            p, k, at = np.nonzero(sums)
            yield pa.record_batch([pa.array(x) for x in (p, k, at, sums[p, k, at])], names=["part", "entry", "place", "total"])

        found = whole.select("v").mapInArrow(add, "part long, entry long, place long, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
        sums = np.zeros((*books.shape[:2], width + 1), np.int64)
        for r in found.collect():  # at most parts x entries x (width + 1)
            sums[r["part"], r["entry"], r["place"]] = r["total"]
        n = sums[:, :, width:]
        books = np.where(n > 0, sums[:, :, :width] // np.maximum(n, 1), books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of rows of :func:`whole_parts`."""
    parts, _, width = books.shape

    def run(batches):
        searches = [Search(b) for b in books]
        for batch in batches:
            rows = _matrix(batch["v"], parts * width).reshape(-1, parts, width)
            codes, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p, search in enumerate(searches):
                index, far = search.nearest(rows[:, p])
                codes[:, p] = index
                error += far
            text = codes.tobytes().hex()
            code = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], code, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return whole.mapInArrow(run, f"vec_id long, label {whole.schema['label'].dataType.simpleString()}, code string, error long")


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Return vec_id, code, error, label_error and codebooks_sha256 for each row with a complete, finite vector.

    Rows whose vector is null, empty or holds null or non-finite components are left out. Null labels count as one label. Ties
    and repeated rows: each row is coded for itself; among equal ids the smaller vector comes first where the codebooks start.
    With fewer rows than ``entries`` the codebooks are so much smaller; an empty table gives no rows. Vectors of unequal length,
    of a length that ``parts`` doesn't divide, or with components too large for ``LARGEST`` (32,768 for 64 of them) raise an error.
    Other columns are ignored. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part")
    whole = materialize(whole_parts(vectors, scale, parts), "codes-whole")
    books = learn(whole, parts, entries, rounds)
    coded = materialize(encode(whole, books), "codes")
    coded = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = materialize(coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "codes-labels")
    out = join_uneven(coded, sums, "_label", "_n", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
