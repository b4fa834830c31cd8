"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: rotations learned on a bounded sample (principal directions, then turned until the signs lose
least) and the signs after them. A code is split into 16-bit substrings, and every block of rows indexes each substring in a
table of its own. If two codes differ in at most r bits, then one of their m substrings differs in at most r // m: probing
those buckets finds every code within r, and the codes found are checked in full. The original vectors of those within r are
compared in double precision. A query's radius grows until its tenth neighbour so far is nearer than codes at that radius
can be expected to be. Where the tenth neighbour is far (60 of 128 bits), that is a good part of all buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, partitions, small

#: Vectors that rotations are learned on at most, about, chosen by a hash of the row; a length with few gets a random one.
SAMPLE = 16_384
BITS, PART = 128, 16
#: Rows in a block of the index and queries in a block, at most, about: every block of queries meets every block of rows, so
#: a row is shipped once for each block of queries, and a query once for each block of rows.
BLOCK, QUERIES = 131_072, 16_384
#: Queries that a block has at least, about, where there are fewer blocks than partitions.
FEW = 64
#: Standard deviations of a code's distance by which a radius exceeds what the tenth neighbour's angle leads to expect.
MARGIN = 2.0

_WEIGHT = np.bitwise_count(np.arange(1 << PART, dtype=np.uint32)).astype(np.uint8)
_ORDER = np.argsort(_WEIGHT, kind="stable").astype(np.uint32)
_LEVEL = np.searchsorted(_WEIGHT[_ORDER], np.arange(PART + 2))


class Codes:
    """Learned rotations of vectors of one length into BITS signs."""

    def __init__(self, sample: np.ndarray, turns: int = 30):
        n, dim = sample.shape
        self.mean = sample.mean(0) if n else np.zeros(dim)
        x = sample - self.mean
        rng = np.random.default_rng(dim)
        _, _, directions = np.linalg.svd(x.T @ x + 1e-9 * np.eye(dim))
        parts, left = [], BITS
        while left > 0:
            k = min(dim, left)
            rotation = np.linalg.qr(rng.standard_normal((k, k)))[0]
            v = x @ directions[:k].T
            for _ in range(turns if n > dim else 0):
                u, _, w = np.linalg.svd(np.where(v @ rotation > 0, 1.0, -1.0).T @ v)
                rotation = (u @ w).T
            parts.append(directions[:k].T @ rotation)
            left -= k
        self.rotation = np.concatenate(parts, 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Substrings (rows, BITS // PART) of the codes."""
        signs = np.packbits((x - self.mean) @ self.rotation > 0, axis=1, bitorder="little")
        return signs.view("<u2")


class Index:
    """A block of rows: codes, a table of buckets for each substring, vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes, rows: np.ndarray | None = None):
        self.ids, self.x, self.codes, self.rows = ids, vectors, codes, ids if rows is None else rows
        self.parts = codes(vectors)
        self.whole = np.ascontiguousarray(self.parts).view(np.uint64)
        self.tables = []
        for k in range(self.parts.shape[1]):
            order = np.argsort(self.parts[:, k], kind="stable").astype(np.int32)
            starts = np.concatenate([[0], np.cumsum(np.bincount(self.parts[:, k], minlength=1 << PART))])
            self.tables.append((order, starts))

    def within(self, part: np.ndarray, level: int) -> np.ndarray:
        """Rows that have a substring at ``level`` differing bits exactly from that of a query."""
        masks, found = _ORDER[_LEVEL[level] : _LEVEL[level + 1]], []
        for (order, starts), value in zip(self.tables, part.astype(np.uint32)):
            buckets = masks ^ value
            a, n = starts[buckets], starts[buckets + 1] - starts[buckets]
            busy = n > 0
            a, n = a[busy], n[busy]
            if len(n):
                ends = np.cumsum(n)
                found.append(order[np.repeat(a - ends + n, n) + np.arange(ends[-1])])
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def search(self, own: int | None, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the ``k`` nearest found but the row ``own``, ties to the smaller id."""
        part = self.codes(vector[None])[0]
        code, m = part.view(np.uint64), len(part)
        direction = vector - self.codes.mean
        size = np.linalg.norm(direction)
        known = np.zeros(len(self.ids), bool)
        ids, distance, beyond = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)
        apart = np.zeros(0, np.int64)
        level = -1
        radius = m - 1
        while True:
            while level < radius // m:  # probe the next buckets of every substring
                level += 1
                rows = self.within(part, level)
                known_before = known[rows]
                rows = np.unique(rows[~known_before])
                known[rows] = True
                beyond = np.concatenate([beyond, rows])
                apart = np.concatenate([apart, np.bitwise_count(self.whole[rows] ^ code).sum(1, dtype=np.int64)])
            now = apart <= radius
            rows, beyond, apart = beyond[now], beyond[~now], apart[~now]
            rows = rows[self.rows[rows] != own] if own is not None else rows
            ids = np.concatenate([ids, self.ids[rows]])
            distance = np.concatenate([distance, np.sqrt(((self.x[rows] - vector) ** 2).sum(1))])
            best = np.lexsort((ids, distance))[:k]
            ids, distance = ids[best], distance[best]
            if radius >= BITS:
                return ids, distance
            if len(ids) < k:
                radius = min(radius + m, BITS)
                continue
            # the angle at which a vector as long as the query's lies that far away
            turn = 2 * np.arcsin(min(1.0, distance[-1] / (2 * size))) if size > 0 else np.pi
            p = turn / np.pi
            needed = min(BITS, int(np.ceil(BITS * p + MARGIN * np.sqrt(BITS * p * (1 - p)))))
            if radius >= needed:
                return ids, distance
            radius = min(needed, radius + m)


def _usable(e):
    return (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)


def learn(rows: DataFrame, sample: int = SAMPLE) -> dict[int, Codes]:
    """Rotations by vector length, from about ``sample`` vectors in all at most."""
    total = rows.count()
    h = F.shiftrightunsigned(F.xxhash64("row", F.lit("rotation")), 2)
    table = rows.where(h < F.lit(int(min(1.0, sample / max(1, total)) * 2**62))).select("dim", "row", "v").toArrow()
    dims = table["dim"].to_numpy()
    out = {}
    for dim in np.unique(dims).tolist():
        part = table.take(pa.array(np.flatnonzero(dims == dim)))
        x = part["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)
        out[dim] = Codes(x[np.lexsort((part["row"].to_numpy(), *x.T[:1]))])
    return out


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """Return query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Every other row of (vec_id, embedding) of the same length is a candidate; score is the Euclidean distance in double
    precision, ties go to the smaller id. A vector that is null, empty, zero or holds a null or non-finite component takes no
    part, nor does a row with a null id. Rows that share an id are rows of their own, as queries too: each is ranked for
    itself and is a candidate for the others. Other columns are ignored; an empty table gives none.
    """
    kind = vectors.schema["embedding"].dataType.elementType
    e = F.col("embedding") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.when(_usable(e), e).alias("v")).where("v IS NOT NULL")
    rows = materialize(rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    codes, parts = learn(rows), partitions(vectors.sparkSession)
    is_query = F.col("id") % every == 0
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).where("q > 0")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    enough = F.least(F.ceil(F.lit(parts) / F.col("blocks")), F.ceil(F.col("q") / FEW))  # so that all partitions have work
    sizes = small(materialize(sizes.select("dim", "blocks", F.greatest(F.ceil(F.col("q") / queries), enough).cast("int").alias("groups")), "ann-sizes"))
    rows = rows.join(sizes, "dim")
    own = F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int")
    group = F.pmod(F.xxhash64("row", F.lit(2)), F.col("groups")).cast("int")
    held = rows.select("dim", own.alias("b"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "id", "row", "v")
    asked = rows.where(is_query).select(F.col("dim").alias("dim"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), group.alias("g"), *(F.col(c).alias(c) for c in ("id", "row", "v")))

    def run(key, left, right):
        dim = key[0].as_py()
        read = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        index = Index(left["id"].to_numpy(), read(left), codes.get(dim) or Codes(np.zeros((0, dim))), left["row"].to_numpy())
        found = [index.search(q, v, k) for q, v in zip(right["row"].to_pylist(), read(right))]
        many = [len(i) for i, _ in found]
        return pa.table({
            "query_id": np.repeat(right["id"].to_numpy(), many), "query": np.repeat(right["row"].to_numpy(), many),
            "vec_id": np.concatenate([i for i, _ in found]), "score": np.concatenate([d for _, d in found]),
        })

    found = held.groupBy("dim", "b", "g").cogroup(asked.groupBy("dim", "b", "g")).applyInArrow(run, "query_id long, query long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
