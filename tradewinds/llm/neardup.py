"""Embedding near-dedup: int8 tile products with rigorous error bounds, full precision only where they leave doubt.

A unit vector x is kept as scale * q + e with int8 q. For two vectors, |x.y - (sx qx).(sy qy)| <= |ex| |sy qy| + |x| |ey|, and
each factor is known per vector, so a tile product of int8 codes bounds every cosine from both sides. Pairs whose upper bound
misses the threshold are no links, those whose lower bound reaches it are; only the others are computed again in double
precision from the original vectors, each pair always in the same way.

Equal vectors of a label are one row with a weight. A large label is cut into blocks by hash and every two blocks of it are
compared in a task of their own; small labels share tasks. A tile returns, per vector, how much weight it links to and one
edge, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_uneven, materialize, small
from .components import components, merge

#: Numbers in a block, about, and the least vectors: a label of n blocks ships each of its vectors n times.
BLOCK_VALUES, LEAST_BLOCK = 1 << 20, 2048
#: Shares that a label's rows are dealt out to where its size is looked up.
SALTS = 64
#: Above the rounding errors of the bounds, which are computed in double precision.
SLACK = 1e-9
_ROWS = 256


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms of the errors) of unit vectors."""
    scale = np.abs(unit).max(1, initial=0) / 127
    codes = np.rint(unit / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - scale[:, None] * codes, axis=1)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes: 1,024 components at a time are whole numbers below 2**24, which float32 holds."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


class Tile:
    """Vectors of one block, with their codes and bounds."""

    def __init__(self, vectors: np.ndarray):
        self.x = vectors.astype(np.float64)
        largest = np.abs(self.x).max(1, initial=0)  # so that squares neither overflow nor vanish
        self.x /= largest[:, None]
        self.x /= np.linalg.norm(self.x, axis=1)[:, None]
        self.codes, self.scale, self.error = quantise(self.x)
        self.length = np.linalg.norm(self.scale[:, None] * self.codes, axis=1)


def tile_links(a: Tile, b: Tile, threshold: float):
    """Yield (i, j): all pairs of ``a`` and ``b`` with a cosine of at least ``threshold``, a part of the rows at a time."""
    for k in range(0, len(a.x), _ROWS):
        rows = slice(k, k + _ROWS)
        product = int8_products(a.codes[rows], b.codes) * a.scale[rows, None] * b.scale
        error = a.error[rows, None] * b.length + b.error + SLACK
        links = product - error >= threshold
        i, j = np.nonzero((product + error >= threshold) & ~links)
        for m in range(0, len(i), 65536):
            x, y = i[m : m + 65536], j[m : m + 65536]
            links[x, y] = np.einsum("ij,ij->i", a.x[rows][x], b.x[y]) >= threshold
        i, j = np.nonzero(links)
        yield i + k, j


def compare(ids: np.ndarray, weight: np.ndarray, block: np.ndarray, vectors: np.ndarray, threshold: float):
    """(id, weight linked to in here, least id reached in here); of two blocks, pairs within one are left to its own tile."""
    order = np.lexsort((ids, block))
    ids, weight, block, vectors = ids[order], weight[order], block[order], vectors[order]
    blocks = np.unique(block)
    cut = int(np.searchsorted(block, blocks[-1])) if len(blocks) > 1 else 0
    linked, rank = np.zeros(len(ids), np.int64), np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    parent = np.arange(len(ids))
    b = Tile(vectors[cut:])
    a = Tile(vectors[:cut]) if cut else b
    for i, j in tile_links(a, b, threshold):
        j = j + cut
        i, j = (i, j) if cut else (i[i < j], j[i < j])
        np.add.at(linked, i, weight[j])
        np.add.at(linked, j, weight[i])
        merge(parent, rank[i], rank[j])
    return ids, linked, np.sort(ids)[parent[rank]]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int | None = None) -> DataFrame:
    """Return vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Rows link if their labels (of any type) are equal and not null and their cosine is at least ``threshold``. A vector that is
    null, empty, zero or holds a null or non-finite component, or a row with a null label, links with nothing; so do vectors of
    different lengths. Repeated rows, and rows that share an id, are rows of their own that link like any others; kept is true
    for each whose id is its component's. A row without an id is linked and counted too; its component is the least id that it
    reaches, or null, and it isn't kept. Other columns are ignored; an empty table gives none.
    """
    kind = vectors.schema["embedding"].dataType.elementType
    e = F.col("embedding") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.when(usable, e).alias("v"))
    rows = materialize(rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("label", "v")), 256))), "neardup-rows")
    good = rows.where("key IS NOT NULL")
    classes = materialize(
        good.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("dim", F.size("v")),
        "neardup-vectors",
    )
    # a class is named by its least id; where it has none, or another class has the same, by a hash of its vector
    shared = small(classes.where("least IS NOT NULL").groupBy("least").count().where("count > 1").select("least", F.lit(True).alias("shared")))
    named = F.when(F.col("least").isNull() | F.col("shared"), F.xxhash64("key")).otherwise(F.col("least"))
    classes = classes.join(shared, "least", "left").withColumn("id", named).drop("shared").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    classes = materialize(classes, "neardup-classes")
    of_block = F.lit(block) if block else F.greatest(F.lit(LEAST_BLOCK), F.floor(F.lit(BLOCK_VALUES) / F.col("dim")).cast("int"))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("ways", F.ceil(F.col("n") / of_block).cast("int"))
    large = sizes.where("ways > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("label", "dim", "salt", "ways")
    placed = classes.join(large, ["label", "dim", "salt"], "left")
    ways, own = F.coalesce("ways", F.lit(1)), F.pmod(F.xxhash64("id", F.lit(1)), F.coalesce("ways", F.lit(1))).cast("int")
    # a small label goes to one of as many groups as there are blocks of rows; a large one to a group for every two blocks
    total = max(1, classes.count() // (block or LEAST_BLOCK))
    pairs = F.transform(F.sequence(F.lit(0), ways - 1), lambda k: F.struct(F.least(k, F.col("b")).alias("i"), F.greatest(k, F.col("b")).alias("j")))
    tiles = placed.withColumn("b", own).withColumn("pair", F.explode(pairs)).select(
        F.when(F.col("ways").isNull(), F.pmod(F.xxhash64("label", "dim"), F.lit(total))).otherwise(F.lit(-1)).alias("bin"),
        F.when(F.col("ways").isNotNull(), F.col("label")).alias("hot"),
        F.when(F.col("ways").isNotNull(), F.col("dim")).alias("hot_dim"),
        "pair.i", "pair.j", "label", "dim", "id", "weight", "b", "v",
    )

    def run(table):
        label, out = table["label"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64), []
        groups, at = np.unique(np.stack([label, table["dim"].to_numpy().astype(np.int64)]), axis=1, return_inverse=True)
        order = np.argsort(at.ravel(), kind="stable")
        for part in np.split(order, np.cumsum(np.bincount(at.ravel(), minlength=groups.shape[1]))[:-1]):
            own = table.take(pa.array(part))
            v = own["v"].combine_chunks().flatten().to_numpy().reshape(len(part), -1)
            out.append(compare(*(own[c].to_numpy() for c in ("id", "weight", "b")), v, threshold))
        ids, linked, low = (np.concatenate(c) for c in zip(*out))
        busy = linked > 0
        return pa.table({"id": ids[busy], "linked": linked[busy], "low": low[busy]})

    found = materialize(tiles.groupBy("bin", "hot", "hot_dim", "i", "j").applyInArrow(run, "id long, linked long, low long"), "neardup-links")
    roots = components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component_id", "root")
    summed = found.groupBy("id").agg(F.sum("linked").alias("linked"))
    linked = classes.select("key", "least", "id", "weight").join(summed, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    linked = materialize(linked, "neardup-linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = linked.join(least, "root").select("key", "weight", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), "component_id")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = join_uneven(good.select("vec_id", "key"), known, "key", "weight", rows.count()).select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
