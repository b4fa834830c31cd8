"""SimHash near-dedup: exact Hamming links between fingerprints, compared tile by tile.

Equal fingerprints are one row (their documents form one class, represented by the least id). A tile holds fingerprints
whose two 32-bit halves have the same population counts; two fingerprints within the radius have counts that differ by no
more than the radius in sum, so other pairs of tiles are skipped. Large tiles are cut into blocks. Pairs of blocks are found
by a join of the tiles' counts. Two blocks are compared by exclusive or and bit counts, after a further cut by the population
count of a quarter. A pair of blocks returns at most one edge per fingerprint (to the least one it reaches within the two
blocks), never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, join_uneven, materialize, partitions
from .components import components, merge

#: Fingerprints in a block of a tile, about.
BLOCK = 65_536
_ROWS = 256


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; zero without words.

    Words are runs without ASCII white space after lower-casing A-Z; with fewer than ``width`` words the whole sequence is
    one shingle. A bit is set if more than half of the shingles' XXH64 (seed 42) have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    hashes = np.array([hashed(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long) of the whole texts, then the columns ``keep`` (longs)."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found), *[batch[c] for c in keep]], names=["doc_id", "fp", *keep])

    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *keep)))


def link_blocks(fp_a: np.ndarray, id_a: np.ndarray, fp_b: np.ndarray, id_b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, least id reached) that connect what links between, not within, two blocks of fingerprints."""
    quarter_a, quarter_b = (np.bitwise_count(x & np.uint64(0xFFFF)).astype(np.int16) for x in (fp_a, fp_b))
    order_a, order_b = np.argsort(quarter_a, kind="stable"), np.argsort(quarter_b, kind="stable")
    fp_a, id_a, quarter_a, fp_b, id_b, quarter_b = fp_a[order_a], id_a[order_a], quarter_a[order_a], fp_b[order_b], id_b[order_b], quarter_b[order_b]
    ids, at = np.unique(np.concatenate([id_a, id_b]), return_inverse=True)
    at_a, at_b = at[: len(id_a)], at[len(id_a) :]
    parent = np.arange(len(ids))
    for q in np.unique(quarter_a):
        rows = np.arange(*np.searchsorted(quarter_a, [q, q + 1]))
        low, high = np.searchsorted(quarter_b, [q - radius, q + radius + 1])
        for k in range(0, len(rows), _ROWS):
            part = rows[k : k + _ROWS]
            i, j = np.nonzero(np.bitwise_count(fp_a[part, None] ^ fp_b[None, low:high]) <= radius)
            merge(parent, at_a[part][i], at_b[low:high][j])
    moved = parent != np.arange(len(ids))
    return ids[moved], ids[parent[moved]]


def links(distinct: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (fp, id) of every component."""
    half = [F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)).cast("int"), F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int")]
    rows = distinct.select("fp", "id", half[0].alias("p"), half[1].alias("q"))
    # at most 33 x 33 tiles of some blocks each
    ways = {(r.p, r.q): -(-r.n // block) for r in rows.groupBy("p", "q").agg(F.count("*").alias("n")).collect()}

    def gather(key, table):
        order = np.argsort(table["id"].to_numpy())
        p, q, b = (k.as_py() for k in key)
        return pa.table({"p": [p], "q": [q], "b": [b], "fps": [table["fp"].to_numpy()[order].tobytes()], "ids": [table["id"].to_numpy()[order].tobytes()]}).cast(schema)

    schema = pa.schema([("p", pa.int32()), ("q", pa.int32()), ("b", pa.int32()), ("fps", pa.binary()), ("ids", pa.binary())])
    count = F.create_map(*[F.lit(x) for (p, q), n in ways.items() for x in (p * 64 + q, n)]) if ways else F.create_map(F.lit(0), F.lit(1))
    blocks = materialize(
        rows.withColumn("b", F.pmod(F.xxhash64("fp"), count[F.col("p") * 64 + F.col("q")]).cast("int")).groupBy("p", "q", "b").applyInArrow(gather, "p int, q int, b int, fps binary, ids binary"),
        "simhash-blocks",
    )
    # each block's number with those of the blocks within the radius, itself included; then the blocks come to these pairs
    here, there = (blocks.select(F.col("p").alias(f"p{k}"), F.col("q").alias(f"q{k}"), F.col("b").alias(f"b{k}")) for k in (1, 2))
    near = F.array(*[F.struct(F.lit(x).alias("p"), F.lit(y).alias("q")) for x in range(-radius, radius + 1) for y in range(abs(x) - radius, radius - abs(x) + 1)])
    around = here.withColumn("d", F.explode(near)).select("p1", "q1", "b1", (F.col("p1") + F.col("d.p")).alias("p2"), (F.col("q1") + F.col("d.q")).alias("q2"))
    number = lambda k: F.struct(f"p{k}", f"q{k}", f"b{k}")
    pairs = around.join(there, ["p2", "q2"]).where(number(1) <= number(2))
    of = lambda k: blocks.select(F.col("p").alias(f"p{k}"), F.col("q").alias(f"q{k}"), F.col("b").alias(f"b{k}"), F.col("fps").alias(f"fps{k}"), F.col("ids").alias(f"ids{k}"))
    pairs = pairs.join(of(1), ["p1", "q1", "b1"]).join(of(2), ["p2", "q2", "b2"]).repartition(4 * partitions(distinct.sparkSession))

    def compare(batches):
        for batch in batches:
            for fa, ia, fb, ib in zip(*(batch[c] for c in ("fps1", "ids1", "fps2", "ids2"))):
                x = [np.frombuffer(v.as_py(), t) for v, t in ((fa, np.uint64), (ia, np.int64), (fb, np.uint64), (ib, np.int64))]
                a, b = link_blocks(*x, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.select("fps1", "ids1", "fps2", "ids2").mapInArrow(compare, "a long, b long")


def dedup(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """Return doc_id, fingerprint (16 hex digits), component_id: the least id reachable over links, itself included.

    Documents link if their fingerprints differ in at most ``radius`` bits. Null and empty texts have fingerprint zero and
    link like any other. A null id has the least other id of its component, or null if there is none; rows that share an id have
    each the component of its own text, and repeated rows give repeated results. Other columns are ignored; an empty table gives none.
    """
    found = materialize(fingerprints(docs, width), "simhash")
    # an id can stand for several fingerprints if rows share it, so links go between fingerprints
    classes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "simhash-classes")
    roots = components(links(classes.select("fp", F.col("fp").alias("id")), radius))
    classes = materialize(classes.join(roots, F.col("fp") == roots["id"], "left").select("fp", classes["id"], "n", F.coalesce("component_id", "fp").alias("root")), "simhash-roots")
    least = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = classes.join(least, "root").select("fp", "n", "component_id")
    return join_uneven(found, classes, "fp", "n", found.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group of near copies: that with the least id (nulls last), among equal ids in the order of a hash of the text.

    Rows are grouped by their own fingerprints, whatever their ids: rows without ids stay like any other, and of rows with
    equal ids all whose texts are no near copies. Where the other columns of equal ids and texts differ, a hash of all decides.
    Columns may have any name and type; they stay as they are.
    """
    named = dict(zip(docs.columns, columns(docs)))
    # a null adds nothing to a hash, so which values are null is hashed too; maps are hashed as what they read like
    plain = [F.to_json(F.struct(x)) if "map<" in kind else x for x, (_, kind) in zip(named.values(), docs.dtypes)]
    hashed = docs.select(
        named["doc_id"], named["text"], F.xxhash64(named["text"], F.isnull(named["text"])).alias("of_text"), F.xxhash64(*plain, *map(F.isnull, named.values())).alias("of_row"), F.struct(*named.values()).alias("row")
    )
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "of_text", "of_row")
    classes = materialize(fingerprints(hashed, width, ("of_text", "of_row")).groupBy("fp").agg(F.min(order).alias("least")), "simhash-least")
    roots = components(links(classes.select("fp", F.col("fp").alias("id")), radius))
    groups = classes.join(roots, F.col("fp") == F.col("id"), "left").groupBy(F.coalesce("component_id", "fp")).agg(F.min("least").alias("least"))
    kept = groups.select("least.of_text", "least.of_row")
    return hashed.join(kept, ["of_text", "of_row"], "left_semi").dropDuplicates(["of_text", "of_row"]).select("row.*")
