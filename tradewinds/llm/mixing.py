"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id and text. A source's budget is met by the documents whose hash lies below a
threshold. The threshold is found without sorting documents: sum sizes by source and the leading hash bits, locate the
bucket in which the running sum crosses the budget, and refine only that bucket with the next bits, until the full hash
is known. Only one row per source and bucket is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, materialize, running, small

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 15


def row_hash(id_col: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id's text, a bar and the text (nulls: empty)."""
    whole = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Words to take from each source, from (source, source_size).

    Sources in code-point order (null last) get ``weights`` in turn, repeating. They share ``share`` times all sizes by
    weight; a source stops at ``most`` times its own size and what is left over is shared among the others by weight.
    Sources are dealt out by ranges, so that there can be any number of them.
    """
    ws = F.array(*[F.lit(float(w)) for w in weights])
    ranked = running(sizes, [F.asc_nulls_last("source")], {"rank": F.lit(1).cast("long")}).withColumn("w", F.element_at(ws, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = materialize(
        ranked.withColumn("limit", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("w")), "mix-ranked"
    )
    total = ranked.agg(F.sum("source_size").cast("double").alias("size"), F.sum("w").alias("w")).first()
    budget = float(share) * (total["size"] or 0.0)
    # the level to which the sources from this one on could be filled if those before it are full
    ordered = running(ranked, [F.col("ratio").asc(), F.col("rank").asc()], {"limits": F.col("limit"), "ws": F.col("w")})
    level = (F.lit(budget) - (F.col("limits") - F.col("limit"))) / (F.lit(total["w"] or 0.0) - F.col("ws") + F.col("w"))
    filled = materialize(ordered.withColumn("full", F.col("ratio") <= level), "mix-filled")
    left = filled.agg(F.sum(F.when(F.col("full"), F.col("limit"))).alias("used"), F.sum(F.when(~F.col("full"), F.col("w"))).alias("free")).first()
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.lit(budget - (left["used"] or 0.0)) * F.col("w") / F.lit(left["free"] or 1.0))
    return filled.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, upto, part, some): whole passes over the source, and the largest hash of one more.

    ``rows`` has source, h, size. Of the rows at the hash where the sum crosses the budget (one, or repeated ones), as many are
    taken as bring the sum nearest to it: ``some`` of those at the hash ``part``, if neither none nor all.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    edge = small(goals.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below")))
    shift = HASH_BITS
    running = W.partitionBy("source").orderBy("prefix").rowsBetween(W.unboundedPreceding, 0)
    while shift:
        shift -= LEVEL_BITS
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        hist = (
            rows.join(edge, inside)
            .groupBy("source", F.shiftright("h", shift).alias("prefix"))
            .agg(F.sum("size").alias("mass"), F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("below").alias("base"))
            .withColumn("upper", F.col("base") + F.sum("mass").over(running))
        )
        crossed = hist.where(F.col("upper") > F.col("rest")).groupBy("source", "rest").agg(F.min(F.struct("prefix", "upper", "mass", "n")).alias("c"))
        below = (F.col("c.upper") - F.col("c.mass")).alias("below")
        edge = small(materialize(crossed.select(F.col("source").alias("s"), "rest", "c.prefix", below, "c.mass", "c.n"), "mix-edge"))
    near = F.least(F.col("n"), F.floor((F.col("rest") - F.col("below")) / (F.col("mass") / F.col("n")) + 0.5))
    taken = F.when(near == F.col("n"), F.col("prefix")).otherwise(F.col("prefix") - 1)
    some = (near > 0) & (near < F.col("n"))
    edge = edge.select("s", taken.alias("upto"), F.when(some, F.col("prefix")).alias("part"), F.when(some, near).cast("long").alias("some"))
    return goals.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "passes", F.coalesce("upto", F.lit(-1).cast("long")).alias("upto"), "part", "some"
    )


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))


def plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = materialize(targets(sizes, weights, share, most), "mix-goals")
    return materialize(thresholds(rows, goals), "mix-thresholds")


def chosen(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (row, _source, _h and others) with the ``cuts`` of their source and ``_more``: whether they are in the last pass.

    Repeated rows at a source's last hash are alike, so it doesn't matter which of them are taken; they are numbered by ranges
    of a number that they have from where they lie, so that no task gathers them.
    """
    met = rows.join(small(cuts.withColumnRenamed("source", "_s")), F.col("_source").eqNullSafe(F.col("_s")))
    plain = met.withColumn("_more", F.col("_h") <= F.col("upto"))
    if not cuts.where("part IS NOT NULL").limit(1).count():
        return plain
    at_part = F.coalesce(F.col("_h") == F.col("part"), F.lit(False))
    alike = materialize(met.where(at_part).withColumn("_place", F.monotonically_increasing_id()), "mix-alike")
    nth = running(alike, [F.asc_nulls_first("_source"), F.col("_place")], {"_nth": F.lit(1).cast("long")})
    base = alike.groupBy("_source").agg(F.count("*").alias("_n")).select(F.col("_source").alias("_b"), F.coalesce(F.sum("_n").over(W.orderBy(F.asc_nulls_first("_source")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    nth = nth.join(small(base), F.col("_source").eqNullSafe(F.col("_b"))).withColumn("_more", F.col("_nth") - F.col("_base") <= F.col("some"))
    return plain.where(~at_part).unionByName(nth.select(*plain.columns))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Return doc_id, size, source_size, target, taken: the words that the mix takes from each document.

    Size: words of the text (null or empty: 0). Rows that share an id, or have none, are told apart by their texts; of rows
    equal in both, the last pass takes as many as come nearest to the target, so reruns give the same rows. Other columns of
    ``docs`` are ignored; an empty table gives none.
    """
    rows = materialize(sized(docs), "mix-sizes")
    cuts = plan(rows, weights, share, most)
    found = chosen(rows.select("doc_id", "size", F.col("source").alias("_source"), F.col("h").alias("_h")), cuts)
    taken = (F.col("passes") + F.col("_more").cast("long")) * F.col("size")
    return found.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def resample(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` as the mix takes them: a document taken twice is there twice, one not taken is gone. One without words is
    taken like any other, but never more than ``most`` times."""
    rows = materialize(sized(docs).select("source", "h", "size"), "mix-sizes")
    whole = docs.select(F.struct(*columns(docs)).alias("row"))  # so that no column of docs clashes with the cuts
    found = chosen(whole.select("row", F.col("row.source").alias("_source"), row_hash(F.col("row.doc_id"), F.col("row.text")).alias("_h")), plan(rows, weights, share, most))
    again = F.least(F.lit(int(most)).cast("long"), F.col("passes") + F.col("_more").cast("long"))
    return found.where(again > 0).withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), again))).select("row.*")
