"""Search over several kinds of result, and unions of sources by priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs

c = F.col


def global_search(offers: DataFrame, query: str, each: int = 50) -> DataFrame:
    """Items, markets, traders and texts that hold ``query``, as (kind, name, offers); whole matches come first."""
    kinds = {"item": c("item"), "market": exprs.market(), "trader": c("player"), "text": c("raw_segment")}
    out = []
    for kind, column in kinds.items():
        found = offers.select(column.alias("name")).where(exprs.matches(query, "name")).groupBy("name").agg(F.count("*").alias("offers"))
        exact = F.when(F.lower("name") == query.lower(), 0).otherwise(1)
        out.append(found.orderBy(exact, F.desc("offers"), "name").limit(exprs.clamp_limit(each, 50)).select(F.lit(kind).alias("kind"), "name", "offers"))
    return reduce(DataFrame.unionByName, out)


def search_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("results"), F.sum("offers").alias("offers"))


def by_priority(*sources: DataFrame, key: str = "name") -> DataFrame:
    """Rows of all sources, of each key only the one of the first source that has it (then the least)."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("priority", F.lit(k)) for k, s in enumerate(sources)])
    order = W.partitionBy(F.lower(key)).orderBy("priority", key)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def either_key(left: DataFrame, right: DataFrame, keys: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """An inner join on equal keys or equal names (without case), as two equi-joins; a pair that both find is there once.

    Repeated rows match each for itself; nulls equal nothing.
    """
    by_key = left.join(right, c(keys[0]) == c(keys[1]))
    by_name = left.join(right, F.lower(c(names[0])) == F.lower(c(names[1])))
    return by_key.union(by_name.where(~F.coalesce(c(keys[0]) == c(keys[1]), F.lit(False))))


def merged_catalog(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogs of (item_key, name, aliases): the later name wins, aliases are united."""
    rows = old.withColumn("v", F.lit(0)).unionByName(new.withColumn("v", F.lit(1)))
    aliases = F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases"))))
    return rows.groupBy("item_key").agg(F.max_by("name", F.struct("v", "name")).alias("name"), aliases.alias("aliases"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in the place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
