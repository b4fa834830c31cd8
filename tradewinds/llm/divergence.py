"""Source divergence audit: how far the term frequencies of a language's sources lie apart, and by which terms.

The terms of whole texts are counted once, per (lang, source, term). A pair of sources has V terms, most of which neither source
holds, so no term is visited for them: each pair starts at V times the value f0 of a term that neither holds. Corrections then
come from what does occur:

* a term with count c in source a gives f(p_a(c), p0_b) - f0 to the pair with every b; that depends on c alone, so it is taken
  once per distinct count of a source and multiplied by the number of its terms with that count;
* only where a term occurs in both, the postings of the term give f(p_a, p_b) - f(p_a, p0_b) - f(p0_a, p_b) + f0, unless it is 0.

All of it is whole-number arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small

#: Documents of a language that must hold a term; ranks of the term part; parts per unit of a frequency; added to each count.
LEAST_DOCS, TOP, UNIT, PRIOR = 10, 10, 1_000_000_000, 2
#: Rows of (lang, source, term) that a task adds up before it hands them on; rows that it hands on at once.
HELD, HANDED = 800_000, 100_000
#: Bytes and number of texts that are counted at once; a longer text is counted alone.
SLICE_BYTES, SLICE_TEXTS = 2_000_000, 50_000
#: Counts up to which their product with UNIT fits a long.
LONG_COUNT = 9_000_000_000

#: Bytes of terms: letters, those of A-Z in lower case, and all of characters beyond ASCII; every other byte is a gap, here 0.
_TERM_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def slices(lengths: np.ndarray, most_bytes: int, most_texts: int) -> list[tuple[int, int]]:
    """(start, end) of runs of texts with at most so many bytes, but for a longer text alone, and so many texts."""
    ends, out, start = np.cumsum(lengths, dtype=np.int64), [], 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = min(max(int(np.searchsorted(ends, before + most_bytes, side="right")), start + 1), start + most_texts)
        out.append((start, end))
        start = end
    return out


def count_slice(texts: pa.Array, group: np.ndarray) -> pa.Table:
    """(group, term, tf, df) of the terms of ``texts``, whose groups are numbered."""
    texts = texts.cast(pa.binary())
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    data = _TERM_BYTES[data]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(data)]
    begins[first] = inside[first]  # a text's end ends its term
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(np.flatnonzero(begins), at)))
    ends = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(doc), pa.py_buffer(ends), pa.py_buffer(data[inside])).dictionary_encode()
    terms, n = found.dictionary, len(texts)
    key = np.sort((group[doc].astype(np.int64) * len(terms) + found.indices.to_numpy()) * n + doc)  # group, term, document
    places = np.flatnonzero(np.diff(key, prepend=-1))  # one for each document of a term
    many, key = np.diff(places, append=len(key)), key[places] // n
    places = np.flatnonzero(np.diff(key, prepend=-1))  # one for each term of a group
    key, df = key[places], np.diff(places, append=len(key))
    tf = np.add.reduceat(many, places) if len(places) else many
    code = key % max(len(terms), 1)
    return pa.table({"group": key // max(len(terms), 1), "term": terms.take(pa.array(code)), "tf": tf.astype(np.int64), "df": df.astype(np.int64)})


def added_up(tables: list[pa.Table]) -> pa.Table:
    """One row for each group and term of ``tables``."""
    if len(tables) == 1:
        return tables[0]
    out = pa.concat_tables(tables).group_by(["group", "term"], use_threads=False).aggregate([("tf", "sum"), ("df", "sum")])
    return out.select(["group", "term", "tf_sum", "df_sum"]).rename_columns(["group", "term", "tf", "df"])


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, tf, df): occurrences and documents; each group has a row with a null term and no counts.

    Rows of a language's term lie in one partition.
    """

    def run(batches):
        groups, tables = {}, []

        def handed():
            langs, sources = (pa.array([k[i] for k in groups], pa.string()) for i in range(2))
            none = pa.table({"group": pa.array(range(len(groups)), pa.int64()), "term": pa.nulls(len(groups), pa.string()), "tf": pa.array([0] * len(groups), pa.int64()), "df": pa.array([0] * len(groups), pa.int64())})
            for batch in pa.concat_tables([*tables, none]).to_batches(max_chunksize=HANDED):
                yield pa.record_batch([langs.take(batch["group"]), sources.take(batch["group"]), batch["term"], batch["tf"], batch["df"]], names=["lang", "source", "term", "tf", "df"])
            groups.clear()
            tables.clear()

        for batch in batches:
            texts = batch["text"]
            for start, end in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES, SLICE_TEXTS):
                names = zip(*(batch[c].slice(start, end - start).to_pylist() for c in ("lang", "source")))
                tables.append(count_slice(texts.slice(start, end - start), np.array([groups.setdefault(k, len(groups)) for k in names])))
                if len(groups) + sum(t.num_rows for t in tables) > HELD:
                    tables[:] = [added_up(tables)]
                    if len(groups) + tables[0].num_rows > HELD / 2:
                        yield from handed()
        if tables:
            tables[:] = [added_up(tables)]
            yield from handed()

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = texts.mapInArrow(run, "lang string, source string, term string, tf long, df long")
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def per_unit(count: Column | str, n: Column | str, v: Column | str) -> Column:
    """1 + floor(UNIT (count + PRIOR) / (n + PRIOR v)), exact whatever the counts; for v = 0 it is 1."""
    count, n, v = (F.col(c) if isinstance(c, str) else c for c in (count, n, v))
    below = n + PRIOR * v
    top = (count + PRIOR).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    whole = F.when(count <= LONG_COUNT, F.call_function("div", (count + PRIOR).cast("long") * F.lit(UNIT).cast("long"), below)).otherwise(F.call_function("div", top, below.cast("decimal(19,0)")))
    return F.when(v > 0, whole + 1).otherwise(1).cast("long")


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most UNIT + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, tf, lang_tf, first): rows of the terms that at least ``least`` of the language's documents hold, of
    which one for each term is the first; and those of null terms, so that no group is missing."""
    same = W.partitionBy("term", "lang")  # at most a row for each source; terms lead, as sorting looks at the first bytes first
    rows = counts.withColumns({"lang_df": F.sum("df").over(same), "lang_tf": F.sum("tf").over(same), "_least": F.min("source").over(same)})
    first = F.col("term").isNotNull() & (F.col("source") == F.col("_least"))
    return rows.where((F.col("lang_df") >= least) | F.col("term").isNull()).select("lang", "source", "term", "tf", "lang_tf", first.alias("first"))


def group_sizes(kept: DataFrame) -> DataFrame:
    """(lang, source, n, lang_n, v, p0): occurrences of kept terms in the group and in its language, number of kept terms."""
    groups = kept.groupBy("lang", "source").agg(F.sum("tf").alias("n"), F.count_if("first").alias("v"))
    lang = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("v"))
    return groups.drop("v").join(lang, "lang").withColumn("p0", per_unit(F.lit(0), "n", "v"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Return lang, source, part, item, value and rank.

    Part ``pair``: every other source of the language as item, with the sum of f over the language's kept terms. Part ``term``:
    the ``top`` kept terms that the source uses more than its language does. Null lang, source and text are empty strings; a
    group without terms has pairs but no terms; a language without kept terms has pairs of value 0; a source that is alone in
    its language has no pairs. Rows count each for itself, whatever their ids; other columns are ignored; an empty table gives
    no rows.

    Terms are counted within tasks first, so a frequent term, source or language comes to a task only as one row from each. The
    pairs of a language are as many as its sources squared, which is what is asked for.
    """
    kept = materialize(kept_terms(count_terms(docs), least), "divergence-kept")
    groups = materialize(group_sizes(kept), "divergence-groups")
    sized = small(groups)
    scored = kept.where(F.col("term").isNotNull()).join(sized, ["lang", "source"]).withColumns({"p": per_unit("tf", "n", "v"), "q": per_unit("lang_tf", "lang_n", "v")})
    scored = materialize(scored.select("lang", "source", "term", "p", "q", "p0"), "divergence-scored")

    value = apart(F.col("p"), F.col("q"))
    found = scored.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = found.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    other = small(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("r0")))
    differ = F.col("source") != F.col("item")
    f0 = apart(F.col("p0"), F.col("r0"))
    start = groups.join(other, "lang").where(differ).select("lang", "source", "item", (F.col("v") * f0).alias("value"))
    alike = scored.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))  # p stands for the count
    single = alike.join(other, "lang").where(differ).withColumn("value", F.col("n") * (apart(F.col("p"), F.col("r0")) - f0)).where("value != 0")
    postings = scored.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("b"))  # at most a row for each source
    both = postings.select("lang", "b", F.explode("b").alias("a")).select("lang", "a", F.explode("b").alias("b")).where("a.source < b.source")
    p, p0, r, r0 = (F.col(c) for c in ("a.p", "a.p0", "b.p", "b.p0"))
    shared = both.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), (apart(p, r) - apart(p, r0) - apart(p0, r) + apart(p0, r0)).alias("value")).where("value != 0")
    found_once = single.select("lang", "source", "item", "value").unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))  # each counts for both
    corrections = found_once.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", "way.item", "value")
    pairs = start.unionByName(corrections).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    return found.unionByName(pairs)
