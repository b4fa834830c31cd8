"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, hashing, html_text, mixing, neardup, packing, part_codes, pii, quality, simhash, spans, token_counts, toxicity


#: The key of this query alone, which has no secrets to keep.
PII_KEY = "tradewinds"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.dedup(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"), PII_KEY)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(_table(spark, sf_dir, "documents"))


def op10_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.neighbours(_table(spark, sf_dir, "embeddings"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": op1_neardup,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_html": op6_html,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_spans": op9_spans,
    "op10_hashing": op10_hashing,
    "op11_tokens": op11_tokens,
    "op12_codes": op12_codes,
    "op13_divergence": op13_divergence,
}

_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
n AS (SELECT vec_id, label, e, len(e) AS dim FROM v WHERE ok),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.label = y.label AND x.dim = y.dim AND x.vec_id <> y.vec_id
      WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN d ON d.a = v.vec_id
"""

#: The hash is the first 15 hex digits of the MD5 of id and text; a document is taken once more while the running sum of sizes in
#: hash order stays within what whole passes leave over (the one that crosses it only if that is nearer; equal rows in any order).
_OP5 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             2.0::DOUBLE * source_size AS lim FROM r),
l AS (SELECT *, lim / w AS ratio, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS budget FROM w),
v AS (SELECT *, (budget - coalesce(sum(lim) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
g AS (SELECT source, source_size,
             CASE WHEN ratio <= level THEN lim
                  ELSE (budget - coalesce((SELECT sum(lim) FROM v WHERE ratio <= level), 0)) * w
                       / (SELECT sum(w) FROM v WHERE ratio > level) END AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM g),
hs AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS nth FROM d),
c AS (SELECT *, sum(size::DOUBLE) OVER (PARTITION BY source ORDER BY h, nth) AS upper FROM hs)
SELECT c.doc_id, c.size, p.source_size, p.target,
       ((p.passes + CASE WHEN c.upper - c.size::DOUBLE / 2 <= p.target - p.passes * p.source_size THEN 1 ELSE 0 END) * c.size)::BIGINT AS taken
FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
"""



def _op12(rounds: int = part_codes.ROUNDS) -> str:
    """The rounds one after the other, each comparing every part with every entry."""
    steps = [
        """WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS id FROM k),
s AS MATERIALIZED (
  SELECT id, part, list_slice(v, part * (len(v) // 8) + 1, (part + 1) * (len(v) // 8)) AS x FROM n CROSS JOIN (SELECT unnest(range(8)) AS part)),
b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x AS e FROM s WHERE id <= 16)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (
  SELECT id, part, x, entry, e, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM s JOIN b{r} USING (part) QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY d, entry) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT part, entry, list(mean ORDER BY place) AS e
  FROM (SELECT part, entry, place, sum(c)::BIGINT AS t, count(*) AS many,
               t // many - CASE WHEN t % many < 0 THEN 1 ELSE 0 END AS mean
        FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS place FROM d{r}) GROUP BY part, entry, place) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.e, b{r}.e) AS e FROM b{r} LEFT JOIN m{r} USING (part, entry))""")
    steps.append(f"""c AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM d{rounds} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM n JOIN c USING (id) CROSS JOIN h""")
    return ",\n".join(steps)


#: Every term of a language for each of its sources, and every pair compared over all of them.
_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
tf AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM tf GROUP BY lang, source),
ln AS (SELECT lang, sum(c)::HUGEINT AS n FROM tf GROUP BY lang),
lc AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM tf GROUP BY lang, term),
p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(tf.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(tf.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN tf ON tf.lang = g.lang AND tf.source = g.source AND tf.term = kept.term),
q AS (SELECT lc.lang, lc.term, 1 + (1000000000::HUGEINT * (lc.c + 2)) // (ln.n + 2 * v.v) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)), 0)::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM t) QUALIFY part = 'pair' OR rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op12_codes": _op12(),
    "op13_divergence": _OP13,
    "op1_neardup": _OP1,
    "op5_mixing": _OP5,
}
