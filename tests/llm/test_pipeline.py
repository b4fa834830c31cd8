"""The pipeline: every stage against what its operator says of the stage's own input."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from tradewinds.llm import mixing, packing, simhash, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(pipeline.STAGES)
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == columns and clean.count() == toxicity.grade(docs, lab).where("NOT toxic").count() < docs.count()
    one = stages["simhash"](spark, clean, SF)
    assert one.columns == columns and one.count() == simhash.dedup(clean).select("component_id").distinct().count()
    masked = stages["pii"](spark, one, SF)
    assert masked.columns == columns and masked.count() == one.count() and masked.join(one.select("doc_id", one["text"].alias("before")), "doc_id").where("text <> before").count() > 0
    mixed = stages["mixing"](spark, masked, SF)
    words = mixing.mix(masked).groupBy().sum("taken").first()[0]
    assert mixed.columns == columns and mixing.sized(mixed).groupBy().sum("size").first()[0] == words
    assert sorted(packing.pack(mixed).columns) == sorted(stages["packing"](spark, mixed, SF).columns)
    assert pipeline.run(spark, SF).count() == stages["packing"](spark, mixed, SF).count()


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, "a b c d e f", "en", "s1", 11), (1, "a b c d e f", "en", "s1", 11), (None, "null id", None, None, None), (2, None, None, "s1", None), (3, "", "de", None, 0), (4, "word " * 30_000, "en", "s2", 150_000), (5, "é 漢字 a@b.example.com", "xx", "", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("odd", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for stage, f in pipeline.STAGES[:-1]:
            docs = f(spark, docs, at)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = pipeline.run(spark, at)
        ids = {r.doc_id for r in out.collect()}
        assert out.count() == 0 if name == "none" else ids >= {1, 4, 5}
