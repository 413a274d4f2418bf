"""The corpus pipeline's stages on a small table, each against what it must keep."""

import pytest

pytest.importorskip("cellgauge.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests_llm_rows import item, rows


def test_stages(spark, tmp_path):
    table = rows()
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item())], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mix"]
    got, kept = docs, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{i}")
        stage(spark, got, str(tmp_path)).write.parquet(path)
        got = spark.read.parquet(path)
        kept[name] = {r["doc_id"] for r in got.select("doc_id").collect()}
        if name != "mix":
            assert got.columns == docs.columns
    everyone = {r[0] for r in table}
    assert everyone - kept["language_id"] == {90, 91, 92}
    assert kept["line_dedup"] == kept["language_id"]
    assert kept["line_dedup"] - kept["near_dedup"] == {2}
    assert kept["near_dedup"] - kept["decontamination"] == {30}
    assert kept["mix"] == kept["decontamination"]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.select("doc_id").collect()} == kept["mix"]
