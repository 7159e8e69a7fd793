"""The corpus pipeline: its stages, what they reject, and rows that are odd."""

import pytest

import corpus_pipeline as cp

AT = "/root/testdata/sf0.001"


def test_run(spark):
    out = cp.run(spark, AT).toPandas()
    docs = spark.read.parquet(f"{AT}/documents.parquet").toPandas().set_index("doc_id")
    assert out["doc_id"].is_unique and set(out["doc_id"]) <= set(docs.index)
    assert len(out) > 0.4 * len(docs)
    assert ((out["copies"] >= 1) & (out["copies"] <= 2) & (out["taken"] == out["copies"] * out["size"])).all()
    assert (out["text"].to_numpy() == docs.loc[out["doc_id"], "text"].to_numpy()).all()
    assert out["text"].is_unique  # no exact copies
    items = spark.read.parquet(f"{AT}/benchmark.parquet").toPandas()["text"]
    assert not any(i in t for i in items for t in out["text"])


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    rows = [(None, None, None, None, None, 1, "x"), (1, "", "en", "a", 0, 1, "x"), (2, "A plain sentence about the old house.", "en", None, 9, 1, "x"), (2, "A plain sentence about the old house.", "en", None, 9, 1, "x"), (3, "word " * 50_000, "en", "b", 1, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, copies string")
    out = stage(spark, docs, AT)
    assert out.columns[: len(cp.COLUMNS)] == cp.COLUMNS and len(set(out.columns)) == len(out.columns)
    assert out.count() <= len(rows)
    assert stage(spark, docs.where("false"), AT).count() == 0
    if name == "ngram_jaccard_join":
        assert out.count() == len(rows)


def test_mixing_stage_takes_rows_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "en", "s", 5)] * 3 + [(7, "d e f", "en", None, 5)] * 3 + [(i, "g h i", "en", "t", 5) for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.mix(spark, docs, AT).toPandas()
    # sources t (weight 1) and null (weight 2) and s (weight 3) of 9, 9 and 120 words
    assert out[out["source"] == "s"]["taken"].sum() == 18 and out[out["source"].isna()]["taken"].sum() == 18
    assert abs(out["taken"].sum() - 207) <= 3
