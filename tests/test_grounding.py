"""Grounding cuts the words of claims and sentences once, not again for each pair of them."""

from pyspark.sql import functions as F

from raglens.operators import evaluation


def test_words_are_cut_once(spark):
    rows = spark.createDataFrame([("Red fox runs. Blue bird sings! Nothing known.", ["The red fox runs. A blue whale.", "bird sings"]), (None, ["x y"]), ("Only this.", None), ("", [])], "a string, c array<string>")
    g = evaluation.grounding(F.col("a"), F.col("c"))
    plan = rows.select(g.alias("g"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") <= 6  # two for each use of the verdicts, none in the steps over pairs
    first = rows.select(g.alias("g")).first()["g"]
    assert (first["claims"], first["supported"]) == (3, 2)
    near = F.array(F.array(F.lit(0.1)), F.array(F.lit(0.9)))
    one = spark.createDataFrame([("Red fox. Blue bird.", ["green tree grows"])], "a string, c array<string>")
    assert one.select(evaluation.grounding(F.col("a"), F.col("c"), near)["supported"]).first()[0] == 1
