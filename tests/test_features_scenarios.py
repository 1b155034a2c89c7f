"""F1–F9 contract and R1–R9 literal cases."""
from pyspark.sql import functions as F

from pricewise.operators import features as FE
from pricewise.operators import scenarios as SC


def test_drop_and_flatten(spark):
    df = spark.createDataFrame([(1.0, "b", "m", {"w": 2.0})], "price double, brand string, colour_1 string, d struct<w:double>")
    assert FE.drop_unused(df).columns == ["colour_1", "d"]
    assert "price" in FE.drop_unused(df, keep_price=True).columns
    assert FE.flatten(df).columns == ["price", "brand", "colour_1", "d.w"]


def test_vocabulary_sorted_and_before_cap(spark):
    df = spark.createDataFrame([(100.0, "b"), (9000.0, "z"), (50.0, "a"), (60.0, "b")], "price double, colour_1 string")
    v = FE.vocabulary_dict(FE.vocabulary(df, ["colour_1"]))
    assert v == {"colour_1": ["a", "b", "z"]}  # "z" only occurs above the cap but stays
    capped = FE.price_cap(df, 6000.0)
    out = FE.apply_vocabulary(capped.union(spark.createDataFrame([(1.0, "q")], capped.schema)), v, ["colour_1"])
    assert out.where("colour_1 IS NULL").count() == 1


def test_numeric_defaults(spark):
    df = spark.createDataFrame([(-1.0, -3.0, None), (0.0, -1.0, None), (4.0, None, None), (6.0, None, None)],
                               "a double, b double, c double")
    d = {r["field"]: r["default"] for r in SC.numeric_defaults(df, ["a", "b", "c"]).collect()}
    assert d == {"a": 5.0, "b": -2.0, "c": 1.0}


def test_top_k_backfill(spark):
    vocab = spark.createDataFrame([("x", i, v, "string") for i, v in enumerate("abcd")],
                                  "column string, position int, value string, value_type string")
    train = spark.createDataFrame([("c",), ("c",), ("b",), ("z",)], "x string")
    counts = SC.level_counts(train, vocab, ["x"])
    assert [r["value"] for r in SC.top_values(counts, 3).orderBy("rank").collect()] == ["c", "b", "a"]
    assert SC.top_values(counts, 0).count() == 0
    assert SC.categorical_defaults(counts).first()["value"] == "c"


def test_scenario_validation(spark):
    vocab = spark.createDataFrame([("reclining", 0, "false", "boolean"), ("reclining", 1, "true", "boolean"),
                                   ("colour_1", 0, "grey", "string")],
                                  "column string, position int, value string, value_type string")
    sc = spark.createDataFrame([
        ("zero", {"width": 0.0}, {}), ("unknown", {"legs": 1.0}, {}), ("bad", {}, {"colour_1": "pink"}),
        ("text_bool", {}, {"reclining": "false"}), ("none", {}, {}),
    ], "scenario_id string, numeric map<string,double>, categorical map<string,string>")
    v = {r["scenario_id"]: r for r in SC.validate(sc, ["width", "height"], vocab).collect()}
    assert v["zero"]["errors"] and v["unknown"]["errors"] and v["bad"]["errors"]
    assert v["text_bool"]["errors"] == [] and v["text_bool"]["coerced"] == {"reclining": "false"}
    assert v["none"]["errors"] == []
    o = SC.overlay(SC.validate(sc, ["width", "height"], vocab), {"width": 200.0, "height": 90.0, "colour_1": "grey",
                                                                 "reclining": "false"}, ["width", "height"], ["colour_1", "reclining"])
    assert o.where("scenario_id = 'none'").first()["width"] == 200.0
