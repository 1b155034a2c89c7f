"""E1–E19 on the literal cases of FIXTURES.md §4."""
import pytest
from pyspark.sql import functions as F

from pricewise.operators import extract as EX


def clean(spark, texts):
    rows = [(f"k{i}", 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "image_path string, attempt int, raw_text string")
    return [r.asDict(recursive=True) for r in EX.clean_attempts(df).orderBy("image_path").collect()]


def obj(**kv):
    import json
    return json.dumps(kv)


def test_json_text_forms(spark):
    o = '{"price": 5}'
    out = clean(spark, [f"```json\n{o}\n```", f"```\n{o}\n```", o, f"Here: {o} thanks", "no braces"])
    assert [r["json_text"] for r in out] == [o, o, o, o, None]
    assert out[4]["error"] == EX.ERR_NO_JSON


def test_strict_parse(spark):
    texts = ['{"a":[1, ], }', '{"a":1} x', '{"a":1} {"b":2}', '{"a":1},{"b":2}', '{"a":1}],[{"b":2}']
    out = clean(spark, texts)
    # trailing commas repaired; '{"a":1} x' is cut back to the object by E1; the rest are rejected
    assert [r["valid"] for r in out] == [True, True, False, False, False]


@pytest.mark.parametrize("value,expected", [
    ('"£1,299.00"', 1299.0), ('"210 cm"', 210.0), ('"84\\""', 84.0), ('"84 inches"', 84.0),
    ('"1299 GBP"', None), ('"2.1m"', None), ('"1d"', None), ("true", None), ("null", None), ("12.5", 12.5),
])
def test_number(spark, value, expected):
    r = clean(spark, ['{"price": ' + value + "}"])[0]
    assert r["parsed"]["price"] == expected


@pytest.mark.parametrize("value,expected", [
    ("3.7", 3), ("-3.7", -3), ('"3-seater"', 3), ('"1,200"', 1200), ('"x"', None), ("true", None),
])
def test_integer(spark, value, expected):
    assert clean(spark, ['{"seat_number": ' + value + "}"])[0]["parsed"]["seat_number"] == expected


@pytest.mark.parametrize("value,expected", [('" Yes "', True), ('"n"', False), ('"1"', True), ("1", None), ('"maybe"', None)])
def test_boolean(spark, value, expected):
    assert clean(spark, ['{"storage": ' + value + "}"])[0]["parsed"]["storage"] == expected


@pytest.mark.parametrize("mats,m1,m2", [
    ('"Oak / Linen"', "Oak", "Linen"), ('"Wool and Silk"', "Wool", "Silk"), ('["A",""," B "]', "A", "B"), ('""', None, None),
])
def test_materials(spark, mats, m1, m2):
    p = clean(spark, ['{"specifications": {"materials": ' + mats + "}}"])[0]["parsed"]
    assert (p["material_1"], p["material_2"]) == (m1, m2)


@pytest.mark.parametrize("spec,expected", [
    ('{"sofa_sizes": "3 Seater"}', 3), ('{"sofa_sizes": ["2 seater", "4 seater"]}', 2), ('{"size": "large"}', None),
])
def test_seats(spark, spec, expected):
    assert clean(spark, ['{"specifications": ' + spec + "}"])[0]["parsed"]["seat_number"] == expected


@pytest.mark.parametrize("desc,expected", [("from £5 or $6", "GBP"), ("€9", "EUR"), ("none", None)])
def test_currency(spark, desc, expected):
    assert clean(spark, [obj(description=desc)])[0]["parsed"]["currency"] == expected


@pytest.mark.parametrize("value,expected", [("0", 1), ("-2", 1), ("null", 1), ('"2 sofas"', 2)])
def test_product_count(spark, value, expected):
    assert clean(spark, ['{"product_count": ' + value + "}"])[0]["parsed"]["product_count"] == expected


def test_arrays_and_validation(spark):
    out = clean(spark, ['{"evidence": null}', '{"evidence": ""}', '{"evidence": "USB"}', '{"evidence": ["a", 1]}'])
    assert [r["parsed"]["evidence"] if r["parsed"] else None for r in out[:3]] == [[], [], ["USB"]]
    assert out[3]["valid"] is False and out[3]["error"].startswith("schema:")


def test_model_alias_and_text(spark):
    p = clean(spark, ['{"model": "", "name": "  Sofa X ", "brand": "  ", "colour_1": 12}'])[0]["parsed"]
    assert (p["model"], p["brand"], p["colour_1"]) == ("Sofa X", None, "12")


def test_first_valid_and_route(spark):
    rows = [("a", 1, "bad"), ("a", 2, '{"price": 5}'), ("b", 1, "bad"), ("b", 2, "still bad"), ("c", 1, '{"price": 1}'),
            ("c", 2, '{"price": 2}'), ("d", 3, '{"price": 3}')]
    df = spark.createDataFrame(rows, "image_path string, attempt int, raw_text string")
    rec = {r["image_path"]: r for r in EX.extract_records(df, retry=1).collect()}
    assert rec["a"]["success"] and rec["a"]["attempts_used"] == 2 and rec["a"]["parsed_json"]["price"] == 5.0
    assert not rec["b"]["success"] and rec["b"]["attempts_used"] == 0 and rec["b"]["raw_text"] is None
    assert "no JSON object" in rec["b"]["error"]
    assert rec["c"]["parsed_json"]["price"] == 1.0
    assert "d" not in rec  # attempt beyond retry + 1 is ignored
    s = EX.summary(EX.extract_records(df, retry=1)).first()
    assert (s["total_images"], s["successful_extractions"], s["failed_extractions"]) == (3, 2, 1)


def test_summary_empty(spark):
    df = spark.createDataFrame([], "image_path string, attempt int, raw_text string")
    s = EX.summary(EX.extract_records(df)).first()
    assert s["total_images"] == 0 and s["success_rate"] == 0.0


def test_short_methods_and_repeated_work(spark):
    """Projections run in methods that HotSpot compiles, and a cleaned number names its regex once."""
    from pricewise.functions.coerce import number_text
    df = spark.createDataFrame([("k", 1, '{"price": "£1,299.00 cm", "width": " 84 "}')], "image_path string, attempt int, raw_text string")
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    out = EX.clean_attempts(df).select("f_price", "f_width").first()
    assert (out["f_price"], out["f_width"]) == (1299.0, 84.0)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    plan = df.select(number_text(F.col("raw_text")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_strict_parse_rejects_what_follows_an_object(spark):
    texts = ['{"a": 1}', '{"a": 1} {"b": 2}', '{"a": 1}] [{"b": 2}', '{"a": 1}} , {"b": {"c": 2}', '{"a": 1}, {"b": 2}', '{"a": 1} x}',
             '{"a": 1, "a": 2}', "{'a': 1}", '{"a": NaN}', '[{"a": 1}]', None, '{}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = [r["ok"] for r in df.select("i", EX.strict_parse(F.col("x")).isNotNull().alias("ok")).orderBy("i").collect()]
    assert got == [True] + [False] * 10 + [True]


def test_types_are_looked_up_only_where_a_text_leaves_a_rule_open(spark):
    """Texts, numbers and dimensions need no type, and read as before."""
    rows = ['{"price": 12.5, "brand": 7, "width": "84 inches", "seat_number": "3.7", "storage": 1, "pull_out_bed": "1", "evidence": ["a", null], "colour_1": true}',
            '{"price": "1e3", "brand": " b ", "width": true, "seat_number": 3.7, "storage": "0", "pull_out_bed": true, "evidence": "[x", "colour_1": ["£"], "description": false}',
            '{"price": "12d", "brand": {}, "width": [5], "seat_number": 1e3, "storage": " Yes ", "pull_out_bed": 1.0, "evidence": "[]", "specifications": "{", "delivery": ["€"]}']
    df = spark.createDataFrame([(f"k{i}", 1, x) for i, x in enumerate(rows)], "image_path string, attempt int, raw_text string")
    cols = ["price", "brand", "width", "seat_number", "storage", "pull_out_bed", "evidence", "colour_1", "currency"]
    out = EX.clean_attempts(df)
    assert [tuple(r) for r in out.orderBy("image_path").select(*[f"f_{c}" for c in cols]).collect()] == [
        (12.5, "7", 84.0, 3, None, True, ["a", "null"], "true", None),
        (1000.0, "b", None, 3, False, True, ["[x"], '["£"]', None),
        (None, "{}", None, 1000, True, None, ["[]"], None, "EUR")]
    plan = out.select("f_price", "f_brand", "f_colour_1", "f_width")._jdf.queryExecution().optimizedPlan().toString()
    assert "$.evidence" in plan and not any(f"$.{c}" in plan for c in ("price", "brand", "colour_1", "width"))
