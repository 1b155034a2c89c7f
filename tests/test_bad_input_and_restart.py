"""Bad input lines stop a job; streams go on after a restart and replay without repeats."""
import datetime as dt

import pytest
from pyspark.errors import PySparkException

from pricewise.operators import scenarios as SC
from pricewise.session import scratch_path
from pricewise.sources import readers as RD
from pricewise.streaming import ledger_stream as LS


@pytest.mark.parametrize("line", ["[1,2]", "not json", "7", '{"seat_number": 3', "null"])
def test_scoring_input_must_be_objects(spark, tmp_path, line):
    p = tmp_path / "in.jsonl"
    p.write_text('{"seat_number": 2, "width": 5.0}\n' + line + "\n")
    with pytest.raises(PySparkException, match="no JSON object"):
        RD.read_inference_input(spark, str(p)).collect()


def test_document_entries_must_be_objects(spark, tmp_path):
    p = tmp_path / "in.json"
    p.write_text('[{"width": 1.0}, 7]')
    with pytest.raises(PySparkException, match="entry 1 holds no JSON object"):
        RD.read_inference_input(spark, str(p)).collect()


def test_broken_record_line_stops_the_reader(spark):
    lines = spark.createDataFrame([('{"parsed_json": {"price": 1.0}}',), ("{broken",), ("  ",)], "value string")
    with pytest.raises(PySparkException, match="record line holds no JSON object"):
        RD.parse_record_lines(lines).collect()
    assert RD.parse_record_lines(lines.where("value <> '{broken'")).count() == 1


def test_line_numbers_over_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a0"}\n\n\n{"id": "a3"}\n')
    (tmp_path / "b.jsonl").write_text('\n{"id": "b1"}\n')
    got = sorted((r["input_index"], r["record_index"], r["entry"]["id"]) for r in RD.read_inference_input(spark, str(tmp_path)).collect())
    assert got == [(0, 0, "a0"), (3, 1, "a3"), (5, 2, "b1")]


def test_listing_patterns(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for f in ("a.png", "sub/b.png", "sub/deep/c.png", "sub/d.txt"):
        (tmp_path / f).write_bytes(b"x")
    def names(glob):
        return [r["path"].rsplit("/", 1)[1] for r in RD.list_images(spark, str(tmp_path), glob).collect()]
    assert names("*.png") == ["a.png"]
    assert names("sub/*.png") == ["b.png"]
    assert sorted(names("**/*.png")) == ["a.png", "b.png", "c.png"]
    assert sorted(names("sub/**/*.png")) == ["b.png", "c.png"]
    with pytest.raises(FileNotFoundError):
        names("sub/*.jpg")


def outcomes(spark, rows):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(p, e, t + dt.timedelta(minutes=e), s) for p, e, s in rows],
                                 "pos long, event_id long, ts timestamp, status string")


def test_ledger_stream_restart_keeps_all_keys(spark):
    src, table, ckpt = (scratch_path(spark, n) for n in ("restart-src", "restart-table", "restart-ckpt"))
    first = outcomes(spark, [(1, 1, "ok"), (2, 2, "failed")])
    first.write.mode("append").parquet(src)
    LS.start_latest_stream(spark, src, first.schema, table, ckpt).awaitTermination()
    outcomes(spark, [(3, 3, "blocked"), (2, 4, "ok")]).write.mode("append").parquet(src)
    LS.start_latest_stream(spark, src, first.schema, table, ckpt).awaitTermination()
    got = {(r["pos"], r["status"]) for r in spark.read.parquet(LS.newest_version(spark, table)).collect()}
    assert got == {(1, "ok"), (2, "ok"), (3, "blocked")}
    # a version that was not finished is not read
    spark.range(1).write.parquet(f"{table}/v=000000000099")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v=000000000099/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    assert "v=000000000099" not in LS.newest_version(spark, table)


def test_replayed_scenario_batch_adds_no_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    from pricewise.operators.inference import ExpressionScorer
    from pricewise.streaming import scenario_stream as SS
    vocab = spark.createDataFrame([("colour_1", 0, "grey", "string")], "column string, position int, value string, value_type string")
    src, out = tmp_path / "req", scratch_path(spark, "replay-out")
    src.mkdir()
    (src / "a.json").write_text('{"scenario_id": "x", "numeric": {"width": 2.0}, "categorical": {"colour_1": "grey"}}\n')
    baseline = {"width": 1.0, "seat_number": 3.0, "height": 1.0, "depth": 1.0, "product_count": 1.0, "colour_1": "grey"}
    for _ in range(2):  # a new checkpoint each time: the same batch comes again
        SS.start_scenario_stream(spark, str(src), out, ExpressionScorer(F.col("seat_number") * F.col("width")), vocab,
                                 {"colour_1": ["grey"]}, baseline, {}, scratch_path(spark, "replay-ckpt")).awaitTermination()
    assert [r["predicted_price"] for r in spark.read.parquet(out).collect()] == [6.0]


def test_numeric_levels_and_large_vocabularies(spark, monkeypatch):
    vocab = spark.createDataFrame([("size", 0, "2", "string"), ("size", 1, "3.5", "string"), ("colour_1", 0, "2", "string"),
                                   ("colour_1", 1, "red", "string")], "column string, position int, value string, value_type string")
    ov = spark.createDataFrame([("a", "size", "2.0"), ("b", "size", " 3.50 "), ("c", "size", "4"), ("d", "colour_1", "2.0"),
                                ("e", "colour_1", "red"), ("f", "none", "x")], "scenario_id string, field string, value string")
    want = {("a", "2", True), ("b", "3.5", True), ("c", "4", False), ("d", "2.0", False), ("e", "red", True), ("f", "x", False)}
    for most in (SC.MAX_BROADCAST_LEVELS, 0):  # broadcast, and salted
        monkeypatch.setattr(SC, "MAX_BROADCAST_LEVELS", most)
        got = {(r["scenario_id"], r["coerced"], r["allowed"]) for r in SC.coerce_values(ov, vocab).collect()}
        assert got == want


def test_short_request_form(spark):
    req = spark.createDataFrame([("a", "width", 2.0, "colour_1", "grey"), ("b", None, None, None, None), ("c", "width", None, "colour_1", None)],
                                "scenario_id string, numeric_field string, numeric_value double, categorical_field string, categorical_value string")
    got = {r["scenario_id"]: (r["numeric"], r["categorical"]) for r in SC.single_overrides(req).collect()}
    assert got == {"a": ({"width": 2.0}, {"colour_1": "grey"}), "b": ({}, {}), "c": ({}, {})}
