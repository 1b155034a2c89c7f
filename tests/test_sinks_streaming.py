"""S6–S8 sinks and the streaming variants."""
import pytest
from pyspark.sql import functions as F

from pricewise.operators import extract as EX
from pricewise.operators import split as SP
from pricewise.session import scratch_path


def test_split_sink_refuses_overwrite(spark):
    df = spark.createDataFrame([(f"k{i}", float(i)) for i in range(20)], "k string, price double")
    s = SP.split(df, key="k")
    path = scratch_path(spark, "split-sink")
    SP.write_split(s, path)
    assert spark.read.parquet(path).where("split = 'holdout'").count() == s.where("holdout").count()
    with pytest.raises(Exception):
        SP.write_split(s, path)


def test_extraction_sink(spark):
    df = spark.createDataFrame([("a", 1, '{"price": 1}'), ("b", 1, "nope")], "image_path string, attempt int, raw_text string")
    rec = EX.extract_records(df)
    path = scratch_path(spark, "records")
    EX.write_records(rec, path)
    back = EX.read_written_records(spark, path)
    assert back.where("success").count() == 1 and back.where("NOT success").count() == 1
    with pytest.raises(Exception):
        EX.write_records(rec, path)
    EX.write_records(rec, path, overwrite=True)


def test_ledger_stream_matches_batch(spark):
    import datetime as dt
    from pricewise.operators.ledger import latest
    from pricewise.streaming import ledger_stream as LS
    t = dt.datetime(2024, 1, 1)
    rows = [(p, e, t + dt.timedelta(minutes=e), s) for e, (p, s) in enumerate(
        [(1, "failed"), (2, "ok"), (1, "ok"), (3, "timeout"), (2, "blocked"), (3, "ok")])]
    o = spark.createDataFrame(rows, "pos long, event_id long, ts timestamp, status string")
    src = scratch_path(spark, "stream-src")
    LS.write_outcome_files(o, src, files=3)
    got = sorted(tuple(r) for r in LS.run_to_completion(spark, src, o.schema).select("pos", "status").collect())
    want = sorted(tuple(r) for r in latest(o).select("pos", "status").collect())
    assert got == want == [(1, "ok"), (2, "blocked"), (3, "ok")]


def test_scenario_stream(spark, tmp_path):
    import json
    from pricewise.operators import features as FE
    from pricewise.operators import train as TR
    from pricewise.streaming import scenario_stream as SS
    rows = [(600.0 + 40 * i, ["grey", "blue"][i % 2], 2 + i % 3, 180.0 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "price double, colour_1 string, seat_number long, width double")
    vocab_t = FE.vocabulary(df, ["colour_1"])
    vocab = FE.vocabulary_dict(vocab_t)
    model = TR.price_model(vocab, df, maxIter=3, maxDepth=2).fit(df)
    src = tmp_path / "req"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps(x) for x in [
        {"scenario_id": "ok", "numeric": {"width": 200.0}, "categorical": {"colour_1": "blue"}},
        {"scenario_id": "bad", "numeric": {"width": -1.0}, "categorical": {}},
    ]))
    out = scratch_path(spark, "scen-out")
    base = {"seat_number": 3.0, "width": 190.0, "height": None, "depth": None, "product_count": 1.0, "colour_1": "grey"}
    q = SS.start_scenario_stream(spark, str(src), out, model, vocab_t, vocab, base, {"model_version": "m"})
    q.awaitTermination()
    res = {r["scenario_id"]: r for r in spark.read.parquet(out).collect()}
    assert res["ok"]["predicted_price"] is not None and res["bad"]["predicted_price"] is None
    assert res["bad"]["errors"]
