"""L1–L7 literal cases (FIXTURES.md §4)."""
import datetime as dt

from pyspark.sql import functions as F

from pricewise.operators import ledger as LG


def outcomes(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t, "timeout"), (1, 2, t + dt.timedelta(seconds=5), "ok"),
            (2, 3, t, "blocked"), (3, 4, t, "weird")]
    return spark.createDataFrame(rows, "pos long, event_id long, ts timestamp, status string")


def test_latest_counts_pending(spark):
    o = outcomes(spark)
    lt = {r["pos"]: r["status"] for r in LG.latest(o).collect()}
    assert lt == {1: "ok", 2: "blocked", 3: "weird"}
    c = {r["metric"]: r["n"] for r in LG.status_counts(o).collect()}
    assert c == {"ok": 1, "failed": 1, "blocked": 1, "skipped": 0, "timeout": 1, "done": 1}
    wl = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3")], "pos long, url string")
    assert sorted(r["pos"] for r in LG.pending(wl, o).collect()) == [2, 3]


def test_blocked_page_and_names(spark):
    df = spark.createDataFrame([("Cloudflare ... Ray ID: 1",), ("Cloudflare",), ("Ray ID",)], "html string")
    assert [r[0] for r in df.select(LG.is_blocked_page(F.col("html"))).collect()] == [True, False, False]
    n = spark.createDataFrame([(7,), (42,), (1000,)], "p int").select(LG.artefact_name(F.col("p"))).collect()
    assert [r[0] for r in n] == ["screenshot_07.png", "screenshot_42.png", "screenshot_1000.png"]


def test_preview(spark):
    df = spark.createDataFrame([("  a\nb  ",), ("x" * 200,)], "t string")
    out = [r[0] for r in df.select(LG.preview(F.col("t"))).collect()]
    assert out[0] == "a b" and len(out[1]) == 180 and out[1].endswith("...")
