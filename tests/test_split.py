"""D1–D4 invariants and the worked split fixture (FIXTURES.md §2)."""
from pyspark.sql import functions as F

from pricewise.operators import split as SP
from pricewise.operators.folds import assign_folds


def test_split_fixture(spark):
    rows = [(f"r{i}", 400.0 + 25 * i) for i in range(24)]
    df = spark.createDataFrame(rows, "k string, price double")
    s = SP.split(df, key="k", size=0.2, seed=42)
    sizes = {r["stratum"]: r["count"] for r in s.groupBy("stratum").count().collect()}
    assert sorted(sizes.values()) == [4, 5, 5, 5, 5]
    c = SP.split_counts(s).first()
    assert (c["total"], c["train"], c["holdout"]) == (24, 19, 5)
    per = {r["stratum"]: r["h"] for r in s.groupBy("stratum").agg(F.count_if("holdout").alias("h")).collect()}
    assert set(per.values()) == {1}


def test_stratum_of_one_and_sizes(spark):
    df = spark.createDataFrame([("a", None)] + [(f"p{i}", float(i)) for i in range(10)], "k string, price double")
    s = SP.split(df, key="k", size=0.15, seed=42)
    assert s.where("k = 'a'").first()["holdout"] is True
    for n, want in [(10, 2), (30, 4), (2, 1)]:
        assert SP.holdout_size(n, 0.15) == want


def test_split_is_partition_and_layout_free(spark):
    df = spark.createDataFrame([(f"k{i}", float(i % 97) * 10.0) for i in range(500)], "k string, price double")
    a = SP.split(df, key="k").select("k", "holdout").collect()
    b = SP.split(df.repartition(7), key="k").select("k", "holdout").collect()
    assert len(a) == 500 and sorted(a) == sorted(b)


def test_folds_sizes(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(103)], "k string")
    sizes = sorted(r["count"] for r in assign_folds(df, "k").groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]


def test_holdout_equals_ranks_and_moves_no_row(spark, monkeypatch):
    """The threshold picks the rows a rank inside each stratum would pick."""
    from pyspark.sql import Window

    from pricewise.functions import ranking as RK

    monkeypatch.setattr(RK, "LEAF_ROWS", 5)  # several rounds of buckets
    rows = [(f"k{i}", float(i % 311)) for i in range(4000)] + [(f"n{i}", None) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, price double")
    s = SP.split(df, key="k")
    w = Window.partitionBy("stratum").orderBy(RK.seeded_hash(SP.DEFAULT_SEED, "k"), "k")
    n = F.count(F.lit(1)).over(Window.partitionBy("stratum"))
    want = s.withColumn("r", F.row_number().over(w)).withColumn("n", n).select(
        "k", (F.col("r") <= F.greatest(F.lit(1), F.rint(F.col("n") * 0.15))).alias("holdout"))
    assert sorted(map(tuple, s.select("k", "holdout").collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in s._jdf.queryExecution().executedPlan().toString()


def test_folds_equal_ntile(spark, monkeypatch):
    from pyspark.sql import Window

    from pricewise.functions import ranking as RK
    from pricewise.operators import folds as FO

    monkeypatch.setattr(RK, "LEAF_ROWS", 3)
    for n in (0, 1, 3, 5, 1003):
        df = spark.range(n).select(F.concat(F.lit("k"), "id").alias("k"))
        got = {r["k"]: r["fold"] for r in assign_folds(df, "k").collect()}
        w = Window.orderBy(RK.seeded_hash(FO.FOLD_SEED, "k"), "k")
        assert got == {r["k"]: r["f"] - 1 for r in df.withColumn("f", F.ntile(5).over(w)).collect()}


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    from pricewise.functions.stats import exact_quantiles_multi

    rng = np.random.default_rng(4)
    columns = {
        "even": rng.uniform(0, 1, 3001), "wide": np.exp(rng.normal(0, 40, 3001)), "signed": rng.normal(0, 1e9, 3001),
        "hot": np.where(rng.random(3001) < 0.7, 5.0, rng.integers(0, 9, 3001)), "one": np.full(3001, -2.5),
        "close": 1.0 + rng.integers(0, 3, 3001) * 2.0**-52,
    }
    df = spark.createDataFrame(list(zip(*[c.tolist() for c in columns.values()])), [*columns])
    probs = [0.0, 0.1, 0.25, 0.5, 0.83, 1.0]
    got = exact_quantiles_multi(df, {c: F.col(c) for c in columns}, probs)
    for c, v in columns.items():
        s = np.sort(v)
        pos = [(len(s) - 1) * q for q in probs]
        assert got[c] == [s[int(p)] + (s[min(int(p) + 1, len(s) - 1)] - s[int(p)]) * (p - int(p)) if p % 1 else s[int(p)] for p in pos]
    assert exact_quantiles_multi(df.limit(0), {"even": F.col("even")}, probs) == {"even": None}


def test_fingerprint_is_unambiguous(spark):
    from pricewise.operators.folds import fingerprint

    def of(*rows):
        return fingerprint(spark.createDataFrame(list(rows), "a string, b string, c double"), ["a", "b", "c"]).first()["fingerprint"]

    different = [of(("x|", "y", 1.0)), of(("x", "|y", 1.0)), of((None, "y", 1.0)), of(("", "y", 1.0)), of(("x", "y", None)),
                 of(("x", "y", 1.0)), of(("x", "y", 2.0))]
    assert len(set(different)) == len(different)
    assert of(("p", "q", 1.0), ("r", "s", 2.0)) == of(("r", "s", 2.0), ("p", "q", 1.0))
