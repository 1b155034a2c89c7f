"""Steps that decide how the model queries and the split grow with the input."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewise.functions import stats as ST
from pricewise.operators import booster as BO


def grown(limit: int, seed: int = 3) -> tuple[BO.Grower, int]:
    """A tree whose gains come from a made-up rule, and the passes it took."""
    g, passes = BO.Grower(BO.Params(max_leaf_nodes=limit, max_depth=12, min_samples_leaf=1)), 0
    while asked := g.waiting():
        passes += 1
        for i in asked:
            path = g.nodes[i].path
            gain = float(np.random.RandomState((seed, *path.encode())).exponential()) * 0.7 ** len(path)
            n = 1 << (40 - len(path))
            g.look(i, n, n, (gain, 0, b"\x01" + bytes(31), n // 2, n // 2))
    return g, passes


@pytest.mark.parametrize("limit", [2, 31, 200])
def test_a_tree_takes_about_as_many_passes_as_levels(limit):
    g, passes = grown(limit)
    assert sum(x.split for x in g.nodes) == limit - 1
    assert passes <= 1 + max(x.depth for x in g.nodes)
    # best first: no leaf that may be split has a larger gain than the last split
    ready, order = [g.nodes[0]], []
    while len(order) < limit - 1:
        best = max(ready, key=lambda x: x.gain)
        ready.remove(best)
        order.append(best.path)
        ready += [g.nodes[c] for c in best.children if g.may_split(g.nodes[c])] if best.children else []
    assert set(order) == {x.path for x in g.nodes if x.split}


@pytest.mark.parametrize("top", [1 << 20, 1 << 40])
def test_sums_of_a_block_are_exact(top):
    rng = np.random.RandomState(5)
    place, slot = rng.randint(0, 4, (1000, 3)) + np.array([0, 4, 8]), rng.randint(0, 5, 1000)
    g = rng.randint(-top, top, 1000)
    total, count = BO._sums(place, slot, g, 5, 12)
    for s in range(5):
        for b in range(12):
            own = (slot == s) & (place == b).any(axis=1)
            assert (total[s, b], count[s, b]) == (g[own].sum(), own.sum())


def test_rows_end_where_single_steps_lead_them():
    rng = np.random.RandomState(7)
    feature = np.array([1, 0, -1, 2, -1, -1, 0, -1, -1])
    left, right = np.array([1, 3, -1, 5, -1, -1, 7, -1, -1]), np.array([2, 4, -1, 6, -1, -1, 8, -1, -1])
    sets, bins = rng.rand(9, 256) < 0.5, rng.randint(0, 256, (500, 3)).astype(np.uint8)
    at = BO._walk(feature, sets, left, right, 5, bins)
    for x, end in zip(bins, at):
        i = 0
        while feature[i] >= 0:
            i = left[i] if sets[i, x[feature[i]]] else right[i]
        assert i == end


def test_blocks_of_a_round_hold_its_predictions(spark):
    rows = spark.range(0, 3000, 1, 3).select(F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x"), (F.col("id") % 13 * 4e6).alias("price"))
    bins = BO.find_bins(rows, ["x"], {})
    params = [BO.Params(max_iter=5, max_leaf_nodes=6), BO.Params(max_iter=2, max_leaf_nodes=3, learning_rate=0.5)]
    fits, state = BO.grow(BO._written(BO.pack(rows, bins, "price", 2)), bins, params, keep_every=3)
    for r in state.collect():
        b = np.frombuffer(r["bins"], np.uint8).reshape(r["n"], 1)
        scores = BO._whole(r["score"], 2 * r["n"]).reshape(2, r["n"])
        for fit, own in zip(fits, scores):
            assert (own / BO.GRID == fit.predict(b)).all()


@pytest.mark.parametrize("values", ["few", "spread"])
def test_many_ranks_are_exact(spark, values):
    rng = np.random.RandomState(11)
    x = rng.randint(0, 40, 60_000) / 4 if values == "few" else rng.lognormal(3, 2, 60_000)
    df = spark.createDataFrame([(float(v), None if i % 7 == 0 else float(-v)) for i, v in enumerate(x)] + [(float("nan"), None)], "a double, b double").repartition(5)
    probs = [k / 64 for k in range(1, 64)]
    got = ST.ranked_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, probs)
    y = np.array([-v for i, v in enumerate(x) if i % 7])
    for c, v in (("a", x), ("b", y)):
        assert np.allclose(got[c].values, np.quantile(v, probs), rtol=1e-12, atol=0)
        assert got[c].below == [int((v < q).sum()) for q in got[c].values]
        assert (got[c].n, got[c].rows) == (len(v), 60_001)


def test_many_brackets_are_counted_without_a_sum_for_each(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ST, "_inside_many", lambda vals, b, run=ST._inside_many: seen.append(max(map(len, b.values()))) or run(vals, b))
    df = spark.range(50_000).select(F.col("id").cast("double").alias("a"))
    assert ST.exact_quantiles(df, "a", [k / 64 for k in range(1, 64)])[31] == 24999.5
    assert seen == [63]


def test_a_split_is_written_without_a_sort(spark, tmp_path):
    from pricewise.operators import split as SP
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 97).cast("double").alias("price"))
    name, plans = "spark.sql.maxConcurrentOutputFileWriters", []
    before = spark.conf.get(name)
    df = SP.split(rows, "k")

    class Writer:
        def __getattr__(self, _):
            return lambda *a: plans.append(spark.conf.get(name)) or self

    class Rows:
        sparkSession, write = spark, Writer()

    SP.write_split(Rows(), "nowhere")
    assert all(int(n) >= 2 for n in plans) and spark.conf.get(name) == before
    SP.write_split(df, f"file://{tmp_path}/split")
    back = SP.read_split(spark, f"file://{tmp_path}/split")
    assert spark.conf.get(name) == before
    assert sorted(map(tuple, back.select("k", "split").collect())) == sorted(map(tuple, df.select("k", "split").collect()))
    assert all(".zstd." in f for f in back.inputFiles())


def test_permuted_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    from pricewise.operators import evaluate as EV
    rows = spark.range(400).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).cast("double").alias("x"),
                                   (F.col("id") % 5).cast("double").alias("y"), (F.col("id") % 11).cast("double").alias("price"))
    run = lambda: sorted(map(tuple, EV.permutation_importance(
        rows, "k", ["x", "y"], lambda df: df.withColumn("prediction", F.col("x") + F.col("y")), repeats=3).select(
        "feature", F.round("importance_mean", 9), F.round("importance_std", 9)).collect()))
    asked, before = [], run()
    ranked = EV.global_row_number
    monkeypatch.setattr(EV, "global_row_number", lambda *a, **b: asked.append(b["num_partitions"]) or ranked(*a, **b))
    monkeypatch.setattr(EV, "PERMUTED_ROWS", 40)
    assert run() == before
    assert asked == [10, 30]


def test_draws_beyond_the_budget_grow_in_steps(spark, monkeypatch):
    """Batches of draws, several passes for the sums of a level and more tasks give the same errors, and no task sees more than its share."""
    rows = spark.range(0, 2400, 1, 2).select(F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(31)).cast("double").alias("z"),
                                             (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") % 13 + F.pmod(F.xxhash64("id"), F.lit(97))).cast("double").alias("price"))
    bins = BO.find_bins(rows, ["x", "z"], {})
    draws = [BO.Params(0.3, 1 + i, 12, None, 5, 0.5) for i in range(4)]
    want = BO.cross_validate(rows, bins, draws)
    seen, tasks, grow, spread = [], [], BO.grow, BO._spread

    def noted(state, bins, models, **more):
        seen.append([p.max_iter for p in models])
        return grow(state, bins, models, **more)

    def dealt(state, cells, blocks):
        out = spread(state, cells, blocks)
        tasks.append((cells, out[1]))
        return out

    monkeypatch.setattr(BO, "grow", noted)
    monkeypatch.setattr(BO, "_spread", dealt)
    monkeypatch.setattr(BO, "BLOCK", 100)
    monkeypatch.setattr(BO, "CORE_CELLS", 2 * 5 * 2400 // spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(BO, "TASK_CELLS", 100)
    monkeypatch.setattr(BO, "MOST_TASK_CELLS", 3000)
    monkeypatch.setattr(BO, "SUM_BYTES", 3 * 16 * int(bins.sizes.sum()))
    assert BO.cross_validate(rows, bins, draws) == want
    assert seen == [[4] * 5 + [3] * 5, [2] * 5 + [1] * 5]
    assert all(cells <= 3000 * n for cells, n in tasks)


def test_the_sums_of_a_sibling_come_from_the_parent(spark, monkeypatch):
    """Where sums meet on the driver, the tasks sum one node of two, and the trees stay the same."""
    rows = spark.range(0, 3000, 1, 3).select(F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(53)).cast("double").alias("z"),
                                             F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1009)).cast("double").alias("price"))
    bins = BO.find_bins(rows, ["x", "z"], {})
    asked, summed = [], BO.Grower.summed
    monkeypatch.setattr(BO.Grower, "summed", lambda g, i, known: asked.append((i, summed(g, i, known))) or asked[-1][1])
    params = BO.Params(max_iter=2, max_leaf_nodes=12, min_samples_leaf=5)
    near = BO.fit(rows, bins, params)
    assert any(a != b for a, b in asked) and len({b for _, b in asked}) < len({a for a, _ in asked})
    monkeypatch.setattr(BO, "DIRECT_NODES", 0)
    far = BO.fit(rows, bins, params)
    assert near.base == far.base and len(near.trees) == len(far.trees) == 2
    for a, b in zip(near.trees, far.trees):
        assert all((getattr(a, c) == getattr(b, c)).all() for c in ("feature", "left_bins", "left", "right", "value", "n", "total"))


def test_texts_move_once_and_written_records_are_packed(spark, tmp_path):
    """Replies are sorted after the shuffle by key only, losers leave their text behind, and records are written packed, without a sort by success."""
    from pricewise.operators import extract as EX
    rows = [("a", 1, "bad"), ("a", 2, '{"price": 5}'), ("b", 1, "bad"), ("b", 2, "still bad"), ("c", 1, '{"price": 1}'), ("c", 2, '{"price": 2}'), (None, 1, '{"price": 7}')]
    df = spark.createDataFrame(rows, "image_path string, attempt int, raw_text string")
    first = EX.first_valid(EX.clean_attempts(df))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort [" not in plan[plan.index("Exchange"):]
    records = EX.extract_records(df)
    EX.write_records(records, f"file://{tmp_path}/records", runs=f"file://{tmp_path}/runs")
    back = EX.read_written_records(spark, f"file://{tmp_path}/records")
    assert all(f.endswith(".json.gz") for f in back.inputFiles())
    cols = ["image_path", "success", "error", "runtime_s", "attempts_used", "raw_text", "parsed_json.price"]
    assert sorted(map(str, back.select(*cols).collect())) == sorted(map(str, records.select(*cols).collect()))
    assert spark.read.parquet(f"file://{tmp_path}/runs").first()["metrics"]["total_images"] == 4
