from bitext.operators import experiments as ex


def _hist(spark, rows):
    return spark.createDataFrame(rows, "run_id long, epoch int, loss double, val_loss double")


def test_early_stop_ties_are_not_improvements(spark):
    vals = [1.0, 0.9, 0.9, 0.9, 0.95, 0.8, 0.8]
    h = _hist(spark, [(1, e + 1, v, v) for e, v in enumerate(vals)])
    r = ex.early_stop(h, (2, 3, 10)).first()
    # best at epoch 2; epochs 3 and 4 do not improve -> stop at 4 with patience 2
    assert r.stop_p2 == 4
    assert r.stop_p3 == 5
    assert r.stop_p10 is None
    assert r.last_epoch == 7


def test_best_epoch_earliest_on_ties_and_within_stop(spark):
    vals = [1.0, 0.5, 0.7, 0.5, 0.9, 0.9, 0.9, 0.1]
    h = _hist(spark, [(1, e + 1, v, v) for e, v in enumerate(vals)])
    stops = ex.early_stop(h, (3,))
    r = ex.best_epoch(h, stops, "stop_p3").first()
    assert (r.best_epoch, r.best_val_loss) == (2, 0.5)


def test_grid_is_full_product(spark):
    runs = spark.range(0, 288).withColumnRenamed("id", "run_id")
    res = ex.assign_params(runs)
    grid = ex.param_grid(res)
    assert grid.count() == 288
    assert grid.select("key").distinct().count() == 288
    assert res.select(ex.experiment_key().alias("k")).first().k.startswith("patience=3_units=128_learning_rate=0.001_")


def test_early_stop_hot_run_matches_window_brute_force(spark):
    """One run holds most epochs; the scans split it over many buckets."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rnd = random.Random(11)
    rows = []
    for run, n in [(0, 2500), (1, 40), (2, 300), (3, 7)]:
        best = 10.0
        for e in range(1, n + 1):
            v = round(best + rnd.uniform(-0.3, 0.6), 2)
            best = min(best, v)
            rows.append((run, e, v * 0.9, v))
    h = spark.createDataFrame(rows, "run_id long, epoch int, loss double, val_loss double")
    got = {r.run_id: r for r in ex.early_stop(h, (3, 10, 5000)).collect()}
    w = Window.partitionBy("run_id").orderBy("epoch")
    a = h.withColumn("pm", F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    a = a.withColumn(
        "li", F.max(F.when(F.col("pm").isNull() | (F.col("val_loss") < F.col("pm")), F.col("epoch"))).over(
            w.rowsBetween(Window.unboundedPreceding, 0)
        )
    )
    exp = a.groupBy("run_id").agg(
        F.max("epoch").alias("last_epoch"),
        *[F.min(F.when(F.col("epoch") - F.col("li") >= p, F.col("epoch"))).alias(f"stop_p{p}") for p in (3, 10, 5000)],
    )
    for r in exp.collect():
        g = got[r.run_id]
        assert (g.last_epoch, g.stop_p3, g.stop_p10, g.stop_p5000) == (r.last_epoch, r.stop_p3, r.stop_p10, r.stop_p5000)


def test_grid_from_lists_is_in_product_order(spark):
    import itertools

    values = {"patience": [3, 5], "units": [128], "regularizer": [None, "l2"], "dropout": [0.3, 0.5, 0.7]}
    rows = ex.grid_from_values(spark, values).orderBy("grid_idx").collect()
    assert [tuple(r[k] for k in values) for r in rows] == list(itertools.product(*values.values()))
    assert rows[0].key == "patience=3_units=128_regularizer=None_dropout=0.3"


def test_states_equal_a_walk_over_the_history(spark, monkeypatch):
    """Segments of three epochs, gaps between epochs, ties, missing values."""
    import random

    from bitext.operators import experiments as ex

    monkeypatch.setattr(ex, "SEGMENT", 3)
    rnd = random.Random(8)
    rows = []
    for run in range(40):
        epochs = sorted(rnd.sample(range(1, 60), rnd.randint(1, 40)))
        falling = run % 4 == 0
        for i, e in enumerate(epochs):
            v = None if rnd.random() < 0.05 else float(-i if falling else rnd.randint(0, 9))
            rows.append((run, e, float(e), v))
    df = spark.createDataFrame(rows, "run_id long, epoch int, loss double, val_loss double").repartition(5)
    got = {r.run_id: r for r in ex.run_stops(df, (2, 5)).collect()}
    for run in range(40):
        best = at = None
        stops, state = {}, None
        for _, e, loss, v in sorted(r for r in rows if r[0] == run):
            if v is not None and (best is None or v < best):
                best, at = v, e
            state = (e, loss, v, at, best)
            for p in (2, 5):
                if p not in stops and at is not None and e - at >= p:
                    stops[p] = state
        assert tuple(got[run].end) == state
        for p in (2, 5):
            assert (tuple(got[run][f"at_p{p}"]) if got[run][f"at_p{p}"] else None) == stops.get(p)
