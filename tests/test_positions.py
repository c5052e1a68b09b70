import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from bitext.operators.positions import Running, desc, row_positions, running


def _skewed(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if i % 2 == 0 else rnd.randint(1, 40)  # key 0 holds half the rows
        rows.append((key, i, rnd.random()))
    rows.append((None, n, 0.5))
    rows.append((None, n + 1, 0.25))
    return spark.createDataFrame(rows, "k long, t long, v double")


def test_positions_equal_row_number_under_skew(spark):
    df = _skewed(spark)
    got = row_positions(df, ["k"], ["t"], out="pos")
    w = Window.partitionBy("k").orderBy("t")
    exp = df.withColumn("pos", F.row_number().over(w) - 1)
    assert sorted(got.select("t", "pos").collect()) == sorted(exp.select("t", "pos").collect())


def test_global_positions_desc_order(spark):
    df = _skewed(spark)
    got = row_positions(df, [], [desc("v"), "t"], out="pos")
    exp = df.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("v"), "t")) - 1)
    assert sorted(got.select("t", "pos").collect()) == sorted(exp.select("t", "pos").collect())


def test_running_min_exclusive_and_max_inclusive(spark):
    df = _skewed(spark)
    got = running(
        df, ["k"], ["t"],
        [Running("pmin", "min", "v", inclusive=False), Running("rmax", "max", "v"), Running("s", "sum", "v")],
    )
    w = Window.partitionBy("k").orderBy("t")
    exp = df.select(
        "t",
        F.min("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("pmin"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rmax"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
    )
    a = {r["t"]: r for r in got.select("t", "pmin", "rmax", "s").collect()}
    for r in exp.collect():
        assert a[r["t"]]["pmin"] == r["pmin"]
        assert a[r["t"]]["rmax"] == r["rmax"]
        assert abs(a[r["t"]]["s"] - r["s"]) < 1e-9


def test_hot_key_spans_many_buckets(spark):
    from bitext.operators.positions import with_buckets

    df = _skewed(spark)
    b = with_buckets(df, ["k"], ["t"], buckets=8)
    n_buckets = b.where(F.col("k") == 0).select("__bucket").distinct().count()
    assert n_buckets >= 3


def test_buckets_come_from_the_row_count(spark, monkeypatch):
    from bitext.operators import positions

    monkeypatch.setattr(positions, "ROWS_PER_BUCKET", 200)
    df = _skewed(spark)
    got = row_positions(df, ["k"], ["t"], out="pos")
    assert positions.with_buckets(df, ["k"], ["t"]).select("__bucket").distinct().count() > 5
    w = Window.partitionBy("k").orderBy("t")
    exp = df.withColumn("pos", F.row_number().over(w) - 1)
    assert sorted(got.select("t", "pos").collect()) == sorted(exp.select("t", "pos").collect())
