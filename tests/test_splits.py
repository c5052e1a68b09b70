from pyspark.sql import functions as F

from bitext.operators import split as sp


def _corpus(spark, name, n):
    return spark.createDataFrame([(i, name, f"s{i}", f"t{i}") for i in range(n)], "row_id long, corpus string, src string, tgt string")


def test_exact_sample_size_and_repeatability(spark):
    a = _corpus(spark, "ai", 500)
    s1 = sorted(r.row_id for r in sp.sample_exact(a, 123, 1).collect())
    s2 = sorted(r.row_id for r in sp.sample_exact(a.repartition(7), 123, 1).collect())
    assert len(s1) == 123 and s1 == s2


def test_fraction_split_sizes(spark):
    a = _corpus(spark, "ai", 101)
    got = {r.split: r["count"] for r in sp.split_fraction(a, 0.2, 42).groupBy("split").count().collect()}
    assert got == {"test": 21, "train": 80}


def test_recipe3_disjoint_and_covering(spark):
    a, b = _corpus(spark, "ai", 300), _corpus(spark, "pro", 80)
    s = sp.recipe_set3(a, b, 1, 200, 50)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 250, "valid": 100, "test": 30}
    assert s.select("corpus", "row_id").distinct().count() == 380


def test_recipe2_absolute_sizes(spark):
    a, b = _corpus(spark, "ai", 400), _corpus(spark, "pro", 60)
    s = sp.recipe_set2(a, b, 1, 100, 100)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 120, "valid": 100, "test": 100}
    train_ai = s.where((F.col("split") == "train") & (F.col("corpus") == "ai")).count()
    assert train_ai == 60


def test_cuts_equal_the_sorted_order(spark):
    from bitext.functions.hashing import stable_hash

    a = _corpus(spark, "ai", 700).unionByName(_corpus(spark, "pro", 300))
    order = [tuple(r) for r in a.select(stable_hash(5, *sp.KEY).alias("h"), *sp.KEY).orderBy("h", *sp.KEY).collect()]
    for n in (1, 2, 499, 999, 1000, 2000):
        got = {(r.corpus, r.row_id) for r in sp.sample_exact(a, n, 5).collect()}
        assert got == {x[1:] for x in order[:n]}
    plan = sp.sample_exact(a, 300, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_recipe2_refuses_too_few_rows(spark):
    import pytest

    with pytest.raises(ValueError):
        sp.recipe_set2(_corpus(spark, "ai", 50), _corpus(spark, "pro", 20), 1, 20, 20)
