from pyspark.sql import functions as F

from bitext.functions import ids as idf


def _arr(spark, value, expr, typ="array<int>"):
    df = spark.createDataFrame([(value,)], f"a {typ}")
    return df.select(expr(F.col("a")).alias("o")).first()["o"]


def test_pad_truncate_post_and_pre(spark):
    assert _arr(spark, [5, 6], lambda c: idf.pad_truncate(c, 4)) == [5, 6, 0, 0]
    assert _arr(spark, [5, 6, 7, 8], lambda c: idf.pad_truncate(c, 4)) == [5, 6, 7, 8]
    assert _arr(spark, [1, 2, 3, 4, 5, 6], lambda c: idf.pad_truncate(c, 4)) == [1, 2, 3, 4]
    assert _arr(spark, [1, 2, 3, 4, 5, 6], lambda c: idf.pad_truncate(c, 4, "pre")) == [3, 4, 5, 6]
    assert _arr(spark, [1, 2], lambda c: idf.pad_truncate(c, 4, "pre")) == [1, 2, 0, 0]


def test_mask_example(spark):
    # the hand example of the reference's padding-mask draft
    assert _arr(spark, [7, 6, 0, 0, 1], idf.padding_mask) == [0.0, 0.0, 1.0, 1.0, 0.0]
    assert _arr(spark, [1, 2, 3, 0, 0], idf.padding_mask) == [0.0, 0.0, 0.0, 1.0, 1.0]


def test_teacher_forcing_shift(spark):
    assert _arr(spark, [2, 10, 11, 3, 0], idf.decoder_input) == [2, 10, 11, 3]
    assert _arr(spark, [2, 10, 11, 3, 0], idf.shifted_label) == [10, 11, 3, 0]
    assert _arr(spark, [], idf.decoder_input) == []


def test_strip(spark):
    assert _arr(spark, [4, 0, 5, 0], idf.strip_pad) == [4, 5]
    got = _arr(spark, ["[start]", "a", "a", "[end]"], lambda c: idf.strip_values(c, ["[start]", "[end]"]), "array<string>")
    assert got == ["a", "a"]


def test_batches_and_back(spark):
    from bitext.operators.batches import batch, unbatch

    df = spark.range(0, 23).selectExpr("id", "id * 2 as v")
    whole = batch(df, ["id"], 5)
    assert sorted((r.batch, len(r.rows)) for r in whole.collect()) == [(0, 5), (1, 5), (2, 5), (3, 5), (4, 3)]
    assert sorted(unbatch(whole).collect()) == sorted(df.collect())
    full = batch(df, ["id"], 5, drop_remainder=True)
    assert full.count() == 4 and unbatch(full).count() == 20
