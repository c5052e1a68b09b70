import os
import tempfile

import pytest
from pyspark.sql import types as T

from bitext.sources.bitext_io import check_columns, read_bitext_csv, read_results_csv, write_csv
from bitext.sources.lines import read_aligned, write_lines


def _tmp():
    return tempfile.mkdtemp(prefix="bitext-test-", dir="/tmp")


def test_csv_round_trip_with_commas_quotes_newlines(spark):
    rows = [(1, "ai", 'a, "quoted" b', "line\nbreak"), (2, "ai", "plain", "x,y")]
    df = spark.createDataFrame(rows, "row_id long, corpus string, src string, tgt string")
    out = os.path.join(_tmp(), "c")
    write_csv(df.select("row_id", df.src.alias("left"), df.tgt.alias("right")), out)
    back = read_bitext_csv(spark, out, "left", "right", "ai", id_col="row_id")
    assert sorted((r.row_id, r.src, r.tgt) for r in back.collect()) == [(1, rows[0][2], rows[0][3]), (2, "plain", "x,y")]


def test_missing_columns_raise(spark):
    df = spark.createDataFrame([(1, "a")], "row_id long, Content string")
    with pytest.raises(ValueError, match="Translation"):
        check_columns(df, ["Content", "Translation"])


def test_ragged_results_kept_as_corrupt(spark):
    path = os.path.join(_tmp(), "r.csv")
    with open(path, "w") as f:
        f.write("patience,units,bleu_score\n3,128,0.1\n5,256,0.2,extra,fields\n")
    schema = T.StructType([
        T.StructField("patience", T.IntegerType()),
        T.StructField("units", T.IntegerType()),
        T.StructField("bleu_score", T.DoubleType()),
    ])
    df = read_results_csv(spark, path, schema).cache()
    rows = sorted(df.collect(), key=lambda r: r.patience)
    assert rows[0]._corrupt_record is None
    assert rows[1]._corrupt_record is not None


def test_aligned_lines_round_trip(spark):
    df = spark.createDataFrame(
        [(i, "ai", f"src {i}, with comma", f"tgt {i}") for i in range(50)], "row_id long, corpus string, src string, tgt string"
    )
    prefix = os.path.join(_tmp(), "valid")
    write_lines(df, prefix)
    back = read_aligned(spark, prefix + ".src", prefix + ".tgt", "ai")
    got = sorted((r.row_id, r.src, r.tgt) for r in back.collect())
    assert got == [(i, f"src {i}, with comma", f"tgt {i}") for i in range(50)]


def test_line_numbers_over_splits_and_files(spark):
    from bitext.sources.lines import read_lines

    folder = _tmp()
    for name, n in (("b", 700), ("a", 500), ("c", 0)):
        with open(os.path.join(folder, name), "w") as f:
            f.writelines(f"{name} {i}\n" for i in range(n))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((r.line_no, r.text) for r in read_lines(spark, folder).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == list(enumerate([f"a {i}" for i in range(500)] + [f"b {i}" for i in range(700)]))


def test_quoted_lines_are_decoded(spark):
    d = _tmp()
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write('"a, b"\nplain\n"say ""hi"""\n')
    with open(os.path.join(d, "b.txt"), "w") as f:
        f.write("x\ny\nz\n")
    back = read_aligned(spark, os.path.join(d, "a.txt"), os.path.join(d, "b.txt"), quoted=True)
    assert [r.src for r in back.orderBy("row_id").collect()] == ["a, b", "plain", 'say "hi"']


def test_unequal_line_counts_raise(spark):
    d = _tmp()
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write("1\n2\n")
    with open(os.path.join(d, "b.txt"), "w") as f:
        f.write("1\n")
    with pytest.raises(ValueError):
        read_aligned(spark, os.path.join(d, "a.txt"), os.path.join(d, "b.txt"))


def test_save_datasets_and_append(spark):
    from bitext.sources.bitext_io import append_results
    from bitext.sources.lines import save_datasets

    rows = [(i, "ai", f"s {i}", f"t, {i}", ["train", "valid", "test"][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, corpus string, src string, tgt string, split string")
    out = _tmp()
    save_datasets(df, out, "set3")
    back = spark.read.parquet(f"{out}/set3.parquet")
    assert back.count() == 30 and {r.split for r in back.select("split").distinct().collect()} == {"train", "valid", "test"}
    lines = spark.read.text(f"{out}/set3_valid.tgt").collect()
    assert sorted(r.value for r in lines) == sorted(f"t, {i}" for i in range(30) if i % 3 == 1)
    # the sides of a split are aligned, part by part, and in row order
    for name, rest in (("train", 0), ("valid", 1), ("test", 2)):
        sides = []
        for side in ("src", "tgt"):
            folder = f"{out}/set3_{name}.{side}"
            sides.append([open(os.path.join(folder, f)).read().splitlines() for f in sorted(os.listdir(folder)) if f.startswith("part")])
        assert list(map(len, sides[0])) == list(map(len, sides[1]))
        assert [x for part in sides[0] for x in part] == [f"s {i}" for i in range(30) if i % 3 == rest]
        assert [x for part in sides[1] for x in part] == [f"t, {i}" for i in range(30) if i % 3 == rest]
    res = spark.createDataFrame([(3, 0.1)], "patience int, bleu double")
    append_results(res, f"{out}/results")
    append_results(res, f"{out}/results")
    assert spark.read.parquet(f"{out}/results").count() == 2


def test_fixed_length_assertion(spark):
    from bitext.operators.clean import assert_fixed_length

    ok = spark.createDataFrame([([1, 2, 0],), ([3, 0, 0],)], "ids array<int>")
    assert_fixed_length(ok, "ids", 3)
    bad = spark.createDataFrame([([1, 2],)], "ids array<int>")
    with pytest.raises(ValueError):
        assert_fixed_length(bad, "ids", 3)


def test_na_values_and_csv_append(spark):
    from bitext.sources.bitext_io import append_results_csv

    out = os.path.join(_tmp(), "n")
    one = spark.createDataFrame([(1, "n/a", "x"), (2, "b", "-")], "row_id long, l string, r string")
    append_results_csv(one, out)
    append_results_csv(spark.createDataFrame([(3, "c, d", 'q"')], "row_id long, l string, r string"), out)
    back = read_bitext_csv(spark, out, "l", "r", "ai", id_col="row_id", na_values=["n/a", "-"], multi_line=False)
    assert sorted((r.row_id, r.src, r.tgt) for r in back.collect()) == [(1, None, "x"), (2, "b", None), (3, "c, d", 'q"')]


def test_save_by_ratio(spark):
    from bitext.sources.bitext_io import save_by_ratio

    rows = [(i, "ai", "a b c d", " ".join("x" * n)) for i, n in enumerate([4, 3, 5, 2, 4, 5, 9])]
    out = os.path.join(_tmp(), "s")
    save_by_ratio(spark.createDataFrame(rows, "row_id long, corpus string, src string, tgt string"), out)
    parts = [open(os.path.join(out, f)).read().splitlines() for f in sorted(os.listdir(out)) if f.startswith("part")]
    assert [line.split(",")[0] for part in parts for line in part[1:]] == ["2", "5", "0", "4"]
