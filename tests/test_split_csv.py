import csv
import os
import random
import tempfile

import pytest

from bitext.sources.bitext_io import read_bitext_csv
from bitext.sources.split_csv import read_csv_in_splits, records


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["left side", "right"])
        w.writerows(rows)


def _rows(seed, n):
    rnd = random.Random(seed)
    cell = lambda: rnd.choice(
        ["plain", 'say "hi"', "a, b", "line\nbreak", 'x\n\n"\n', "é ü", '"', "word " * rnd.randint(1, 40), "\n".join("l" * 9 for _ in range(rnd.randint(2, 60)))]
    )
    return [(f"{i} {cell()}", cell()) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_equal_the_multi_line_reader(spark, small_splits, end):
    folder = tempfile.mkdtemp(prefix="bitext-test-", dir="/tmp")
    rows = [_rows(1, 300), _rows(2, 120), []]
    for i, part in enumerate(rows):
        _write(os.path.join(folder, f"{i}.csv"), part, end)
    assert records(spark, folder).rdd.getNumPartitions() >= 1
    assert spark.read.text(folder).rdd.getNumPartitions() > 10  # a file is many tasks
    got = read_csv_in_splits(spark, folder).orderBy("record_no").collect()
    assert [(r["left side"], r["right"]) for r in got] == [tuple(r) for part in rows for r in part]
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(folder).collect()
    assert sorted(map(tuple, whole)) == sorted((r["left side"], r["right"]) for r in got)


def test_ragged_records_and_blank_lines(spark, small_splits):
    path = os.path.join(tempfile.mkdtemp(prefix="bitext-test-", dir="/tmp"), "r.csv")
    with open(path, "w") as f:
        f.write('a,b\n1,"x\ny"\n\n2\n3,4,5\n,""\n"6","7"')
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    got = read_csv_in_splits(spark, path).orderBy("record_no").select("a", "b").collect()
    assert sorted(map(str, got)) == sorted(map(str, whole.collect()))
    both = read_bitext_csv(spark, path, "a", "b", "ai", in_splits=True).orderBy("row_id").collect()
    assert [(r.src, r.tgt) for r in both][:2] == [("1", "x\ny"), ("2", None)]
    assert len({r.row_id for r in both}) == len(both)
