import math
import os
import random
import tempfile

import numpy as np

from bitext.operators import measure as me
from bitext.operators import metrics as mt
from bitext.operators.predict import BigramStep, LookupPredictor, decode_loop, predict_with


def test_decode_loop_equals_row_by_row(spark):
    rnd = random.Random(4)
    table = {i: rnd.randrange(0, 30) for i in range(25)}
    rows = [(i, [rnd.randrange(1, 28) for _ in range(rnd.randrange(0, 5))]) for i in range(200)] + [(900, None)]
    df = spark.createDataFrame(rows, "k long, ids array<int>").repartition(3)
    shared = spark.sparkContext.broadcast(table)
    got = decode_loop(df, ["k"], "ids", lambda: BigramStep(shared.value, 3), 2, 3, 12, batch_size=16).collect()

    def one(ids):
        last, out = (ids or [0])[0], []
        while len(out) < 12:
            last = table.get(last, 3)
            if last == 3:
                break
            out.append(last)
        return out

    # a batch with ids pads the others with 0, as an empty input
    assert {r.k: r.ids for r in got} == {k: one(ids) for k, ids in rows}
    none = spark.createDataFrame([], "k long, ids array<int>")
    assert decode_loop(none, ["k"], "ids", lambda: BigramStep({}, 3), 2, 3, 12).count() == 0


def test_a_step_sees_unfinished_rows_only_and_the_model_is_built_once(spark):
    folder = tempfile.mkdtemp(prefix="bitext-test-", dir="/tmp")

    def make():
        open(os.path.join(folder, f"{os.getpid()}-{random.random()}"), "w").close()

        def step(inputs, prefix):
            assert len(inputs) == len(prefix) and (prefix[:, 1:] != 7).all() and (inputs[:, 0] >= prefix.shape[1] - 1).all()
            return np.where(inputs[:, 0] <= prefix.shape[1] - 1, 7, 5)

        return step

    df = spark.range(300, numPartitions=6).selectExpr("id as k", "array(int(id % 9)) as ids")
    got = decode_loop(df, ["k"], "ids", make, 1, 7, 20, batch_size=10).collect()
    assert {r.k: r.ids for r in got} == {k: [5] * (k % 9) for k in range(300)}
    built = os.listdir(folder)
    assert len(built) == len({x.split("-")[0] for x in built})  # once per worker, not per batch


def test_factory_is_called_once_per_worker(spark):
    folder = tempfile.mkdtemp(prefix="bitext-test-", dir="/tmp")

    def make():
        open(os.path.join(folder, f"{os.getpid()}-{random.random()}"), "w").close()
        return LookupPredictor({1: 10, 2: 20}, 0)

    df = spark.range(500, numPartitions=8).selectExpr("id as k", "array(int(id % 3), 2) as ids")
    got = {r.k: r.pred_ids for r in predict_with(df, ["k"], "ids", make, 2, batch_size=7).collect()}
    assert got == {k: [[0, 10, 20][k % 3], 20] for k in range(500)}
    built = os.listdir(folder)
    assert len(built) == len({x.split("-")[0] for x in built})


def test_loss_from_scores(spark):
    rnd = random.Random(6)
    steps, labels, want = [], [], []
    for pair in range(20):
        for step in range(5):
            scores = {t: rnd.choice([-1000.0, 1000.0, 0.0, rnd.uniform(-1000, 1000)]) for t in rnd.sample(range(1, 50), 8)}
            steps += [(pair, step, t, x) for t, x in scores.items()]
            real = 0 if step == 3 else rnd.choice(list(scores))
            labels.append((pair, step, real))
            if real:
                top = max(scores.values())
                want.append(top + math.log(sum(math.exp(x - top) for x in scores.values())) - scores[real])
    s = spark.createDataFrame([*steps, (0, 0, 99, None)], "pair_id long, step int, token_id int, score double").repartition(5)
    lab = spark.createDataFrame(labels, "pair_id long, step int, real_id int")
    got = mt.masked_loss(mt.step_loss(lab, s)).first()
    assert (got.n_tokens, got.n_real) == (100, 80)
    assert math.isclose(got.loss, sum(want) / 80, rel_tol=1e-9, abs_tol=1e-6)
    assert math.isclose(got.loss_all, sum(want) / 100, rel_tol=1e-9, abs_tol=1e-6)
    lost = spark.createDataFrame([(0, 0, 1000)], "pair_id long, step int, real_id int")
    assert mt.step_loss(lost, s).first().loss == math.inf


def test_length_quantiles(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(0, 40), None if i % 50 == 0 else rnd.randrange(0, 9)) for i in range(997)]
    df = spark.createDataFrame(rows, "a int, b int")
    qs = {"low": 0.0, "p50": 0.5, "p99": 0.99, "all": 1.0}
    got = {r.side: r for r in me.length_quantiles(df, {"a": "a", "b": "b"}, qs).collect()}
    for i, side in enumerate("ab"):
        vals = sorted(r[i] for r in rows if r[i] is not None)
        assert got[side].n == len(vals)
        assert [got[side][q] for q in qs] == [vals[max(1, math.ceil(x * len(vals))) - 1] for x in qs.values()]
    rough = {r.side: r for r in me.length_quantiles(df, {"a": "a", "b": "b"}, qs, approx=True).collect()}
    assert abs(rough["a"].p50 - got["a"].p50) <= 1
