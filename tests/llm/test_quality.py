import numpy as np
from pyspark.sql import functions as F

from bitext.llm import quality as ql
from bitext.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_scores_equal_one_by_one_voting():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["the", "of", "Water", "X!!", "a|b", "***"], 30)) for _ in range(60)]
    weights = np.stack([ql.term_weights(t) for t in texts])
    labels = rng.integers(0, 2, 60).astype(np.float32)
    model = ql.Model(weights, labels)
    got = model.scores(texts[:20] + ["", "qq ww"])
    for t, score in zip(texts[:20], got):
        v = ql.term_weights(t) @ model.project
        cos = [max(0.0, float(v @ n / np.linalg.norm(v))) for n in model.near]
        best = sorted(range(60), key=lambda i: -cos[i])[: ql.NEIGHBOURS]
        edge = cos[best[-1]]
        exp = sum(cos[i] ** 4 * labels[i] for i in best) / sum(cos[i] ** 4 for i in best)
        ties = [i for i in range(60) if abs(cos[i] - edge) < 1e-6]
        assert abs(exp - score) < 1e-3 or len(ties) > 1
    assert got[20] == np.float64(labels.mean())
    assert ((0 <= got) & (got <= 1)).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = ql.fit(docs, labels)
    assert not any(n in ql.Model.scores.__code__.co_names for n in ("lang", "source"))
    got = ql.with_score(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.score >= ql.PASS_SCORE) == bool(r.quality) for r in got]) >= 0.95


def test_filter_and_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, 0.5, "a"), (1, "x y", 0.5, "b"), (None, "a " * 60_000, 0.1, "c"), (2, "x y", 0.5, "b")],
        "doc_id long, text string, score double, label string",
    )
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert ql.accepted(docs, none).count() == 0  # every score is 0.5
    good = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, None), (None, 0)], "doc_id long, quality int")
    kept = ql.accepted(docs, good)
    assert kept.columns == docs.columns and kept.count() == 4
    assert ql.accepted(docs.limit(0), good).count() == 0


def test_sample_is_bounded_and_leaves_the_held_out_part(spark):
    from bitext.llm.labelled import training_rows

    docs = spark.range(500).selectExpr("id as doc_id", "'t' as text")
    labels = spark.range(500).selectExpr("id as doc_id", "1 as quality")
    assert training_rows(docs, labels, "quality", 100).count() == 100
    assert training_rows(docs, labels, "quality", 10**6).filter(held_out(F.col("doc_id"))).count() == 0
