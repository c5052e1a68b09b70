import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitext.llm import toxicity as tx
from bitext.llm.common import held_out

SF = "/root/testdata/sf0.01"


def _features(word):
    """All subsequences of three characters, one by one."""
    chars = "\x02" + word + "\x03"
    out = {}
    for i, j, k in itertools.combinations(range(len(chars)), 3):
        if k - i <= 4:
            u = chars[i] + chars[j] + chars[k]
            out[u] = out.get(u, 0) + tx.DECAY ** (k - i - 2)
    return out


def _kernel(a, b):
    x, y = _features(a), _features(b)
    dot = sum(v * y.get(u, 0) for u, v in x.items())
    return (dot / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))) ** tx.POWER


def test_kernel_equals_the_definition():
    marks = tx.Landmarks(["idiot", "clown", "aaaa", "été"])
    words = ["idiot", "idxiot", "clwn", "aaa", "aaaaaa", "thé", "zzz", "moron"]
    exp = [[_kernel(w, m) for m in marks.words] for w in words]
    assert np.allclose(marks.kernel(words), exp)


def test_words():
    assert tx.words_of("You i d i o t, st*up-id no") == ["you", "idiot", "stupid"]
    assert tx.words_of("  ") == [] and tx.sentences_of("") == []


def test_learns_and_tolerates_gaps():
    rng = np.random.default_rng(5)
    plain = ["there", "house", "water", "green", "reading", "mountain", "paper", "walking", "silver", "garden"]
    texts, toxic = [], []
    for i in range(300):
        words = rng.choice(plain, 30).tolist()
        if i % 3 == 0:
            words[int(rng.integers(30))] = str(rng.choice(["idiot", "clown"]))
        texts.append(" ".join(words[:15]) + ". " + " ".join(words[15:]))
        toxic.append(int(i % 3 == 0))
    marks = tx.Landmarks(["idiot", "clown", "garden", "water"])
    model = tx.Model(marks, marks.sentences(texts), np.array(toxic), ["idiot", "clown"])
    scores = model.scores(texts)
    assert ((scores >= tx.TOXIC_SCORE) == np.array(toxic, bool)).mean() > 0.98
    bad = model.scores(["that c l o w n there", "such an id-iot", "cl.own", "IDIOT"])
    good = model.scores(["green water", "", "the reading house", "?"])
    assert bad.min() > tx.TOXIC_SCORE > good.max()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fit(docs, labels)
    got = tx.with_score(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    right = np.mean([(r.score >= tx.TOXIC_SCORE) == bool(r.toxic) for r in got])
    assert right >= 0.9


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(1, None)]])
def test_edge_cases(spark, rows):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "x y", 0.5), (None, "a" * 10_000, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    assert model is None
    assert [r.toxicity for r in tx.with_score(docs, model, out="toxicity").collect()] == [0.0] * 3
    marks = tx.Landmarks(["idiot"])
    some = tx.Model(marks, marks.sentences(["idiot here", "water"]), np.array([1, 0]))
    got = tx.with_score(docs, some, out="toxicity").collect()
    assert len(got) == 3 and all(0 <= r.toxicity <= 1 for r in got)
    assert tx.with_score(docs.limit(0), some, out="toxicity").count() == 0


def test_held_out_recall_and_precision(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.select("doc_id", "text").join(labels, "doc_id")
    model = tx.fit(docs, labels)
    got = tx.with_score(known.filter(held_out(F.col("doc_id"))).select("doc_id", "text", "toxic"), model).collect()
    said, toxic = np.array([r.score >= tx.TOXIC_SCORE for r in got]), np.array([bool(r.toxic) for r in got])
    assert toxic.sum() > 50
    assert (said & toxic).sum() / toxic.sum() >= 0.85 and (said & toxic).sum() / said.sum() >= 0.85


def test_features_and_scores_one_by_one(monkeypatch):
    """Words are remembered, dropped and gathered by rows; each sentence by itself gives the same."""
    import random

    rnd = random.Random(5)
    marks = tx.Landmarks(["idiot", "moron", "stupid"])
    words = ["idiot", "id1ot", "i.d.i.o.t", "idi0t", "moroon", "stu-pid", "good", "day", "x" * 70 + "idiot", "ok"]
    texts = [". ".join(" ".join(rnd.choice(words) + rnd.choice(["", "", "s", str(rnd.randrange(40))]) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 5))) for _ in range(120)]
    monkeypatch.setattr(tx, "_CACHE", 20)
    got = [r for i in range(0, len(texts), 10) for r in marks.sentences(texts[i : i + 10])]
    for text, rows in zip(texts, got):
        want = []
        for sentence in tx.sentences_of(text):
            near = []
            for w in tx.words_of(sentence):
                value = np.max([v for v in marks.kernel(tx._pieces(w)) if v.max() >= tx.FLOOR] or [np.zeros(3)], axis=0)
                near += [value] if value.any() else []
            if near:
                want.append(np.max(near, axis=0))
        assert np.allclose(rows, np.array(want).reshape(-1, 3), atol=1e-6)
    toxic = np.array([int(any(len(r) and r.max() > 0.5 for r in [rows])) for rows in got])
    model = tx.Model(marks, got, toxic)
    for text, rows, score in zip(texts, got, model.scores(texts)):
        f = max([model.w[-1], *(float(r @ marks.root @ model.w[:-1]) + model.w[-1] for r in rows)])
        assert abs(score - 1 / (1 + np.exp(-(model.a * f + model.b)))) < 1e-5
