"""Row-local look-ups, cuts and counts: a token is never a row of its own, and the
results are those of the paths that join tokens, keys that repeat or are null too."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from bitext.functions import text as tx
from bitext.operators import bleu as ob
from bitext.operators import bpe
from bitext.operators import vocab as vb
from bitext.operators.rows import words_of
from bitext.plans import q_models


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(spark, seed=3, n=3000, words="abcdefghijklmnopqrstuvwxyzé"):
    """Rows with keys that repeat and are null, empty and missing arrays."""
    rnd = random.Random(seed)
    text = lambda: [rnd.choice(words) * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 3, 9, 40]))]
    rows = [(None if i % 97 == 0 else i - i % 50 if i % 10 == 0 else i, text(), None if i % 31 == 0 else text()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, s array<string>, t array<string>").repartition(5)


def _same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_bleu_statistics_of_repeated_keys(spark):
    rows, df = _lines(spark, words="abcd")
    exp = {}
    for k, h, r in rows:
        at = exp.setdefault((k, len(h), None if r is None else len(r)), (Counter(), Counter()))
        for counts, toks in zip(at, (h, r or [])):
            for n in range(1, 5):
                counts.update((n, tuple(toks[i : i + n])) for i in range(len(toks) - n + 1))
    exp = {k: tuple(sum(min(c, cr[g]) for g, c in ch.items() if g[0] == n) for n in range(1, 5)) for k, (ch, cr) in exp.items()}
    got = ob.bleu_stats(df, "k", "s", "t")
    assert {(r.k, r.hyp_len, r.ref_len): (r.m1, r.m2, r.m3, r.m4) for r in got.collect()} == exp
    assert "Generate" not in _plan(got)  # no row per n-gram: those were sorted and spilled


def test_bleu_of_unique_rows_moves_none(spark):
    rows, _ = _lines(spark, words="abcd")
    df = spark.createDataFrame([(i, h, r) for i, (_, h, r) in enumerate(rows)], "k long, s array<string>, t array<string>")
    there = ob.bleu_stats(df, "k", "s", "t", unique=True)
    assert "Exchange" not in _plan(there) and _same(there, ob.bleu_stats(df, "k", "s", "t"))


def test_capped_look_ups_equal_the_joins(spark):
    _, df = _lines(spark)
    voc = spark.createDataFrame(vb.build_vocab(df, "s", max_tokens=40).collect(), "token string, freq long, id int")
    for drop in (False, True):
        looked_up, joined = (vb.encode(df, ["k"], "s", voc, drop_oov=drop, max_tokens=cap) for cap in (40, None))
        assert "Generate" not in _plan(looked_up) and "Join" not in _plan(looked_up)
        assert _same(looked_up, joined)
    assert _same(vb.encode(df, ["k"], "t", voc, max_tokens=40), vb.encode(df, ["k"], "t", voc))
    texts = [vb.decode(looked_up, ["k"], "ids", voc.where("id <> 7"), skip_ids=(0, 1), max_tokens=cap) for cap in (40, None)]
    assert "Generate" not in _plan(texts[0]) and _same(*texts)
    ids = df.select("k", F.transform("s", lambda x: F.length(x) * 20 + F.ascii(x) % 11).alias("ids"))  # repeated keys, unknown ids
    assert _same(*[vb.decode(ids, ["k"], "ids", voc, max_tokens=cap) for cap in (40, None)])
    unique = vb.decode(looked_up, ["k"], "ids", voc, max_tokens=40, unique=True)
    assert _same(unique, vb.decode(looked_up, ["k"], "ids", voc, max_tokens=40))


def test_cutting_in_the_task_equals_joining_words(spark, monkeypatch):
    _, df = _lines(spark)
    df = df.withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    words = df.select(F.explode(F.concat("s", "t")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    merges, seg = bpe.learn(words, 30)
    monkeypatch.setattr(bpe, "HEAD_WORDS", 10)  # the others are cut by the merges
    for mark in (None, bpe.CONTINUES):
        cut, joined = (bpe.segment_words(df, "k", {"a": F.col("s"), "b": F.col("t")}, seg, mark, m) for m in (merges, None))
        assert "Generate" not in _plan(cut) and "Join" not in _plan(cut)
        assert _same(cut, joined)


def test_dictionary_report_reads_its_splits_once(spark):
    rows = [("train", ["a", "b", "a"], ["x"]), ("train", ["c"], None), ("test", ["a", "d", "d"], ["x", "y"]), ("valid", [], ["y"])]
    splits = spark.createDataFrame(rows, "split string, s array<string>, t array<string>")
    got = vb.dictionary_report(splits, {"src": "s", "tgt": "t"})
    assert _plan(got).count("Scan ExistingRDD") == 1
    assert sorted(tuple(r) for r in got.collect()) == [
        ("test", "src", 1, 4, 2, 50.0, 3), ("test", "tgt", 1, 3, 1, 33.33, 1),
        ("train", "src", 2, 6, 0, 0.0, 3), ("train", "tgt", 2, 2, 0, 0.0, 1),
        ("valid", "src", 1, 1, 0, 0.0, 3), ("valid", "tgt", 1, 2, 1, 50.0, 1),
    ]


def test_texts_move_and_words_are_cut_where_they_arrive(spark):
    """The exchange carries the text of a line, not an array of its words."""
    rows = [(i % 3, "the cat  sat" if i % 2 else "the dog ran home", "the cat sat") for i in range(9)]
    df = spark.createDataFrame(rows, "k long, s string, t string")
    arrays = df.select("k", tx.words("s").alias("s"), tx.words("t").alias("t"))
    merges = [(1, "t", "h", 9), (2, "th", "e", 9)]
    seg = spark.createDataFrame([("the", 12), ("cat", 9)], "word string, freq long")
    moved = [
        (ob.bleu_stats(df, "k", tx.words("s"), tx.words("t")), ob.bleu_stats(arrays, "k", "s", "t")),
        (
            bpe.segment_words(df, "k", {"s": tx.words("s")}, seg, None, merges),
            bpe.segment_words(arrays, "k", {"s": F.col("s")}, seg, None, merges),
        ),
    ]
    for of_text, of_words in moved:
        plan = of_text._jdf.queryExecution().optimizedPlan().toString()  # from the top down
        before, after = plan.split("RepartitionByExpression")
        assert "regexp_extract_all" in before and "regexp_extract_all" not in after
        assert _same(of_text, of_words)


def test_sorted_rows_are_texts_not_arrays_of_words(spark):
    """Nothing that sorts, and so spills, holds a row's words: they are cut above the sort."""
    df = spark.createDataFrame([(i % 3, "the cat sat", "the dog sat") for i in range(9)], "k long, s string, t string")
    stats = ob.bleu_stats(df, "k", tx.words("s"), tx.words("t"))
    seg = spark.createDataFrame([("the", 12)], "word string, freq long")
    cut = bpe.segment_words(df, "k", {"s": tx.words("s")}, seg, None, [(1, "t", "h", 9)])
    for out in (stats, cut):
        plan = out._jdf.queryExecution().optimizedPlan().toString()  # from the top down
        above, below = plan.split("Sort [")
        assert "regexp_extract_all" in above and "regexp_extract_all" not in below
        assert "collect_list" not in plan


def test_rows_of_a_key_over_several_batches(spark):
    _, df = _lines(spark, n=1500)
    many = df.withColumn("k", F.when(F.col("k") % 2 == 0, 4).otherwise(F.col("k")))  # half of the rows have one key
    voc = spark.createDataFrame(vb.build_vocab(df, "s", max_tokens=40).collect(), "token string, freq long, id int")
    joined = vb.encode(many, ["k"], "s", voc).collect()
    stats = ob.bleu_stats(many, "k", "s", "t").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        looked_up = vb.encode(many, ["k"], "s", voc, max_tokens=40).collect()
        small = ob.bleu_stats(many, "k", "s", "t").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, looked_up)) == sorted(map(str, joined))
    assert sorted(map(str, small)) == sorted(map(str, stats))


def test_scores_join_their_rows_without_a_join(spark):
    """The rows are dealt once, as texts, and come out as if the statistics were joined back."""
    texts = ["the cat sat", "the cat", "", None, "a the cat sat on the mat", "the cat sat on"]
    rows = [(i % 4 if i % 11 else None, i, texts[i % 6], texts[i * 5 % 7 % 6]) for i in range(60)]
    rows += [(100 + i, i, "the cat sat on the mat", "the mat the cat") for i in range(30)]
    df = spark.createDataFrame(rows, "k long, i int, s string, t string")
    cut = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    got = ob.with_sentence_bleu(df, "k", F.col("s"), F.col("t"), "method4")
    assert "Join" not in _plan(got) and _plan(got).count("Exchange") == 1
    joined = df.join(ob.sentence_bleu(df, "k", cut("s"), cut("t"), "method4"), "k")
    assert got.columns == joined.columns and got.count() > df.count() and _same(got, joined)
    arrays = df.select("k", "i", cut("s").alias("s"), cut("t").alias("t"))
    joined = arrays.join(ob.sentence_bleu(arrays, "k", "s", "t", "method4"), "k")
    assert _same(ob.with_sentence_bleu(arrays, "k", "s", "t", "method4"), joined)
    assert ob.with_sentence_bleu(df.where("i < 0"), "k", F.col("s"), F.col("t"), "none").count() == 0


def test_report_deals_texts_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "en", "the Cat sat\nA dog  ran"), (1, "en", "the mat"), (2, "en", None)], "doc_id long, lang string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = E.queries()["bleu_report"](spark, str(tmp_path))
    plan = _plan(got)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(row_id") == 1
    assert "array" not in plan[plan.index("Exchange hashpartitioning(row_id") :].split("Scan")[0].replace("array(true)", "")
    assert len(got.collect()) == 5  # two rows of one key and lengths of their own, each with both scores; one alone


def test_words_of_texts():
    rnd = random.Random(2)
    for _ in range(300):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choices(["a", "é", "bc", " ", "\t"], k=rnd.randrange(6))) for _ in range(rnd.randrange(8))]
        first, kind = rnd.randrange(len(texts) + 1), rnd.choice([pa.string(), pa.large_string()])
        got = words_of(pa.array(texts, kind).slice(first))
        got.validate(full=True)
        assert got.to_pylist() == [t.split(" ") if t else [] for t in texts[first:]]


def test_merges_of_many_words_at_once():
    """As one word at a time, with pairs that come up again and symbols of no merge."""
    for seed in range(100):
        rnd = random.Random(seed)
        symbols, merges = list("abcé"[: rnd.randint(1, 4)]), []
        letters = [*symbols, "z"]
        for _ in range(rnd.randrange(40)):
            merges.append((rnd.choice(symbols), rnd.choice(symbols)))
            symbols.append("".join(merges[-1]))
        words = [rnd.choices(letters, k=rnd.randrange(14)) for _ in range(60)]
        got = bpe.Merges(merges).last(pa.array(words, pa.list_(pa.string()))).to_pylist()
        assert got == [bpe._last(w, bpe._steps(merges)) for w in words]


def test_texts_stand_for_arrays(spark, monkeypatch):
    """Counted, cut, encoded and decoded as texts: the same rows, keys that repeat or are null too."""
    _, arrays = _lines(spark)
    arrays = arrays.withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    texts = arrays.select("k", F.array_join("s", " ").alias("s"), F.array_join("t", " ").alias("t"))
    texts = texts.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("k")))
    assert _same(vb.token_counts(texts, "s"), vb.token_counts(arrays, "s"))
    both = vb.token_counts(texts, ["s", "t"])
    assert both.schema == vb.token_counts(arrays, "s").schema and "Generate" not in _plan(both)
    assert _same(both, vb.token_counts(arrays, ["s", "t"]))
    merges, seg = bpe.learn(both.withColumnRenamed("token", "word"), 30)
    monkeypatch.setattr(bpe, "HEAD_WORDS", 10)  # the others are cut by the merges
    for mark in (None, bpe.CONTINUES):
        exp = bpe.segment_words(arrays, "k", {"s": F.col("s"), "t": F.col("t")}, seg, mark, merges)
        sides = {"s": F.col("s"), "t": F.col("t")}
        assert _same(bpe.segment_words(texts, "k", sides, seg, mark, merges, repeats="rows"), exp)
        joined = bpe.segment_words(texts, "k", sides, seg, mark, merges, True, "rows")
        assert _same(joined, exp.select("k", F.array_join("s", " ").alias("s"), F.array_join("t", " ").alias("t")))
    exp, voc = exp.cache(), spark.createDataFrame(vb.build_vocab(joined, ["s", "t"], max_tokens=30).collect(), "token string, freq long, id int")
    ids = vb.encode(joined, ["k"], ["s", "t"], voc, ["a", "b"], max_tokens=30, unique=True)
    for side, out in (("s", "a"), ("t", "b")):
        alone = vb.encode(exp, ["k"], side, voc, out, max_tokens=30, unique=True)
        assert _same(ids.select("k", out), alone)
        back = vb.decode(ids, ["k"], ["a", "b"], voc.where("id <> 7"), ["a", "b"], skip_ids=(0, 1, 5), max_tokens=30, unique=True)
        assert _same(back.select("k", out), vb.decode(alone, ["k"], out, voc.where("id <> 7"), out, skip_ids=(0, 1, 5)))


def test_subword_text_cleans_once_and_deals_nothing_more(spark, tmp_path, monkeypatch):
    docs = [(1, "en", "the low lower lowest\nnew  newer, low."), (1, "en", "the newest"), (2, "en", "é éé\n\nof the ")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    calls, gone = [], []
    monkeypatch.setattr(q_models, "clean_p", lambda *a, f=q_models.clean_p: calls.append(a) or f(*a))
    monkeypatch.setattr(q_models, "remove", lambda s, path, f=q_models.remove: gone.append(path) or f(s, path))
    got = q_models.subword_text(spark, str(tmp_path), 6)
    assert len(calls) == 1 and len(gone) == 1 and "Exchange" not in _plan(got)
    rows = {r.row_id: (r.src, r.tgt) for r in got.collect()}
    n = 1 << 32
    assert sorted(rows) == [n, n + 1, 2 * n, 2 * n + 2] and rows[n + 1] == ("new newer , low .",) * 2
    assert sorted(rows[n][1].split()) == sorted("the low lower lowest the newest".split())  # two rows of one key
    assert rows[2 * n] == ("é éé", "é éé") and rows[2 * n + 2] == ("the", "of the")
