"""Columns of a table that are named like a result."""

import public_tokenizers

from bitext.llm import bpe_codec, decontaminate, quality, toxicity


def test_columns_named_like_a_result_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b c", 9.0, "x", "y", "z")], "doc_id long, text string, SCORE double, ids string, bytes string, found string")
    score = toxicity.with_score(docs, None)
    assert [c.lower() for c in score.columns].count("score") == 1 and score.first()["score"] == 0.0
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    many = spark.createDataFrame([(i, "good words here " * (i % 2) + "zq xx") for i in range(40)], "doc_id long, text string")
    scored = quality.with_score(docs, quality.fit(many, labels))
    assert 0 <= scored.select("score").first()[0] <= 1
    items = spark.createDataFrame([("i", "b c")], "item_id string, text string")
    marked = decontaminate.with_occurrences(docs, items)
    assert marked.select("found.n_words").first()[0] == 3
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_codec.with_ids(docs, path, public_tokenizers.PATTERN, decoded="bytes")
    assert bytes(coded.select("bytes").first()[0]) == b"a b c"
    assert bytes(bpe_codec.with_bytes(coded, path, public_tokenizers.PATTERN).select("bytes").first()[0]) == b"a b c"
