import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from bitext.llm import bpe_codec as bc

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokens():
    return bc.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_rank_bits():
    rnd = random.Random(1)
    bits, have = bc.RankBits(300_000), set()
    for _ in range(3000):
        r = rnd.randrange(300_000)
        if r in have:
            bits.clear(r)
            have.discard(r)
        else:
            bits.set(r)
            have.add(r)
        assert bits.first() == (min(have) if have else -1)


def test_equals_the_library(tokens, library, monkeypatch):
    monkeypatch.setattr(bc, "CACHE", 5000)
    monkeypatch.setattr(bc, "CHUNK_CHARS", 500)
    coder = bc.Encoder(tokens, public_tokenizers.PATTERN)
    rnd = random.Random(2)
    bits = ["a", "b", "ab", "the", " ", "  ", "\n", " \n", "\t", "é", "中", "ß", "12", "½", "!", "'s", "'ll", "😀", "\x1c", "\x85", " ", "ǅ", "<|endoftext|>"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, "abc" * 9_999, "aet" * 7, "".join(random.Random(4).choice("abeté") for _ in range(40_000))])
def test_very_long_pieces(tokens, library, text):
    coder = bc.Encoder(tokens, public_tokenizers.PATTERN)
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_narrow_and_wide_buckets_agree(tokens, monkeypatch):
    rnd = random.Random(6)
    pieces = ["".join(rnd.choice("abehilnorst") for _ in range(rnd.randint(2, 30))).encode() for _ in range(800)]
    pairs = bc.BytePairs(tokens)
    wide = pairs.merge(pieces)
    monkeypatch.setattr(bc, "_WIDE", 10**9)
    assert pairs.merge(pieces) == wide


def test_columns(spark, library):
    rows = [(1, "Hello wörld", "i"), (2, None, "j"), (3, "", "k"), (3, "", "k"), (None, "x" * 5000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bc.with_ids(df, PATH, public_tokenizers.PATTERN, out="coded")
    back = bc.with_bytes(coded, PATH, public_tokenizers.PATTERN, "coded", "raw")
    assert back.columns == ["doc_id", "text", "ids", "coded", "raw"]
    got = back.withColumn("n", bc.n_ids("coded")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.frombuffer(r.coded, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.raw) == (r.text or "").encode() and r.n == len(r.coded) // 4
    at_once = bc.with_ids(df, PATH, public_tokenizers.PATTERN, out="coded", decoded="raw")
    assert sorted(map(str, at_once.collect())) == sorted(map(str, back.collect()))
    assert bc.with_ids(df.limit(0), PATH, public_tokenizers.PATTERN, out="coded").count() == 0
