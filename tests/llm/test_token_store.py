import hashlib
import random

import numpy as np
import public_tokenizers
import zstandard
from tokenizers import Tokenizer

from bitext.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


def _library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_word_ids_equal_the_library():
    rnd = random.Random(2)
    bits = ["a", "b", "E", "́", " ", "  ", "\n", "\x1c", "\x85", "é", "Ö", "ß", "İ", "Σ", "1", "²", "!", "'S", "'ll", "😀", "\t", "中", "<|endoftext|>", "</w>", "ﬁ", "the"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    coder, library = ts.WordIds(PATH), _library()
    for text, ids in zip(texts, coder.encode(texts, chunk_chars=300)):
        assert np.frombuffer(ids, coder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_store_reads_back(spark, monkeypatch):
    monkeypatch.setattr(ts, "SEGMENT_BYTES", 200)  # many segments
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["Wort", "été", "the", "x1"]) for _ in range(rnd.randint(0, 90))), 1, "s") for i in range(80)]
    rows += [(500, None, 1, "s"), (501, "", 1, "s"), (5, "again", 1, "s"), (5, "again", 1, "s"), (None, "no id", 1, "s")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, frame string")
    path = ts.write_store(df, PATH, end_id=2)
    library = _library()
    exp = {}
    for d, t, *_ in rows:
        exp.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    got = ts.read_store(spark, path).orderBy("start").collect()
    assert len(got) == len(rows)
    at = 0
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids in exp[r.doc_id]
        at += len(ids)

    # one document by its index entry, the dictionary and its own frame
    kept = spark.read.parquet(f"{path}/dictionary").first()
    assert hashlib.sha256(kept["dictionary"]).digest() == bytes(kept["hash"])
    row = spark.read.parquet(f"{path}/segments").first()
    e = row["entries"][-1]
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(kept["dictionary"])))
    raw = unpacker.decompress(bytes(row["payload"])[e.offset : e.offset + e.length])
    assert bytes(row["dictionary"]) == bytes(kept["hash"])
    assert np.frombuffer(raw, "<u2").tolist() in exp[e.doc_id]


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ts.read_store(spark, ts.write_store(df, PATH, end_id=2)).count() == 0
    text = "lang und länger " * 30_000
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = ts.read_store(spark, ts.write_store(one, PATH, end_id=2)).first()
    assert np.frombuffer(r.ids, "<u4").tolist() == _library().encode(text, add_special_tokens=False).ids + [2]


def test_added_tokens_inside_texts_as_the_library_by_default(spark):
    library = Tokenizer.from_file(PATH)
    rnd = random.Random(4)
    bits = ["a", " ", "\n", "E", "é", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", "the", "!", "̸"]
    texts = ["a <|endoftext|> b", *("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9))) for _ in range(2000))]
    coder = ts.WordIds(PATH, added=True)
    exp = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert exp[0] == [320, 49407, 321]
    assert [np.frombuffer(ids, coder.dtype).tolist() for ids in coder.encode(texts, chunk_chars=300)] == exp
    df = spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string")
    got = ts.read_store(spark, ts.write_store(df, PATH, end_id=2)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {i: e + [2] for i, e in enumerate(exp[:20])}
