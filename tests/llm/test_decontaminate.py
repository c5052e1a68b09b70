import random
import re

from bitext.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(text, items, width=13):
    words, hit, found = _words(text), set(), set()
    for item, t in items:
        w = _words(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            win = w[i : i + width]
            for p in range(len(words) - len(win) + 1):
                if words[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add("" if item is None else str(item))
    return len(words), hit, sorted(found)


def _case(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "B", "é", "c3", "dd", "Ñu"]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, line(rnd.choice([2, 5, 13, 14, 30]))) for i in range(12)] + [(99, None), (98, "-- !"), (None, "zz yy"), (3, "again zz")]
    docs = [(i, ", ".join(rnd.choice([line(20), items[rnd.randrange(12)][1], "zz\nYY", "again-zz"]) for _ in range(4))) for i in range(60)]
    return items, docs + [(100, None), (101, ""), (102, "...")]


def test_equals_brute_force(spark, monkeypatch):
    items, docs = _case(1)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, found string")
    item_df = spark.createDataFrame(items, "item_id long, text string")
    for block in (dc.BLOCK_BYTES, 64):  # one block, and many
        monkeypatch.setattr(dc, "BLOCK_BYTES", block)
        got = dc.with_occurrences(df, item_df, found="mark").collect()
        assert len(got) == len(docs)
        for r in got:
            n, hit, found = _brute(r.text, items)
            assert (r.mark.n_words, list(r.mark["items"])) == (n, found)
            assert {q for s in r.mark.spans for q in range(s.first, s.past)} == hit


def test_filter_keeps_clean_rows_whole(spark):
    items, docs = _case(2)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, found string")
    kept = dc.without_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    clean = {d[0] for d in docs for n, hit, _ in [_brute(d[1], items)] if not hit or 20 * len(hit) < n}
    assert {r.doc_id for r in kept.collect()} == clean


def test_long_text_and_empty_tables(spark):
    words = ["w%d" % i for i in range(200_000)]
    item = " ".join(words[150_000:150_013])
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([("i", item)], "item_id string, text string")
    r = dc.with_occurrences(df, items).first()
    assert [(s.first, s.past) for s in r.found.spans] == [(150_000, 150_013)]
    assert dc.with_occurrences(df.limit(0), items).count() == 0
    assert dc.with_occurrences(df, items.limit(0)).first().found["items"] == []


def test_worker_holds_one_block_of_items(spark):
    from bitext.llm import decontaminate as dc

    blocks = [spark.sparkContext.broadcast([(str(k), b"one two %d" % k)]) for k in range(3)]
    for _ in range(2):  # each is read again after it was dropped
        for k, block in enumerate(blocks):
            (table,) = dc._tables(block, 3)
            assert list(table.windows) == [(b"one", b"two", b"%d" % k)]
            assert not any("_value" in vars(b) for b in blocks) and len(dc._TABLES) == 1
