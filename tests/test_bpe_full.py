import pytest

import __spark_entry__ as E
from bitext.functions import text as tx
from bitext.operators import bpe
from bitext.plans import q_models as q

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def lines(spark):
    """Each line's words by side, and its subwords, encoded on the driver from the merges."""
    p = q.clean_p(spark, SF_SMALL).select(
        "row_id", tx.pretokenize(tx.lower("src")).alias("s"), tx.pretokenize(tx.lower("tgt")).alias("t")
    )
    merges = [(r.left, r.right) for r in E.queries()["bpe_vocabulary"](spark, SF_SMALL).orderBy("rank").collect()]
    assert len(merges) == 10_000
    steps, known = bpe._steps(merges), {}

    def cut(words):
        for w in words:
            if w not in known:
                known[w] = bpe._last(list(w), steps)
        return [x for w in words for x in known[w]]

    return {r.row_id: (cut(r.s), cut(r.t)) for r in p.collect()}


def test_apply_and_length_clean_at_ten_thousand_merges(spark, lines):
    got = {r.row_id: (r.n_subwords, r.subwords) for r in E.queries()["bpe_apply_full"](spark, SF_SMALL).collect()}
    assert got == {k: (len(t), " ".join(t)) for k, (_, t) in lines.items()}
    got = {r.row_id: (r.n_src, r.n_tgt) for r in E.queries()["subword_length_clean_full"](spark, SF_SMALL).collect()}
    sizes = {k: (len(s), len(t)) for k, (s, t) in lines.items()}
    assert got == {k: v for k, v in sizes.items() if min(v) >= 2 and max(v) <= 350 and max(v) <= 2.0 * min(v)}


def test_encode_and_decode_at_ten_thousand_merges(spark, lines):
    decoded = {r.row_id: r.text for r in E.queries()["bpe_decode_full"](spark, SF_SMALL).collect()}
    assert decoded == {k: " ".join(t) for k, (_, t) in lines.items()}  # whole lines, not a prefix
    from collections import Counter

    counts = Counter(x for _, t in lines.values() for x in ["[START]", *t, "[END]"])
    ids = {x: i for i, x in enumerate(sorted(counts, key=lambda x: (-counts[x], x)), 2)}
    got = {r.row_id: r.ids for r in E.queries()["bpe_encode_ids_full"](spark, SF_SMALL).collect()}
    exp = {k: ([ids[x] for x in ["[START]", *t, "[END]"]] + [0] * 30)[:30] for k, (_, t) in lines.items()}
    assert got == {k: " ".join(map(str, v)) for k, v in exp.items()}
