import hashlib
import random

from pyspark.sql import functions as F

from bitext.llm import chat_windows as cw

SCHEMA = "conv_id long, turn long, role string, text string"


def _back(spark, rows, schema=SCHEMA, **how):
    windows = cw.format_windows(spark.createDataFrame(rows, schema), **how)
    got = {}
    for r in windows.join(cw.read_back(windows), ["conv_id", "window"]).orderBy("conv_id", "window").collect():
        got.setdefault(r.conv_id, []).append(r)
    return got


def test_escaping_is_reversible(spark):
    rnd = random.Random(3)
    bits = ["<", "[", "\\", "|im_end|>", "|im_start|>", "|im_sep|>", "s>", "/s>", "INST]", "/INST]", "a", " ", "\n", "<|im_end|>"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = cw.escape(F.col("t"))
    for r in df.select("t", e.alias("e"), cw.unescape(e).alias("u")).collect():
        assert r.u == r.t
        assert not any(x in r.e for x in (cw.START, cw.SEP, cw.END, "</s>", "<s>", "[INST]", "[/INST]"))


def test_turns_and_loss_come_back(spark):
    rnd = random.Random(4)
    rows = []
    for conv in range(40):
        turns = rnd.randint(1, 12)
        for t in range(turns):
            role = "system" if t == 0 and conv % 2 else ("assistant" if t % 2 else "user")
            text = " ".join(rnd.choice(["wort", "été", "</s>", "[INST]", "<|im_end|>", "7"]) for _ in range(rnd.randint(0, 60)))
            rows.append((conv, t, role, text))
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    got = _back(spark, shuffled, budget=120, history_budget=40)
    for conv in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == conv)
        windows = got[conv]
        assert [(t.role, t.text) for w in windows for t in w.turns] == [(r[2], r[3]) for r in mine]
        assert "".join(x for w in windows for x in w.loss) == "".join(r[3] for r in mine if r[2] == "assistant")
        for w in windows:
            shown = w.text.split(cw.END)[:-1]
            if w.window > 1 and mine[0][2] == "system":
                assert shown[0].startswith(cw.START + "system")
            # within the budget unless one turn alone is not
            assert w.n_tokens <= 120 or len(shown) - w.n_repeated == 1 or w.window == 1
    assert max(len(w) for w in got.values()) > 2


def test_edge_cases(spark):
    rows = [(1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (1, None, "user", "first"), (None, 1, "assistant", ""), (2, 0, "system", "only")]
    schema = SCHEMA + ", pos int, window string, TEXT2 string"
    got = _back(spark, [(*r, 1, "w", "x") for r in rows], schema)
    assert [(t.role, t.text) for t in got[1][0].turns] == [("user", "first"), ("", ""), ("assistant", "b"), ("assistant", "b")]
    assert got[1][0].loss == ["b", "b"]
    assert [(t.role, t.text) for t in got[2][0].turns] == [("system", "only")] and got[2][0].loss == []
    assert cw.format_windows(spark.createDataFrame([], SCHEMA)).count() == 0
    nulls = cw.read_back(cw.format_windows(spark.createDataFrame(rows, SCHEMA))).filter("conv_id is null").collect()
    assert len(nulls) == 1 and nulls[0].loss == []


def test_very_long_text(spark):
    text = "ab </s> " * 50_000
    got = _back(spark, [(1, 0, "user", "q"), (1, 1, "assistant", text), (1, 2, "user", "r")])
    assert "".join(x for w in got[1] for x in w.loss) == text
    assert hashlib.sha256(got[1][0].turns[0].text.encode()).hexdigest() == hashlib.sha256(b"q").hexdigest()


def test_no_python_in_the_plan(spark):
    w = cw.read_back(cw.format_windows(spark.createDataFrame([(1, 0, "user", "q")], SCHEMA)))
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
