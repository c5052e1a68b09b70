"""Chat formatting: conversations as training windows of a token budget.

A turn's tokens are counted by a native expression.  Prefix sums over a
conversation's turns cut it at multiples of the room that a window has beside
the system turn and the repeated history: turns wholly between two multiples
form a window, a turn that crosses one is a window of its own, so every window
is turn-aligned and within the budget unless a single turn is not.  Each
window opens with the conversation's system turn and repeats the last turns
before it, as far as ``history_turns`` and ``history_budget`` allow; what is
repeated is outside the loss mask, as are user and system turns.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` per turn.  Control
strings inside roles and texts get one more backslash after their first
character (``<|im_end|>`` becomes ``<\\|im_end|>``), which reading back takes
off again; no raw control string of a text survives in the output.

Only DataFrame functions are used.  A conversation is laid out within one
task (its digest needs all of its turns in one value); windows are bounded.

Edge cases: null role and text count as empty; empty texts have no loss span;
turns with equal numbers go by role, then text, and repeated rows stay;
null turn numbers come first; a null conv_id is a conversation; an empty table
gives no windows; further columns are not read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: The tails of the control strings of common chat templates.
CONTROL_TAILS = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]"
#: Words, up to three digits, or one other visible character.
TOKEN = r"[\p{L}\p{M}]+|\p{N}{1,3}|[^\x00-\x20\p{L}\p{M}\p{N}]"
TURN_TOKENS = 4

BUDGET = 512
HISTORY_TURNS = 2
HISTORY_BUDGET = 128


def escape(col: Column) -> Column:
    return F.regexp_replace(col, rf"([<\[])(\\*)({CONTROL_TAILS})", r"$1\\$2$3")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, rf"([<\[])\\(\\*)({CONTROL_TAILS})", r"$1$2$3")


def token_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(TOKEN))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(SEP), turn["text"], F.lit(END))


def _loss_spans(turns: Column) -> Column:
    """Code-point spans of the texts under the mask."""

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.lit(len(START) + len(SEP)) + F.length(t["role"])
        past = first + F.length(t["text"])
        mine = (t["role"] == "assistant") & ~t["repeated"] & (past > first)
        span = F.array(F.struct(first.alias("first"), past.alias("past")))
        return F.struct(
            (past + F.lit(len(END))).alias("at"),
            F.when(mine, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    empty = F.array().cast("array<struct<first:int,past:int>>")
    begin = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.aggregate(turns, begin, step, lambda acc: acc["spans"])


def format_windows(
    rows: DataFrame,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_budget: int = HISTORY_BUDGET,
    count: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """conv_id, window, text, n_tokens, n_repeated (turns at the front that are
    repeats), loss_spans."""
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        escape(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).withColumn("k", (count(F.col("role")) + count(F.col("text")) + TURN_TOKENS).cast("long"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    turn = F.struct("role", "text", "k", "is_system")

    t = turns.withColumn("pos", F.row_number().over(in_order))
    t = t.withColumn("is_system", (F.col("pos") == 1) & (F.col("role") == "system"))
    t = t.withColumn("system", F.first(F.when(F.col("is_system"), turn)).over(so_far))
    t = t.withColumn("past", F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("k"))).over(so_far))
    room = F.greatest(F.lit(1), F.lit(budget - history_budget) - F.coalesce(F.col("system.k"), F.lit(0)))
    begin = F.col("past") - F.when(F.col("is_system"), 0).otherwise(F.col("k"))
    cell = F.struct(F.floor(begin / room).alias("a"), F.floor(F.greatest(F.col("past") - 1, begin) / room).alias("b"))
    t = t.withColumn("cell", F.when(F.col("is_system"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(cell))
    before = [F.lag(turn, i).over(in_order) for i in range(1, history_turns + 1)]
    t = t.select("*", F.lag("cell").over(in_order).alias("cell_before"), *[c.alias(f"h{i}") for i, c in enumerate(before)])
    # a first turn that crosses its cell's end still shares the window of the system turn before it
    opens = F.when(F.col("pos") == 1, 1).when(F.col("system").isNotNull() & (F.col("pos") == 2), 0)
    opens = opens.when(F.col("cell") != F.col("cell_before"), 1).otherwise(0)
    t = t.withColumn("window", F.sum(opens).over(so_far))

    used, history = F.lit(0), F.array().cast("array<struct<role:string,text:string,repeated:boolean>>")
    fits = F.lit(True)
    for i in range(history_turns):
        h = F.col(f"h{i}")
        used = used + F.coalesce(h["k"], F.lit(0))
        fits = fits & h.isNotNull() & ~h["is_system"] & (used <= history_budget)
        one = F.array(F.struct(h["role"].alias("role"), h["text"].alias("text"), F.lit(True).alias("repeated")))
        history = F.when(F.coalesce(fits, F.lit(False)), F.concat(one, history)).otherwise(history)
    t = t.withColumn("history", history)
    body = F.sort_array(F.collect_list(F.struct("pos", "role", "text")))
    w = t.groupBy("conv_id", "window").agg(
        body.alias("body"), F.min_by("history", "pos").alias("history"), F.min_by("system", "pos").alias("system")
    )
    later = F.col("window") > 1
    none = F.array().cast("array<struct<role:string,text:string,repeated:boolean>>")
    system = F.array(F.struct(F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.lit(True).alias("repeated")))
    own = F.transform(
        "body", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), F.lit(False).alias("repeated"))
    )
    turns_of = F.concat(
        F.when(later & F.col("system").isNotNull(), system).otherwise(none),
        F.when(later, F.col("history")).otherwise(none),
        own,
    )
    w = w.select("conv_id", F.col("window").cast("long").alias("window"), turns_of.alias("turns"))
    text = F.array_join(F.transform("turns", _render), "")
    sizes = F.transform("turns", lambda x: count(x["role"]) + count(x["text"]) + TURN_TOKENS)
    return w.select(
        "conv_id",
        "window",
        text.alias("text"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_tokens"),
        F.size(F.filter("turns", lambda x: x["repeated"])).alias("n_repeated"),
        _loss_spans(F.col("turns")).alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, formatted_chars, turns (role, text) without the repeated
    ones, and loss: the texts under the mask, all unescaped."""
    parts = F.split("text", r"<\|im_end\|>")
    own = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.size(parts) - 1 - F.col("n_repeated"), F.lit(0)))

    def parse(part: Column) -> Column:
        sides = F.split(F.substr(part, F.lit(len(START) + 1)), r"<\|im_sep\|>")
        return F.struct(unescape(sides[0]).alias("role"), unescape(sides[1]).alias("text"))

    loss = F.transform(
        "loss_spans", lambda s: unescape(F.substr(F.col("text"), s["first"] + 1, s["past"] - s["first"]))
    )
    return windows.select(
        "conv_id",
        "window",
        F.length("text").cast("long").alias("formatted_chars"),
        F.transform(own, parse).alias("turns"),
        loss.alias("loss"),
    )
