"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions only.

A turn becomes `<|im_start|>role<|im_sep|>text<|im_end|>` and a line end. Inside roles and
texts a backslash precedes every backslash and the `|` of every `<|`; so no control string is
left in them, and dropping the backslashes restores them.

A window is a span of new turns, preceded by the conversation's system turn (when that is its first
turn) and by at most `history` turns before the span. The three together hold at most `budget` tokens
(words, at least 1 a turn). Prefix sums of the turns' tokens deal the turns into spans:

1. `room` is the budget less the system turn and a RESERVE-th part of the budget kept for history, at least 1.
2. A turn lies inside step k if its first and last token do, counted in steps of `room` tokens; one
   that reaches over a step's end is a crossing turn.
3. The inside turns of a step are one span. A crossing turn joins the span of the step that it reaches into
   if both fit into `room`; otherwise it is a span of its own.
4. History takes turns before the span, nearest first, while budget is left.

So only a window whose span is one single turn longer than `room` can exceed the budget, and it repeats no history.
What a window repeats is never in its loss mask; the assistant texts of its span are, without
their control strings. So over all windows each assistant text is a target once.

Prefix sums are taken in two levels, over blocks of 256 turn numbers and within them, so a
conversation that holds a third of all rows is not one task's work. Only read_back() puts a
conversation's text together, as its digest asks for.

Defined results: null texts and roles are empty; rows of one turn number (and repeated rows) are ordered by role and
text and stay turns of their own; a null turn number comes first; a null conv_id is a conversation of its own;
texts of any length are formatted whole; an empty table gives no windows; columns other than the four, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import stage

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
BLOCK = 256
RESERVE = 8


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def chat_windows(turns: DataFrame, budget: int = 512, history: int = 2) -> DataFrame:
    """conv_id, window, tokens, formatted, repeated (turns that the window repeats), loss array<struct<start, end>> (code points)."""
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tokens = F.greatest(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")
    t = t.withColumns({"block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))), "tokens": tokens, "conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))})
    conv = F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv").alias("id"))
    t = t.withColumn("conv", conv)
    order = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    t = t.withColumn("n", F.row_number().over(order))
    least = F.min(F.struct("block", "n", "role", "tokens"))
    blocks = t.groupBy("conv", "block").agg(F.sum("tokens").alias("block_tokens"), F.count("*").alias("block_turns"), least.alias("least"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("least").over(Window.partitionBy("conv"))
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("block_turns").over(earlier), F.lit(0)).alias("turns_before"), F.when(first["role"] == "system", first["tokens"]).otherwise(0).alias("system"))
    inner = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("inner", inner).join(blocks, ["conv", "block"])
    t = t.select("conv", "conv_id", "role", "tokens", "system", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("head"), escape(F.col("text")).alias("body"), (F.col("turns_before") + F.col("n") - 1).alias("pos"), (F.col("tokens_before") + F.col("inner")).alias("before"))
    # the system turn is in every window: the sums go on behind it
    own = (F.col("pos") == 0) & (F.col("role") == "system")
    room = F.greatest(F.lit(budget - budget // RESERVE) - F.col("system"), F.lit(1))
    t = t.withColumns({"size": F.when(own, 0).otherwise(F.col("tokens")), "from": F.when(own, 0).otherwise(F.col("before") - F.col("system")), "room": room})
    step, reached = F.floor(F.col("from") / F.col("room")), F.floor((F.col("from") + F.col("size")) / F.col("room"))
    inside = own | (F.floor((F.col("from") + F.col("size") - 1) / F.col("room")) == step)
    t = t.withColumns({"inside": inside, "step": step, "near": F.when(inside, step).otherwise(reached)})
    spans = t.groupBy("conv", "near").agg(((F.sum("size") <= F.max("room")) & F.bool_or("inside")).alias("whole"))
    t = t.join(spans, ["conv", "near"])
    window = F.when(F.col("inside") | F.col("whole"), 2 * F.col("near")).otherwise(2 * F.col("step") + 1)
    t = stage(t.withColumn("window", window).drop("step", "near", "inside", "whole", "from", "before", "room"))

    first = t.groupBy("conv", "window").agg(F.min("pos").alias("first_pos"), (F.lit(budget) - F.max("system") - F.sum("size")).alias("left")).where("first_pos > 0")
    back = F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(1, history))), lambda j: F.col("first_pos") - j), lambda p: (p >= 0) & (p >= F.col("first_pos") - history))
    again = first.select("conv", F.col("window").alias("into"), "first_pos", "left", F.explode(F.array_union(F.array(F.lit(0).cast("long")), back)).alias("pos"))
    repeats = t.drop("window").join(again, ["conv", "pos"])
    system = (F.col("pos") == 0) & (F.col("role") == "system")
    # nearest first, as long as budget is left; at most `history` + 1 rows of each window
    cost = F.sum(F.when(system, 0).otherwise(F.col("tokens"))).over(Window.partitionBy("conv", "into").orderBy(F.col("pos").desc()))
    close = F.col("pos") >= F.col("first_pos") - history
    repeats = repeats.withColumn("cost", cost).where(system | (close & (F.col("cost") <= F.col("left"))))
    repeats = repeats.withColumnRenamed("into", "window").drop("first_pos", "left", "cost").withColumn("new", F.lit(False))
    pieces = t.withColumn("new", F.lit(True)).unionByName(repeats)

    chars = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy("conv", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(chars).over(before), F.lit(0)) + F.length("head")
    target = F.col("new") & (F.col("role") == "assistant")
    span = F.when(target, F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    pieces = pieces.select("conv", "conv_id", "window", F.struct("pos", F.concat("head", "body", F.lit(END)).alias("piece"), "new", span.alias("loss")).alias("p"), "tokens")
    # a window holds at most `budget` turns (a token each at least), or one more
    out = pieces.groupBy("conv", "window").agg(F.first("conv_id").alias("conv_id"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list("p")).alias("p"))
    return out.select(
        "conv_id", "window", "tokens", F.array_join(F.col("p.piece"), "").alias("formatted"), F.size(F.filter("p", lambda x: ~x["new"])).alias("repeated"), F.filter(F.col("p.loss"), lambda x: x.isNotNull()).alias("loss")
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, said (role, line end, text, line end of each turn), learned (all targets), formatted_chars: read from the windows alone."""
    parts = F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.col("repeated") + 1, F.size(F.split("formatted", r"<\|im_end\|>\n")) - F.col("repeated") - 1)
    turn = lambda p: F.concat(unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1)), F.lit("\n"), unescape(F.substring_index(p, SEP, -1)), F.lit("\n"))
    said = F.array_join(F.transform(parts, turn), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    w = windows.select("conv_id", F.struct("window", F.size(parts).alias("n"), said.alias("said"), learned.alias("learned"), F.length("formatted").alias("chars")).alias("w"))
    w = w.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return w.select("conv_id", total("w.n").alias("n_turns"), F.array_join(F.col("w.said"), "").alias("said"), F.array_join(F.col("w.learned"), "").alias("learned"), total("w.chars").alias("formatted_chars"))
