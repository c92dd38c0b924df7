"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut each conversation into turn-aligned spans: turns that begin in the same
multiple of the room that the budget leaves for new turns, turns longer than a quarter of the budget alone. A
window is a span with the conversation's system turn before it (its first turn, if that is by ``system`` and
others follow) and up to ``HISTORY_TURNS`` turns of history that fit the history's budget. Its tokens stay in
the budget unless the system turn or a single turn is too long by itself; no text is ever cut. The loss
mask covers assistant turns of the span only, so each of them is a target once.

Prefix sums are taken in blocks of ``BLOCK_TURNS`` turns, then over the blocks' totals, so a conversation with
very many turns is spread over tasks. Tokens are counted as pieces of up to four characters.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn. Control strings inside a role or a text
get a backslash after their first character, and backslashes are doubled; ``plain`` undoes both.

Order is by turn (null first), then role and text; repeated rows are turns of their own. Null roles and texts
are empty; rows without conversation id form one conversation. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TURNS, BLOCK_TURNS = 2048, 256, 2, 4096
OVERHEAD = 4
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = [START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TOKEN = r"[^\x20\x09-\x0D]{1,4}"


def _literal(text: str) -> str:
    return "".join("\\" + c if c in "\\|[]<>/$^.*+?(){}" else c for c in text)


def escaped(text: Column) -> Column:
    inner = "|".join(f"(?<={_literal(c[0])}){_literal(c[1:])}" for c in CONTROL)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"(?=(?:{inner}))", r"\\")


def plain(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long") + OVERHEAD


def _placed(conversations: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with position, tokens before them, their span, and what the conversation's system turn takes."""
    text = F.coalesce("text", F.lit(""))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 40)))
    longest = budget // 4
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("none"), block.alias("block"),
        "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), tokens(text).alias("tokens"),
    ).withColumn("long", (F.col("tokens") > longest).cast("long"))
    inner = Window.partitionBy("conv", "none", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"pos": F.row_number().over(inner).cast("long"), "before": F.sum("tokens").over(upto) - F.col("tokens"), "longs": F.sum("long").over(upto) - F.col("long")})
    totals = rows.groupBy("conv", "none", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.sum("long").alias("l"),
        F.max(F.when((F.col("pos") == 1) & (F.col("role") == "system"), F.col("tokens"))).alias("sys"),
        F.max(F.when((F.col("pos") == 1) & (F.col("role") == "system"), F.col("long"))).alias("sys_long"),
    )
    conv = Window.partitionBy("conv", "none")
    earlier = conv.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = conv.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    several = F.sum("n").over(conv) > 1
    totals = totals.select(
        "conv", "none", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("n", "t", "l")],
        F.when(several, F.first("sys").over(first)).alias("sys"), F.coalesce(F.when(several, F.first("sys_long").over(first)), F.lit(0)).alias("sys_long"),
    )
    rows = rows.join(totals, ["conv", "none", "block"])
    sys = F.coalesce("sys", F.lit(0))
    room = F.greatest(F.lit(budget - history - longest) - sys, F.lit(longest))
    before = F.col("t0") + F.col("before") - sys
    return rows.select(
        "conv", "none", "role", "text", "tokens", "sys", (F.col("n0") + F.col("pos")).alias("pos"), before.alias("before"),
        F.floor(before / room).alias("part"), (2 * (F.col("l0") + F.col("longs") - F.col("sys_long")) + F.col("long")).alias("run"),
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window.

    Columns: conv_id, window (position of its first new turn), formatted, loss (array of start and end in code
    points), n_context (turns before the first new one), n_new, n_tokens.
    """
    rows = _placed(conversations, budget, history)
    lead = F.col("sys").isNotNull() & (F.col("pos") == 1)
    system = rows.filter(lead).select("conv", "none", F.struct(F.lit(0).cast("long").alias("pos"), "role", "text", F.lit(False).alias("new"), "tokens").alias("system"))
    turns = rows.filter(~lead)
    spans = turns.groupBy("conv", "none", "part", "run").agg(F.min("pos").alias("window"), F.min("before").alias("start"))
    turn = [F.col("pos"), F.col("role"), F.col("text")]
    new = turns.join(spans, ["conv", "none", "part", "run"]).select("conv", "none", "window", F.struct(*turn, F.lit(True).alias("new"), F.col("tokens")).alias("x"))
    ahead = turns.select("conv", "none", "before", *turn, "tokens", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + HISTORY_TURNS)).alias("window"))
    old = ahead.join(spans.select("conv", "none", "window", "start"), ["conv", "none", "window"]).filter(F.col("before") >= F.col("start") - history)
    old = old.select("conv", "none", "window", F.struct(*turn, F.lit(False).alias("new"), F.col("tokens")).alias("x"))
    # a window holds at most the budget, or one longer turn
    held = new.unionByName(old).groupBy("conv", "none", "window").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    held = held.join(system, ["conv", "none"], "left")
    # with a system turn the first window starts at position 2, and the system turn is new in it
    opening = F.struct(F.col("system.pos"), F.col("system.role"), F.col("system.text"), (F.col("window") == 2).alias("new"), F.col("system.tokens"))
    turns_ = F.when(F.col("system").isNotNull(), F.concat(F.array(opening), F.col("turns"))).otherwise(F.col("turns"))
    held = held.select("conv", "none", "window", turns_.alias("turns"))
    held = held.withColumn("parts", F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP)).alias("head"), escaped(t["text"]).alias("body"), (t["new"] & (t["role"] == "assistant")).alias("target"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        more = F.when(p["target"], F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len(END)).alias("at"), F.concat(acc["spans"], more).alias("spans"))

    return held.select(
        F.when(F.col("none"), None).otherwise(F.col("conv")).alias("conv_id"), "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("parts", zero, step, lambda acc: acc["spans"]).alias("loss"),
        F.size(F.filter("turns", lambda t: ~t["new"])).alias("n_context"), F.size(F.filter("turns", lambda t: t["new"])).alias("n_new"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"]).alias("n_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window: its new turns (role, text) and its targets, from the formatted text and mask alone."""
    parts = F.slice(F.split("formatted", _literal(END)), F.col("n_context") + 1, F.col("n_new"))
    turns = F.transform(parts, lambda p: F.struct(plain(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1)).alias("role"), plain(F.substring_index(p, SEP, -1)).alias("text")))
    targets = F.transform("loss", lambda s: plain(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").cast("long").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation with digests of what ``read_back`` gives."""
    rows = read_back(formatted).select(
        "conv_id", F.struct(
            "window", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("targets", "").alias("loss"), "chars",
        ).alias("w"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    loss = F.array_join("w.loss", "")
    total = lambda field: F.aggregate(f"w.{field}", F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), total("chars").alias("formatted_chars"),
    )
