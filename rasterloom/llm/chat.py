"""Chat formatting into budgeted, turn-aligned windows with loss masks (DataFrame functions only).

A turn is written `<|turn|>role\ntext<|end|>`. In roles and texts `~`, `<`, `[` become `~0`, `~1`, `~2` (in roles also a
line feed `~3`), so no control string can occur in them and reading back is exact.

Windows: the prefix sum of turn tokens (blank-separated runs) before a turn names its cell, GRID_SHARE of the room that the budget leaves beside the
system turn and the history. A window's new turns are those that begin in one cell; a turn that would not fit the room behind them is a window's only new turn, whole. Every later window repeats the system turn (a first turn of role `system`) and up to
`history_turns` turns just before the span, as far as they fit `history_tokens`. The loss mask covers the texts of new assistant turns only,
so repeated ones are masked and each counts once. All of this is window functions over rows of turns; only the
list of the windows that repeat a system turn, and reading back, hold a conversation's windows or turns together.

Cases: null text and null role count as ''; null conv_id is a conversation of its own; rows are ordered by (turn,
role, text), null turns first, so repeated rows and ties have a fixed order; an empty table gives no rows.
Turns are dealt to tasks by conversation, in one shuffle: a very long one is sorted, with spilling, in one task, where its digest needs it whole anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_expr

TURN, END = "<|turn|>", "<|end|>"
GRID_SHARE = 0.75


def escape(text: Column) -> Column:
    for plain, mark in (("~", "~0"), ("<", "~1"), ("[", "~2")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for plain, mark in (("[", "~2"), ("<", "~1"), ("~", "~0")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("~3"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~3"), F.lit("\n")))


def format_windows(turns: DataFrame, budget: int = 2048, history_turns: int = 2, history_tokens: int = 256) -> DataFrame:
    """One row per window: conv_id, window, n_repeated, formatted, mask (array of start, end; code points, end exclusive).

    turns: conv_id, turn, role, text; other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), words_expr(F.col("text")).alias("tok"))
    order, whole = Window.partitionBy("conv_id").orderBy("turn", "role", "text"), Window.partitionBy("conv_id")
    rows = rows.withColumn("pos", F.row_number().over(order) - 1)
    order = Window.partitionBy("conv_id").orderBy("pos")
    first = (F.col("pos") == 0) & (F.col("role") == "system")
    rows = rows.withColumns({"is_sys": first, "cost": F.when(first, F.lit(0).cast("long")).otherwise(F.col("tok"))})
    rows = rows.withColumns({
        "sys_tok": F.max(F.when(F.col("is_sys"), F.col("tok"))).over(whole),  # null: no system turn
        "before": F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cost"),
    })
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget - history_tokens) - F.coalesce("sys_tok", F.lit(0)))
    grid = F.greatest(F.lit(1).cast("long"), F.floor(room * GRID_SHARE))
    rows = rows.withColumn("cell", F.floor(F.col("before") / grid)).withColumn("fits", F.col("before") - F.col("cell") * grid + F.col("cost") <= room)
    starts = (F.col("cell") != F.lag("cell").over(order)) | ~F.col("fits") | ~F.lag("fits").over(order)
    # a system turn alone makes no window
    starts = starts & (F.col("pos") > F.when(F.col("sys_tok").isNotNull(), 1).otherwise(0))
    rows = rows.withColumn("starts", F.coalesce(starts, F.lit(False)))
    rows = rows.withColumn("window", F.sum(F.col("starts").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    later = [  # windows that begin at most history_turns turns on and whose history has room for this turn
        F.when(F.lead("starts", k).over(order) & ~F.col("is_sys") & (F.lead("before", k).over(order) - F.col("before") <= history_tokens), F.lead("window", k).over(order))
        for k in range(1, history_turns + 1)
    ]
    nothing = F.expr("cast(array() as array<bigint>)")
    again = F.filter(F.array(*later), lambda w: w.isNotNull()) if later else nothing
    last = F.max("window").over(whole)
    again = F.when(F.col("is_sys") & (last > 0), F.sequence(F.lit(1).cast("long"), last)).when(F.col("is_sys"), nothing).otherwise(again)
    rows = rows.withColumns({"again": again, "head": F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")), "body": escape(F.col("text"))})
    places = F.concat(F.array(F.struct("window", F.lit(False).alias("rep"))), F.transform("again", lambda w: F.struct(w.alias("window"), F.lit(True).alias("rep"))))
    rows = rows.select("conv_id", "pos", "role", "head", "body", F.explode(places).alias("p")).select("conv_id", "pos", "role", "head", "body", "p.window", "p.rep")
    inside = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("end", F.sum(size.cast("long")).over(inside) - len(END)).withColumn("start", F.col("end") - F.length("body"))
    loss = (F.col("role") == "assistant") & ~F.col("rep")
    out = rows.groupBy("conv_id", "window").agg(
        F.count_if("rep").alias("n_repeated"),
        F.sort_array(F.collect_list(F.struct("pos", F.concat("head", "body", F.lit(END)).alias("piece")))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(loss, F.struct("start", "end")))).alias("mask"),
    )
    return out.select("conv_id", "window", "n_repeated", F.array_join("pieces.piece", "").alias("formatted"), "mask")


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: n_turns, turns (array of role, text), loss_text, formatted_chars."""
    # the first piece is what stands before the first mark: empty
    pieces = F.expr(f"slice(split(formatted, '{TURN.replace('|', '[|]')}', -1), 2 + cast(n_repeated as int), 1 << 30)")
    w = windows.select("conv_id", "window", "formatted", "mask", pieces.alias("p"))
    role = lambda p: unescape_role(F.substring_index(p, "\n", 1))
    body = lambda p: F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END))
    w = w.withColumn("turns", F.transform("p", lambda p: F.struct(role(p).alias("role"), unescape(body(p)).alias("text"))))
    cut = lambda m: F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))
    w = w.withColumn("loss", F.array_join(F.transform("mask", lambda m: unescape(cut(m))), ""))
    w = w.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return w.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted_chars").withColumn("n_turns", F.size("turns").cast("long"))


def digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )
