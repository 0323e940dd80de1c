"""Conversations formatted into windows of a token budget, in DataFrame operations only.

Tokens of the turns before a turn (prefix sums) choose the windows. With a
stride of half of what the budget leaves beside history and system turn, a turn
belongs to the stride that its last token falls into; the turns of a stride make
a window, and a turn longer than a stride is a window alone. So every turn is
new in exactly one window, windows end with turns, and only the window of a turn
longer than a stride may pass the budget. A window begins with the conversation's
system turn and repeats whole turns of up to ``history`` tokens before it, or of
a quarter of what the system turn leaves; repeated turns carry no loss. A system
turn of more than half the budget stands in the first window alone. A stride is
then at least 3/16 of the budget, a stride makes two windows at most beside those
of longer turns, and all windows together hold less than eight times the tokens
of the turns, and one window.

Prefix sums are taken within blocks of a thousand turn numbers and over the
blocks' sums, so a conversation with a third of all rows is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelog.session import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that mean something to this template or to others.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
TURNS_PER_BLOCK = 1000
#: Tokens that the marks of a turn count for.
OVERHEAD = 4
_NO_BLANKS = "".join(rf"\p{{Is{script}}}" for script in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))


def escaped(text: Column, line: bool = False) -> Column:
    r"""``text`` without control strings: a backslash becomes ``\b``, and ``\i`` goes behind a control string's first
    character; in one line, a line feed becomes ``\n``. ``unescaped`` undoes it."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\i" + c[1:]))
    return F.replace(text, F.lit("\n"), F.lit("\\n")) if line else text


def unescaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\n"), F.lit("\n"))
    text = F.replace(text, F.lit("\\i"), F.lit(""))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def token_count(text: Column) -> Column:
    """A measure of tokens that needs no vocabulary: begun dozens of a word's characters, punctuation marks, and each
    character of scripts that write without blanks."""
    return F.regexp_count(text, F.lit(rf"(?U)[{_NO_BLANKS}]|[\w&&[^{_NO_BLANKS}]]{{1,12}}|[^\w\s]")).cast("long")


def placed_turns(conversations: DataFrame) -> DataFrame:
    """Turns with ``pos`` and ``before``: how many turns and tokens of the conversation come before."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    ).withColumn("cost", token_count(F.col("text")) + OVERHEAD)
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / TURNS_PER_BLOCK), F.lit(-(2**62))))
    sums = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("pos0"),
        F.coalesce(F.sum("cost").over(earlier), F.lit(0)).alias("before0"),
    )
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    inside = turns.withColumn("p", F.count("*").over(order)).withColumn("s", F.coalesce(F.sum("cost").over(order), F.lit(0)))
    joined = inside.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return joined.select(
        "conv_id", "role", "text", "cost", (F.col("pos0") + F.col("p")).alias("pos"), (F.col("before0") + F.col("s")).alias("before")
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, learn: str = "assistant") -> DataFrame:
    """One row per window: conv_id, first_pos (the place of its first new turn), n_turns (new ones), n_repeated,
    formatted, loss_spans (start and length in code points of the text to learn, escaped), n_tokens, over_budget.

    Turns are ordered by turn (null first), role and text; null roles and texts
    are empty; rows without a conv_id are one conversation; repeated rows are
    turns of their own; an empty table gives an empty result; other columns make
    no difference. Whole texts stay, also where one is over the budget.
    """
    turns = written(placed_turns(conversations))
    system = turns.filter("pos = 0 AND role = 'system'").select(
        F.col("conv_id").alias("sc"), F.col("cost").alias("system_cost"), F.col("role").alias("srole"), F.col("text").alias("stext")
    )
    system = system.filter(2 * F.col("system_cost") <= budget)
    left = F.lit(budget) - F.coalesce("system_cost", F.lit(0))
    turns = turns.join(system.select("sc", "system_cost"), _same("conv_id", "sc"), "left")
    turns = turns.withColumn("history", F.least(F.lit(history), F.floor(left / 4)))
    turns = turns.withColumn("stride", F.greatest(F.lit(1), F.floor((left - F.col("history")) / 2)))
    ends = F.floor((F.col("before") + F.col("cost") - 1) / F.col("stride"))
    # Sorts a long turn before the others that end in its stride.
    new = turns.withColumn("k", ends).withColumn("part", (F.col("cost") <= F.col("stride")).cast("int"))
    windows = new.groupBy("conv_id", "k", "part").agg(
        F.min("before").alias("w_before"), F.min("pos").alias("first_pos"), F.max("stride").alias("w_stride")
    )
    windows = windows.withColumn("place", F.floor(F.col("w_before") / F.col("w_stride")))
    w = windows.select(F.col("conv_id").alias("wc"), F.col("k").alias("wk"), F.col("part").alias("wpart"), "w_before", "first_pos", "place")

    piece = F.struct(F.col("ord"), F.col("pos"), F.col("role"), F.col("text"), F.col("cost"))
    fresh = new.select("conv_id", "k", "part", F.lit(2).alias("ord"), "pos", "role", "text", "cost")
    places = F.sequence(
        F.floor((F.col("before") + F.col("cost")) / F.col("stride")), F.floor((F.col("before") + F.col("history")) / F.col("stride"))
    )
    may = turns.filter((F.col("cost") <= F.col("history")) & ~((F.col("pos") == 0) & (F.col("role") == "system")))
    may = may.withColumn("at", F.explode(places))
    repeated = may.join(w, _same("conv_id", "wc") & (F.col("at") == F.col("place"))).filter(
        (F.col("pos") < F.col("first_pos")) & (F.col("w_before") - F.col("before") <= F.col("history"))
    )
    repeated = repeated.select("conv_id", F.col("wk").alias("k"), F.col("wpart").alias("part"), F.lit(1).alias("ord"), "pos", "role", "text", "cost")
    kept = w.filter("first_pos > 0").join(system, _same("wc", "sc")).select(
        F.col("wc").alias("conv_id"), F.col("wk").alias("k"), F.col("wpart").alias("part"), F.lit(0).alias("ord"),
        F.lit(0).cast("long").alias("pos"), F.col("srole").alias("role"), F.col("stext").alias("text"), F.col("system_cost").alias("cost"),
    )
    parts = fresh.unionByName(repeated).unionByName(kept)
    rows = parts.groupBy("conv_id", "k", "part").agg(F.sort_array(F.collect_list(piece)).alias("turns"))

    def shown(t: Column) -> Column:
        return F.struct(
            F.concat(F.lit(OPEN), escaped(t["role"], line=True), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
            ((t["ord"] == 2) & (t["role"] == learn)).alias("loss"),
        )

    rows = rows.withColumn("shown", F.transform("turns", shown))
    tail = CLOSE + "\n"
    whole = F.transform("shown", lambda s: F.concat(s["head"], s["body"], F.lit(tail)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, s: Column) -> Column:
        head, body = F.char_length(s["head"]).cast("long"), F.char_length(s["body"]).cast("long")
        span = F.array(F.struct((state["at"] + head).alias("start"), body.alias("length")))
        return F.struct(
            (state["at"] + head + body + len(tail)).alias("at"),
            F.when(s["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    is_new = lambda t: t["ord"] == 2
    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["cost"])
    return rows.select(
        "conv_id",
        F.element_at(F.filter("turns", is_new), 1)["pos"].alias("first_pos"),
        F.size(F.filter("turns", is_new)).cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["ord"] < 2)).cast("long").alias("n_repeated"),
        F.array_join(whole, "").alias("formatted"),
        F.aggregate("shown", start, step)["spans"].alias("loss_spans"),
        n_tokens.alias("n_tokens"),
        (n_tokens > budget).alias("over_budget"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted window, in order: array of (role, text), parsed and unescaped."""
    marked = F.split(formatted, r"<\|im_start\|>")
    marked = F.slice(marked, F.lit(2), F.size(marked))
    plain = F.transform(marked, lambda t: F.substring(t, F.lit(1), F.char_length(t) - len(CLOSE) - 1))
    role = lambda t: F.substring_index(t, "\n", 1)
    return F.transform(
        plain,
        lambda t: F.struct(
            unescaped(role(t)).alias("role"),
            unescaped(F.substring(t, F.char_length(role(t)) + 2, F.char_length(t))).alias("text"),
        ),
    )


def read_loss(formatted: str, loss_spans: str) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss_spans, lambda s: unescaped(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digests(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, read back from them.

    A conversation's digest needs its text in one row; nothing else here does.
    """
    new = F.slice(read_turns(F.col("formatted")), (F.col("n_repeated") + 1).cast("int"), F.col("n_turns").cast("int"))
    own = windows.select(
        "conv_id",
        "first_pos",
        F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.size(new).cast("long").alias("n"),
        F.array_join(read_loss("formatted", "loss_spans"), "").alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    rows = own.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
        F.sort_array(F.collect_list(F.struct("first_pos", "turns", "loss"))).alias("w"),
    )
    turns, loss = F.array_join(F.col("w.turns"), ""), F.array_join(F.col("w.loss"), "")
    return rows.select(
        "conv_id",
        "n_turns",
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
