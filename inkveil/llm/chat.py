"""Chat formatting: conversations cut at turns into windows of a token budget, with a loss mask.

Every turn is new in one window. A window holds the system turn, then at most `history` tokens of the turns before its
first new one, then as many new turns as fit: all of them are within the budget. What is repeated is masked, so that
each assistant text is a target once. Prefix sums of turn tokens, taken over segments of turns first, cut a conversation
into chunks, which are packed turn after turn, apart from each other: a very long conversation isn't summed or packed in
one task, and windows end where chunks do.

Edge cases: null role or text counts as empty; a null conv_id is a conversation of its own; null turns come last;
turns with the same number are ordered by role, then text, and each is kept; a turn longer than the budget is a
window alone; a system turn that doesn't fit beside a turn isn't repeated there, and one that leaves little room halves
it between history and new turns; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Tokens that a turn's marks count as.
MARKS = 3
BUDGET, HISTORY = 512, 128
_SEGMENT = 512
#: Budgets of a chunk, about.
_CHUNK = 64
#: What is followed by a backslash inside texts: a backslash, and the first character of a control string of the usual templates.
_ESCAPED = r"(\\|<(?=\||/?s>|</?SYS>>|/?SYS>>)|\[(?=/?INST\]))"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1\\\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _numbered(turns: DataFrame) -> DataFrame:
    """Adds place (from 0) and before (tokens of the turns before) of each turn."""
    t = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("bigint") + MARKS)
    t = t.withColumn("segment", F.floor(F.col("turn") / _SEGMENT))
    sums = t.groupBy("conv_id", "segment").agg(F.count("*").alias("n"), F.sum("tokens").alias("s"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("segment").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv_id", "segment", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"))
    o = offsets.select(F.col("conv_id").alias("c2"), F.col("segment").alias("g2"), "n0", "s0")
    t = t.join(o, t.conv_id.eqNullSafe(o.c2) & t.segment.eqNullSafe(o.g2))
    inside = Window.partitionBy("conv_id", "segment").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return t.select(
        "conv_id", "role", "text", "tokens",
        (F.col("n0") + F.count("text").over(inside)).alias("place"),
        (F.col("s0") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("before"),
    )


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (place of its first new turn), formatted, context (turns that are repeated), targets (start and length of the loss, in code points).

    A window has at most budget tokens, or else one turn alone.
    """
    if not 0 <= history < budget - history:
        raise ValueError("history has to be less than half the budget")
    n = _numbered(turns)
    rendered = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    n = n.select("*", F.struct((F.length(rendered) + 0).alias("lead"), F.length(escape(F.col("text"))).alias("body"), F.concat(rendered, escape(F.col("text")), F.lit(END)).alias("line"), (F.col("role") == "assistant").alias("target")).alias("turn_"))
    first = (F.col("place") == 0) & (F.col("role") == "system")
    system = n.where(first).select(F.col("conv_id").alias("c2"), F.col("turn_").alias("system"), F.col("tokens").alias("s"))
    # turns are packed chunk by chunk; a chunk's last turns can be history of the next one's windows
    size = _CHUNK * budget
    chunk = F.floor(F.col("before") / size)
    following = F.floor((F.col("before") + history) / size)
    dealt = n.select("conv_id", "place", "before", "tokens", "turn_", first.alias("is_system"), chunk.alias("own"), F.explode(F.when(first, F.array(chunk)).otherwise(F.array_distinct(F.array(chunk, following)))).alias("chunk"))
    item = F.struct("place", "before", "tokens", (F.col("chunk") == F.col("own")).alias("new"), "is_system", "turn_")
    grouped = dealt.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(item)).alias("items"))
    joined = grouped.join(system, grouped.conv_id.eqNullSafe(system.c2), "left")
    # what the system turn, history and new turns may take; a system turn beyond the budget isn't repeated
    joined = joined.withColumn("s", F.coalesce("s", F.lit(0))).withColumn("room", budget - F.when(F.col("s") < budget, F.col("s")).otherwise(0))
    joined = joined.withColumn("past", F.least(F.lit(history), F.floor((F.col("room") - 1) / 2))).withColumn("fresh", F.col("room") - F.col("past"))

    def pack(a: Column, x: Column) -> Column:
        """done: windows that are full; cur: the one being filled, whose size is without the system turn; its first is -1 before the first turn."""
        fits = (a.cur.first >= 0) & F.when(a.cur.size == 0, F.col("s") + x.tokens <= budget).otherwise(a.cur.size + x.tokens <= F.col("fresh"))
        more = F.struct(a.cur.first.alias("first"), a.cur.before.alias("before"), x.place.alias("last"), (a.cur.size + x.tokens).alias("size"), a.cur.sys.alias("sys"))
        other = F.struct(x.place.alias("first"), x.before.alias("before"), x.place.alias("last"), F.when(x.is_system, F.lit(0).cast("bigint")).otherwise(x.tokens).alias("size"), x.is_system.alias("sys"))
        return F.struct(
            F.when(fits | (a.cur.first < 0), a.done).otherwise(F.concat(a.done, F.array(a.cur))).alias("done"),
            F.when(fits, more).otherwise(other).alias("cur"),
        )

    window = "struct<first:bigint,before:bigint,last:bigint,size:bigint,sys:boolean>"
    none = F.expr(f"named_struct('done', cast(array() as array<{window}>), 'cur', cast(named_struct('first', -1, 'before', 0, 'last', -1, 'size', 0, 'sys', false) as {window}))")
    packed = F.aggregate(F.filter("items", lambda x: x.new), none, pack, lambda a: F.filter(F.concat(a.done, F.array(a.cur)), lambda w: w.first >= 0))

    def fill(w: Column) -> Column:
        repeated = ~w.sys & F.col("system").isNotNull() & (F.col("s") + w.size <= budget)
        left = F.least(F.col("past"), budget - w.size - F.when(repeated, F.col("s")).otherwise(0))
        kept = F.filter("items", lambda x: F.when(x.place < w.first, ~x.is_system & (x.before >= w.before - left)).otherwise(x.place <= w.last))
        return F.struct(
            w.first.alias("window"),
            F.concat(
                F.when(repeated, F.array(F.struct(F.lit(False).alias("new"), F.col("system").alias("turn_")))).otherwise(F.array().cast("array<struct<new:boolean,turn_:struct<lead:int,body:int,line:string,target:boolean>>>")),
                F.transform(kept, lambda x: F.struct((x.place >= w.first).alias("new"), x.turn_.alias("turn_"))),
            ).alias("turns"),
        )

    packed = joined.withColumn("windows", packed)
    out = packed.select("conv_id", F.explode(F.transform("windows", fill)).alias("w")).select("conv_id", "w.window", "w.turns")
    spans = F.aggregate(
        "turns",
        F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,length:int>>))"),
        lambda a, x: F.struct(
            (a.at + F.length(x.turn_.line)).alias("at"),
            F.when(x.new & x.turn_.target, F.concat(a.spans, F.array(F.struct((a.at + x.turn_.lead).alias("start"), x.turn_.body.alias("length"))))).otherwise(a.spans).alias("spans"),
        ),
        lambda a: a.spans,
    )
    return out.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda x: x.turn_.line), "").alias("formatted"),
        F.size(F.filter("turns", lambda x: ~x.new)).alias("context"),
        spans.alias("targets"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of the new turns), losses (the texts under the mask), both unescaped."""
    lines = F.split("formatted", r"<\|im_end\|>", -1)
    new = F.slice(lines, F.col("context") + 1, F.greatest(F.size(lines) - 1 - F.col("context"), F.lit(0)))
    sides = F.transform(new, lambda x: F.split(F.substr(x, F.lit(len(START) + 1)), r"<\|im_sep\|>", 2))
    return formatted.select(
        "conv_id",
        "window",
        F.transform(sides, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text"))).alias("turns"),
        F.transform("targets", lambda x: unescape(F.substr("formatted", x.start + 1, x.length))).alias("losses"),
        F.length("formatted").cast("bigint").alias("chars"),
    )


#: A conversation of control strings that the query adds.
PROBE = (-7, ("user", "assistant"), "</s>[INST] ok [/INST]")


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, roles, text = PROBE
    probe = spark.createDataFrame([(conv, i, r, text) for i, r in enumerate(roles)], "conv_id bigint, turn bigint, role string, text string")
    back = read_back(windows(turns.unionByName(probe)))
    back = back.select(
        "conv_id", "window", "chars",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "").alias("said"),
        F.array_join("losses", "").alias("lost"),
    )
    # a digest of a whole conversation takes its text in one place
    whole = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "said", "lost"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    lost = F.array_join("w.lost", "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"),
        F.length(lost).cast("bigint").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )


def brute(turns: list[tuple]) -> dict:
    """conv_id to n_turns, turns_sha256, loss_chars, loss_sha256, from rows (conv_id, turn, role, text)."""
    by: dict = {}
    for conv, turn, role, text in turns:
        by.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, rows in by.items():
        rows.sort()
        lost = "".join(t for *_, r, t in rows if r == "assistant")
        out[conv] = (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in rows).encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    return out
