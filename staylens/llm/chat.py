r"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns. Prefix sums of turn tokens choose the spans: the budget,
less the system turn and the history, is halved into a stride; a span holds the turns that begin within one
stride, and a turn longer than a stride is a span alone. So a window keeps to its budget unless a single turn
(or the system turn) exceeds it, and no turn is cut. Each window begins with the system turn, then repeats
those turns of the span before it that begin within ``history`` tokens of its start, then has its own. Only
assistant turns of the window's own span are under the loss mask, so each is trained once.

Template: ``<turn>role``, a line end, the text, ``</turn>`` and a line end; a repeated turn starts with
``<again>``. Within roles and texts a backslash is doubled, and a backslash is put into every control string
behind its first character, so the formatted text never holds one that is not markup; ``unescaped`` is exact.

Prefix sums run within pieces of a range sort and are joined with the sums of earlier pieces, so a
conversation with a third of all turns spreads over many tasks; a window is bounded by its budget.

A null role or text is the empty one; null conversation ids are one conversation; null turn numbers come
first, equal ones are ordered by role and text. Copies of a turn are turns of their own. Only conv_id, turn,
role and text are read. Everything is Spark's own expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import WORD, filled, let, shuffle_partitions, starts
from staylens.session import staged

BUDGET = 2048
HISTORY = 512

# The markup.
OWN, AGAIN, CLOSE = "<turn>", "<again>", "</turn>"
SYSTEM, TRAINED = "system", "assistant"

# What the markup and the role add to the words of a turn.
TURN_TOKENS = 4


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, "<(?=/?turn>|again>)", r"<\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    r"""A role as one line: a line end becomes ``\`` and ``n`` before the rest is escaped."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def markup(own: Column, role: Column, text: Column) -> Column:
    """One turn as it stands in a window; ``role`` and ``text`` are escaped."""
    opening = F.when(own, F.lit(OWN)).otherwise(F.lit(AGAIN))
    return F.concat(opening, role, F.lit("\n"), text, F.lit(f"{CLOSE}\n"))


def _summed(turns: DataFrame) -> DataFrame:
    """The turns with ``start`` and ``upto``: tokens of the conversation before and with the turn."""
    order = ["conv", "turn", "role", "text"]
    dealt = turns.repartitionByRange(shuffle_partitions(turns), *order)
    pieces = staged(dealt.withColumn("piece", F.spark_partition_id()), "chat-turns")
    ends = pieces.groupBy("conv", "piece").agg(F.sum("tokens").alias("end"))
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.withColumn("offset", F.coalesce(F.sum("end").over(before), F.lit(0))).drop("end")
    within = Window.partitionBy("conv", "piece").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = pieces.withColumn("own", F.sum("tokens").over(within))
    upto = F.col("own") + F.col("offset")
    return (
        summed.join(offsets, ["conv", "piece"])
        .withColumn("upto", upto)
        .withColumn("start", upto - F.col("tokens"))
        .drop("own", "offset", "piece")
    )


def windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """Per window: conv_id, window (its place, ascending), formatted, loss (spans), tokens, n_own.

    ``loss`` is an array of (start, end) in code points of ``formatted``, the end exclusive.
    """
    role, text = filled(F.col("role")), filled(F.col("text"))
    turns = conversations.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        (F.regexp_count(text, F.lit(WORD)) + TURN_TOKENS).cast("long").alias("tokens"),
    )
    summed = staged(_summed(turns), "chat-summed")

    # The first turn of a conversation, if the system's, is kept in all its windows.
    system = summed.filter((F.col("start") == 0) & (F.col("role") == SYSTEM)).select(
        "conv", F.col("text").alias("rules"), F.col("tokens").alias("rules_tokens")
    )
    known = summed.join(system, "conv", "left").withColumn(
        "rules_tokens", F.coalesce("rules_tokens", F.lit(0))
    )
    stride = F.greatest(
        F.lit(1), F.floor((F.lit(budget) - F.lit(history) - F.col("rules_tokens")) / 2)
    ).cast("long")
    first = (F.col("start") == 0) & F.col("rules").isNotNull()
    wide = known.withColumn("stride", stride).withColumn(
        "alone", (F.col("tokens") > F.col("stride")) & ~first
    )
    # Turns that begin in one stride are a span; one that stands alone ends it and begins another.
    # Strides are at most ``budget`` tokens and a turn has at least one, so this window is bounded.
    # Strides are counted behind the system turn, which belongs to the first.
    place = F.greatest(F.lit(0), F.col("start") - F.col("rules_tokens"))
    block = F.floor(place / F.col("stride"))
    within = Window.partitionBy("conv", "block").orderBy("start")
    after_alone = F.coalesce(F.lag("alone").over(within), F.lit(True))
    begins = (F.col("alone") | after_alone).cast("int")
    spans = wide.withColumn("block", block).withColumn("begins", begins)
    spans = spans.withColumn("part", F.sum("begins").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    of_span = Window.partitionBy("conv", "block", "part")
    spans = spans.withColumn("window", F.min("start").over(of_span)).withColumn(
        "next", F.max("upto").over(of_span)
    )

    own = spans.withColumn("own", F.lit(True))
    repeated = spans.filter((F.col("next") - F.col("start") <= history) & ~first)
    both = own.unionByName(repeated.withColumn("window", F.col("next")).withColumn("own", F.lit(False)))
    member = F.struct(
        "start", "own", escaped_role(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"),
        (F.col("role") == TRAINED).alias("trained"),
    )
    grouped = both.groupBy("conv", "window").agg(
        F.first("conv_id", ignorenulls=True).alias("conv_id"),
        F.max("rules").alias("rules"),
        F.max("rules_tokens").alias("rules_tokens"),
        F.sum("tokens").alias("turn_tokens"),
        F.count_if("own").cast("long").alias("n_own"),
        F.sort_array(F.collect_list(member)).alias("members"),
    )
    # A span that repeats into nothing was the last.
    full = grouped.filter("n_own > 0")
    shows_rules = F.col("rules").isNotNull() & (F.col("window") > 0)
    rules = F.when(
        shows_rules, markup(F.lit(False), F.lit(SYSTEM), escaped(F.col("rules")))
    ).otherwise(F.lit(""))

    def laid_out(parts: Column, members: Column) -> Column:
        def spans_of(at: Column) -> Column:
            return F.filter(
                F.transform(
                    members,
                    lambda m, i: F.when(
                        m["own"] & m["trained"],
                        F.struct(
                            (F.get(at, i) + _head(m)).alias("start"),
                            (F.get(at, i) + _head(m) + F.length(m["text"])).alias("end"),
                        ),
                    ),
                ),
                lambda s: s.isNotNull(),
            )

        lengths = F.concat(F.array(F.length("rules_text")), F.transform(parts, F.length))
        return let(F.slice(starts(lengths), 2, F.greatest(F.size(parts), F.lit(1))), spans_of)

    parts = F.transform("members", lambda m: markup(m["own"], m["role"], m["text"]))
    extra = F.when(shows_rules, F.col("rules_tokens")).otherwise(F.lit(0))
    return (
        full.withColumn("rules_text", rules)
        .withColumn("parts", parts)
        .select(
            "conv_id",
            "conv",
            "window",
            F.concat("rules_text", F.array_join("parts", "")).alias("formatted"),
            laid_out(F.col("parts"), F.col("members")).alias("loss"),
            (F.col("turn_tokens") + extra).alias("tokens"),
            "n_own",
        )
    )


def _head(member: Column) -> Column:
    """Characters of a turn of the window's own before its text."""
    return F.length(member["role"]) + len(OWN) + 1


def own_turns(formatted: Column) -> Column:
    """Read back from a formatted window: its own turns as (role, text), without the repeated."""
    pieces = F.split(formatted, f"{CLOSE}\n", -1)
    own = F.filter(pieces, lambda p: p.startswith(OWN))
    return F.transform(
        own,
        lambda p: F.struct(
            unescaped_role(F.substring_index(F.substring(p, F.lit(len(OWN) + 1), F.length(p)), "\n", 1)).alias("role"),
            unescaped(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """Read back from a formatted window: the text under the loss mask."""
    parts = F.transform(
        loss, lambda s: unescaped(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))
    )
    return F.array_join(parts, "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: turns, loss text and their digests.

    A digest needs the whole conversation in one row, whatever its length.
    """
    own = own_turns(F.col("formatted"))
    turns_text = F.array_join(
        F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    read = formatted.select(
        "conv_id",
        "conv",
        "window",
        F.size(own).cast("long").alias("n_turns"),
        turns_text.alias("turns"),
        loss_text(F.col("formatted"), F.col("loss")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("window", "turns", "loss")))
    joined = read.groupBy("conv").agg(
        F.first("conv_id", ignorenulls=True).alias("conv_id"),
        F.sum("n_turns").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
        in_order.alias("parts"),
    )
    turns = F.array_join(F.transform("parts", lambda p: p["turns"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
