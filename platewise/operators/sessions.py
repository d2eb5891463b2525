"""Chat sessions: question and answer pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTORY_LIMIT = 7
PART_TURNS = 100


def question_routing(questions: DataFrame, keyword: str = "schedule", column: str = "text") -> DataFrame:
    """Flags questions that need the schedule block."""
    return questions.withColumn("needs_schedule", mentions_word(F.col(column), keyword))


def mentions_word(text: Column, keyword: str) -> Column:
    return F.lower(text).contains(keyword.lower())


def session_turns(conversations: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Question and answer of each exchange, with whether the session's history is used.

    A user turn pairs with the assistant turn right after it. Turns are
    numbered without gaps, so the pairing is a join on (session, turn), which
    spreads one long session over the cluster where a window would not. The
    history counts only while the session has fewer than ``limit`` pairs.
    """
    asked = conversations.filter("role = 'user'").select(
        "conv_id", F.col("turn").alias("asked_at"), (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    answered = conversations.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    pairs = asked.join(answered, ["conv_id", "turn"])
    sizes = pairs.groupBy("conv_id").agg(F.count("*").alias("pairs"))
    return pairs.join(sizes, "conv_id").select(
        "conv_id",
        F.col("asked_at").alias("turn"),
        "question",
        "answer",
        "pairs",
        (F.col("pairs") < limit).alias("history_used"),
    )


def unanswered_turns(conversations: DataFrame) -> DataFrame:
    """User turns without an assistant turn right after them, which :func:`session_turns` leaves out."""
    asked = conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return asked.join(answered, ["conv_id", "turn"], "left_anti")


def session_history(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """History text of every session, in parts of at most ``part_turns`` turns.

    ``history_used`` says whether the session is short enough for its history to
    be shown; no history is left out here.
    """
    line = F.concat(F.lit("Vendor_Question: "), "question", F.lit("\nSystem_Answer: "), "answer")
    return (
        turns.withColumn("line", line)
        .groupBy("conv_id", F.floor(F.col("turn") / part_turns).alias("part"), "history_used")
        .agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY turn)").alias("history"))
    )
