"""Quotation linking: find the message that a quoted passage comes from, in DataFrame functions only.

Lines that begin with ``>`` are quoted, one level for each mark. Neighbouring lines of one level are a passage. What a
message says itself (level 0) and what it quotes are cut into units: the passage, its paragraphs and its lines, each
normalised and hashed. A quoted unit joins the first message of the conversation that says it itself. Of all messages a
message quotes, it replies to the one found through the lowest level, then through the longest unit, then to the latest.
Following replies upwards (by doubling, so that long chains take few rounds) gives each message its thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import staged, text_or_empty


def passages(text: Column) -> Column:
    """Array of (level, text): runs of neighbouring lines with equally many quote marks, without the marks."""
    lines = F.transform(
        F.split(text, r"\r?\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1), "[^>]", "")).alias("level"),
            F.regexp_replace(line, r"^(?:[ \t]*>)+ ?", "").alias("line"),
        ),
    )
    return _runs(lines)


def _runs(lines: Column) -> Column:
    def cut(numbered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(numbered) - 1), lambda i: (i == 0) | (F.get(numbered, i)["level"] != F.get(numbered, F.greatest(i - 1, F.lit(0)))["level"])
        )
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda at, k: _passage(numbered, s, at, k)))[0]

    return F.transform(F.array(lines), cut)[0]


def _passage(numbered: Column, starts: Column, at: Column, k: Column) -> Column:
    end = F.coalesce(F.get(starts, k + 1), F.size(numbered))
    own = F.transform(F.slice(numbered, at + 1, end - at), lambda x: x["line"])
    return F.struct(F.get(numbered, at)["level"].alias("level"), F.array_join(own, "\n").alias("text"))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def units(text: Column) -> Column:
    """The normalised passage, paragraphs and lines of a text, each once, without empty ones."""
    parts = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, r"\n"))
    return F.filter(F.array_distinct(F.transform(parts, normalised)), lambda u: u != "")


def _replies(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of messages that quote an earlier one."""
    said = parsed.select("conv_id", "turn", F.explode(units(F.col("body"))).alias("unit"))
    runs = parsed.select("conv_id", "turn", F.explode(F.filter("passages", lambda p: p["level"] == 0)).alias("p"))
    said = said.union(runs.select("conv_id", "turn", F.explode(units(F.col("p.text"))).alias("unit")))
    origin = said.groupBy("conv_id", F.sha2("unit", 256).alias("hash")).agg(F.min("turn").alias("parent_turn"))
    quoted = parsed.select("conv_id", "turn", F.explode(F.filter("passages", lambda p: p["level"] > 0)).alias("p"))
    quoted = quoted.select("conv_id", "turn", "p.level", F.explode(units(F.col("p.text"))).alias("unit"))
    quoted = quoted.select("conv_id", "turn", "level", F.length("unit").alias("long"), F.sha2("unit", 256).alias("hash"))
    found = quoted.join(origin, ["conv_id", "hash"]).where("parent_turn < turn")
    best = F.max(F.struct(-F.col("level"), "long", "parent_turn"))
    return found.groupBy("conv_id", "turn").agg(best["parent_turn"].alias("parent_turn"))


def _threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of all replies: the message a thread starts with, and the steps from it."""
    state = staged(replies.select("conv_id", "turn", F.col("parent_turn").alias("thread_turn"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("up"), F.col("depth").alias("more"))
        further = state.join(up, ["conv_id", "thread_turn"], "left")
        if further.where("up is not null").isEmpty():
            return state
        state = staged(further.select("conv_id", "turn", F.coalesce("up", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def linked_messages(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, n_quotes, parent_turn, thread_turn, depth, body, formatted.

    ``body`` is the text without quoted lines, trimmed; ``formatted`` is the body under a heading of its role. Ordered by
    (conv_id, thread_turn, turn), every reply stands after what it replies to, within its thread; a message that
    quotes nothing known starts a thread. ``parent_turn`` is always less than ``turn``. Rows that share (conv_id, turn)
    are one place in a conversation and share the parent. Messages without conv_id or turn link to nothing. Null texts
    are empty, null roles stay null and are headed as ``user``. An empty table gives an empty result.
    """
    parsed = messages.select("conv_id", "turn", "role", passages(text_or_empty()).alias("passages"))
    own = F.filter("passages", lambda p: p["level"] == 0)
    body = F.regexp_replace(F.array_join(F.transform(own, lambda p: p["text"]), "\n"), r"^\s+|\s+$", "")
    quotes = F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long")
    parsed = staged(parsed.select("*", body.alias("body"), quotes.alias("n_quotes")))
    replies = staged(_replies(parsed.where("conv_id is not null and turn is not null")))
    placed = replies.join(_threads(replies), ["conv_id", "turn"])
    out = parsed.join(placed, ["conv_id", "turn"], "left")
    heading = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    return out.select(
        "conv_id", "turn", "role", "n_quotes", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "body", heading.alias("formatted"),
    )
