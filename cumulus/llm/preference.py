"""Operator 6: preference formatting, in DataFrame functions only.

A pair is a chosen and a rejected conversation.  Their longest common prefix of
turns is rendered once, as the prompt; what follows on either side is rendered as a
completion whose mask marks the assistant's own characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.llm.staging import staged
from cumulus.operators.ordered import shifted

# ---- fixed values: the chat template --------------------------------------------------------
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"
OUTPUT = ("prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans")


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(id, turns): the turns of every conversation as an array of (role, text), in their order.

    Rows without an id belong to no conversation and are left out.  Null turn
    numbers come last; a null role or text is ''.  A row that repeats another counts
    once; several texts of one turn number follow each other by role and text.
    """
    row = F.struct(F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"),
                   F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = conversations.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.array_distinct(F.sort_array(F.collect_list(row))).alias("turns"))
    return whole.select("id", F.transform("turns", lambda x: F.struct(
        x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _render(turns: str) -> str:
    """SQL: turns by the chat template."""
    return f"array_join(transform({turns}, t -> concat('{OPEN}', t.role, '{MIDDLE}', t.text, '{CLOSE}')), '')"


def _spans(turns: str) -> str:
    """SQL: (start, length) of the assistant's texts with their closing marks in the rendered turns."""
    head = f"length(concat('{OPEN}', t.role, '{MIDDLE}'))"
    return (f"filter(transform({turns}, (t, i) -> named_struct('start', aggregate(slice({turns}, 1, i), 0L, (a, u) -> "
            f"a + length(concat('{OPEN}', u.role, '{MIDDLE}', u.text, '{CLOSE}'))) + {head}, 'length', "
            f"cast(CASE WHEN t.role = '{ASSISTANT}' THEN length(concat(t.text, '{CLOSE}')) ELSE 0 END AS bigint))), "
            "s -> s.length > 0)")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace the two arrays of turns by prompt, prompt_turns, and both completions with their masks.

    chosen_spans and rejected_spans are the (start, length) of the characters to
    train on, counted in code points of the completion.  A null array is empty; equal
    conversations are all prompt, with empty completions.  Other columns stay,
    whatever their names; one named like a column of the result is replaced.
    """
    kept = {f"other_{i}": c for i, c in enumerate(pairs.columns) if c not in (chosen, rejected, *OUTPUT)}
    apart = pairs.toDF(*["chosen" if c == chosen else "rejected" if c == rejected else f"other_{i}"
                         for i, c in enumerate(pairs.columns)])
    none = "cast(array() AS array<struct<role:string,text:string>>)"
    sides = apart.select(*kept, F.expr(f"coalesce(chosen, {none})").alias("__c"),
                         F.expr(f"coalesce(rejected, {none})").alias("__r"))
    agree = F.expr("""
        CASE WHEN least(size(__c), size(__r)) = 0 THEN 0
             ELSE coalesce(nullif(array_position(transform(sequence(0, least(size(__c), size(__r)) - 1),
                    i -> __c[i].role = __r[i].role AND __c[i].text = __r[i].text), false), 0) - 1,
                  least(size(__c), size(__r))) END""")
    sides = sides.withColumn("__k", agree.cast("int"))
    sides = sides.select(*kept, F.col("__k").cast("long").alias("prompt_turns"), F.expr("slice(__c, 1, __k)").alias("__p"),
                         F.expr("slice(__c, __k + 1, size(__c))").alias("__c"),
                         F.expr("slice(__r, __k + 1, size(__r))").alias("__r"))
    return sides.select(*[F.col(new).alias(old) for new, old in kept.items()], "prompt_turns", F.expr(_render("__p")).alias("prompt"),
                        F.expr(_render("__c")).alias("chosen"), F.expr(_render("__r")).alias("rejected"),
                        F.expr(_spans("__c")).alias("chosen_spans"), F.expr(_spans("__r")).alias("rejected_spans"))


def partners(openings: DataFrame) -> DataFrame:
    """(id, rejected_id) of ``openings(id, opening)``: the next larger id of the same opening, for all that have one.

    Rows are ordered by opening and id over range partitions, so an opening that a
    third of all conversations share is spread over many tasks and no neighbour is lost.
    """
    after = shifted(openings, [F.col("opening"), F.col("id")], 1, {"next_opening": "opening", "rejected_id": "id"})
    return after.where("opening = next_opening").select("id", "rejected_id")


def pairs_of(conversations: DataFrame, **names: str) -> DataFrame:
    """One pair per conversation, which is its chosen side: (conv_id, rejected_id, chosen, rejected).

    The rejected side is the conversation with the next larger id, in the whole
    table, that opens with the same turn.  Without one, it is the conversation itself
    with another last answer: its first one given again, or, where that is the same,
    an empty one (rejected_id is null then).
    """
    whole = turns_of(conversations, **names)
    first_turn = F.element_at("turns", 1)
    opening = F.sha2(F.concat_ws(":", F.length(first_turn["role"]), first_turn["role"], first_turn["text"]), 256)
    openings = staged(whole.select("id", opening.alias("opening")), "openings")
    others = whole.select(F.col("id").alias("rejected_id"), F.col("turns").alias("other"))
    # An id has one follower at most and follows one at most, and no key is null, so neither join has a hot key.
    rows = whole.join(partners(openings).join(others, "rejected_id"), "id", "left")
    last = (f"coalesce(array_max(filter(transform(turns, (t, i) -> CASE WHEN t.role = '{ASSISTANT}' THEN i ELSE -1 END), "
            "i -> i >= 0)), -1)")
    first = f"element_at(filter(turns, t -> t.role = '{ASSISTANT}'), 1).text"
    rows = rows.withColumn("__last", F.expr(last))
    rows = rows.withColumn("__first", F.expr(f"CASE WHEN __last >= 0 THEN {first} END"))
    own = F.expr("transform(turns, (t, i) -> named_struct('role', t.role, 'text', CASE WHEN i = __last THEN "
                 "CASE WHEN t.text = __first THEN '' ELSE __first END ELSE t.text END))")
    return rows.select(F.col("id").alias("conv_id"), "rejected_id", F.col("turns").alias("chosen"),
                       F.coalesce("other", own).alias("rejected"))
