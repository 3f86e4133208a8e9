"""Chat formatting with loss masks, as DataFrame expressions only.

A declarative template names the roles, the allowed successor of every state, and the marks
around a turn. A conversation's turns, in order, drive a finite-state machine (a fold over the
roles); the same turns become text segments, each with a flag that says whether the training
loss covers it. Control characters inside texts are escaped, so the formatted string can be
read back without loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turns of one conversation are first assembled in blocks of this many turn numbers, so that
# the rows of a very long conversation are spread before its single output row is made.
BLOCK = 256


@dataclass(frozen=True)
class Template:
    """``follows`` maps a state (``start`` or the last role) to the roles allowed next."""

    opening: str = "### "
    after_role: str = ": "
    closing: str = "</turn>\n"
    trained: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    accepting: tuple[str, ...] = ("assistant",)
    # Escape code of every character that starts a mark or an escape; the backslash comes first.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    for char, code in template.escapes:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    for char, code in reversed(template.escapes):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _state(template: Template, turns: Column) -> Column:
    """State after the last turn; ``invalid`` from the first turn that is not allowed."""
    moves = F.create_map(
        *(
            F.lit(part)
            for state, roles in template.follows.items()
            for role in roles
            for part in (f"{state}\n{role}", role)
        )
    )
    return F.aggregate(
        turns,
        F.lit("start"),
        lambda state, turn: F.coalesce(
            F.try_element_at(moves, F.concat(state, F.lit("\n"), turn["role"])), F.lit("invalid")
        ),
    )


def format_conversations(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, final_state, valid, segments array<struct<text, loss>>, formatted).

    ``turns``: (conv_id, turn, role, text). Turns are ordered by (turn, role, text), nulls
    first; a null role or text counts as empty; rows with a null conv_id form a conversation of
    their own; repeated rows are turns of their own. Unknown roles are formatted and make the
    conversation invalid. An empty table gives an empty table; other columns are not read.
    """
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / BLOCK).alias("block"),
        F.struct(
            "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("entry"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    blocks = blocks.select(
        "conv_id",
        F.struct(
            "block",
            F.transform(
                "entries",
                lambda e: F.struct(
                    e["role"].alias("role"),
                    F.concat(
                        F.lit(template.opening), escape(e["role"], template), F.lit(template.after_role)
                    ).alias("head"),
                    escape(e["text"], template).alias("body"),
                ),
            ).alias("entries"),
        ).alias("part"),
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    ordered = whole.select("conv_id", F.flatten(F.transform("parts", lambda p: p["entries"])).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["body"].alias("text"), t["role"].isin(*template.trained).alias("loss")),
                F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return (
        ordered.select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            _state(template, F.col("turns")).alias("final_state"),
            segments.alias("segments"),
        )
        .withColumn("valid", F.col("final_state").isin(*template.accepting))
        .withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))
    )


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns of a formatted string, array<struct<role, text>>, exactly as they went in."""
    pieces = F.split(formatted, template.closing)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.opening) + 1))
        gap = F.instr(body, template.after_role)
        return F.struct(
            unescape(F.substr(body, F.lit(1), gap - 1), template).alias("role"),
            unescape(F.substr(body, gap + len(template.after_role)), template).alias("text"),
        )

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, as it went in."""
    trained = F.filter(segments, lambda s: s["loss"])
    return F.concat_ws("", F.transform(trained, lambda s: unescape(s["text"], template)))
