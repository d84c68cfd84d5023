"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A `Template` declares the markers of a turn, the roles whose text bears loss, and the transitions of
the machine. The machine starts in `start`; a missing transition leads to `invalid` and stays there;
a conversation is valid when it ends in an accepting state. Every conversation is formatted, and its
validity is a column, so a caller can filter.

Texts may hold the template's control strings. Inside a text each backslash is doubled and `<|` becomes
`<\\|`; a role's line break becomes `<\\n`. No escaped text contains `<|`, so a marker in the output is
always the template's, and `unescaped` gives back the text.

Defined cases: NULL text and NULL role are empty. Turns are ordered by turn number (NULL first), then
role, then text; repeated rows are turns of their own. A NULL conversation id is one conversation. No
rows give no conversations. One conversation is one output row, so it is held as one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm.expr import let


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "instructed", ("start", "user"): "asked",
        ("instructed", "user"): "asked", ("asked", "assistant"): "answered",
        ("answered", "user"): "asked"})
    accepting: tuple[str, ...] = ("asked", "answered")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def _state(turns: Column, template: Template) -> Column:
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items()
                           for x in (f"{state}\n{role}", to)])
    return F.aggregate(turns, F.lit(template.start), lambda state, turn: F.coalesce(
        F.try_element_at(moves, F.concat(state, F.lit("\n"), turn["role"])), F.lit("invalid")))


def _segments(turns: Column, template: Template) -> Column:
    def of(turn: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(template.open), escaped_role(turn["role"]), F.lit(template.after_role)),
                 F.lit(False)),
            part(escaped(turn["text"]), turn["role"].isin(*template.loss_roles)),
            part(F.lit(template.close), F.lit(False)))
    return F.flatten(F.transform(turns, of))


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, state, valid, segments (text, loss) and formatted text."""
    empty = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    turns = conversations.select("conv_id", F.struct("turn", empty("role"), empty("text")).alias("turn"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    made = grouped.select("conv_id", _state(F.col("turns"), template).alias("state"),
                          _segments(F.col("turns"), template).alias("segments"))
    return made.select("conv_id", "state", F.col("state").isin(*template.accepting).alias("valid"), "segments",
                       F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(text: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted text holds, unescaped."""
    blocks = F.filter(F.split(text, "\\Q" + template.close + "\\E", -1), lambda b: b != "")

    def turn(block: Column) -> Column:
        inner = F.substr(block, F.lit(len(template.open) + 1))
        return let(F.instr(inner, template.after_role), lambda at: F.struct(
            unescaped_role(F.substr(inner, F.lit(1), at - 1)).alias("role"),
            unescaped(F.substr(inner, at + len(template.after_role))).alias("text")))
    return F.transform(blocks, turn)


def read_back(made: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what the output holds: its turns, and the text under the loss mask."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                    lambda s: unescaped(s["text"])), "")
    read = made.select("conv_id", "valid", "formatted",
                       read_turns(F.col("formatted"), template).alias("turns"), loss.alias("under_loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"), F.sha2("under_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
