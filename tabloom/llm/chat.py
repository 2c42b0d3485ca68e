"""Chat formatting in DataFrame functions only.

A template declares the control strings, which roles carry loss, and a finite-state machine over
roles. A conversation becomes text segments with a loss flag each; their texts in order are the
formatted conversation. Control strings inside a text are escaped, so that it can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """All control strings begin with ``opener``; ``moves[state][role]`` is the next state."""

    opener: str = "<|"
    turn_start: str = "<|im_start|>"
    turn_end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    begin: str = "begin"
    accept: tuple[str, ...] = ("answered",)
    moves: dict = field(
        default_factory=lambda: {
            "begin": {"system": "instructed", "user": "asked"},
            "instructed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )


CHATML = Template()


def escaped(c: Column, template: Template, newlines: bool = False) -> Column:
    """Double each backslash, then break each opener with one. Role names have their newlines escaped too."""
    head, tail = template.opener[0], template.opener[1:]
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(template.opener), F.lit(f"{head}\\{tail}"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if newlines else c


def unescaped(c: Column, template: Template) -> Column:
    tail = template.opener[1]
    parts = F.transform(
        F.split(c, r"\\\\", -1),
        lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit(f"\\{tail}"), F.lit(tail)),
    )
    return F.array_join(parts, "\\")


def _machine(roles: Column, template: Template) -> Column:
    """Runs the machine: its last state and the place of the first turn it refuses."""
    moves = F.create_map(
        *[F.lit(x) for s, to in template.moves.items() for r, t in to.items() for x in (f"{s}\n{r}", t)]
    )
    begin = F.struct(
        F.lit(template.begin).alias("state"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bad")
    )

    def step(at: Column, role: Column) -> Column:
        to = F.when(at["bad"].isNull(), F.element_at(moves, F.concat(at["state"], F.lit("\n"), role)))
        return F.struct(
            F.coalesce(to, at["state"]).alias("state"),
            (at["seen"] + 1).alias("seen"),
            F.coalesce(at["bad"], F.when(to.isNull(), at["seen"])).alias("bad"),
        )

    return F.aggregate(roles, begin, step)


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: conv_id, valid, first_bad_turn, segments, formatted.

    ``turns`` has conv_id, turn, role, text; turns are ordered by turn, then role and text, so ties
    and repeated rows have one order and all stay. Null texts and roles count as empty, null turns
    come first, and rows without a conv_id form one conversation. ``valid`` says that the machine
    took every turn and ended in an accepting state; ``first_bad_turn`` counts from 0. Conversations
    that it refuses are formatted all the same. Extra columns are not read; an empty table gives none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.turn_start), escaped(t["role"], template, True), F.lit("\n"))
        return F.array(
            piece(head, F.lit(False)),
            piece(escaped(t["text"], template), t["role"].isin(*template.loss_roles)),
            piece(F.lit(template.turn_end), F.lit(False)),
        )

    state = _machine(F.transform("turns", lambda t: t["role"]), template)
    chats = chats.select("conv_id", state.alias("m"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return chats.select(
        "conv_id",
        (F.col("m.bad").isNull() & F.col("m.state").isin(*template.accept)).alias("valid"),
        F.col("m.bad").alias("first_bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>."""
    end = "".join("\\" + c if not c.isalnum() and c != "\n" and c != "_" else c for c in template.turn_end)
    bodies = F.filter(F.split(formatted, end, -1), lambda b: F.length(b) > 0)

    def turn(body: Column) -> Column:
        rest = F.substring(body, F.lit(len(template.turn_start) + 1), F.length(body))
        cut = F.locate("\n", rest)
        return F.struct(
            unescaped(F.substring(rest, F.lit(1), cut - 1), template).alias("role"),
            unescaped(F.substring(rest, cut + 1, F.length(rest)), template).alias("text"),
        )

    return F.transform(bodies, turn)


def loss_text(segments: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescaped(s["text"], template)), "")
