"""Chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over the roles checks the order of turns. Each turn becomes three segments,
mark, text, mark, and each segment has a loss flag. Control strings inside texts are escaped: a
backslash is doubled, and a control string gets one after its first character, so no text
holds a control string and `unescape` gives the text back.

Defined results: a null text is empty, a null role is an empty role and makes the order invalid;
turns are ordered by turn (null first), then role, then text, so ties and repeated rows keep
a fixed order and all count; rows with a null conv_id form one conversation; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What the output looks like, and which role may follow which."""

    begin: str = "<s>"
    #: role: (mark before, mark after, whether its text counts for the loss)
    turns: dict = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("[OUT] ", "</s>", True)})
    #: Any other role is written out: mark, role, mark, text, mark.
    other: tuple = ("[TURN] ", " [AS] ", " [/TURN]")
    #: state: roles that may come next; a state is the last role.
    follows: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepts: tuple = ("assistant",)

    @property
    def control(self) -> list[str]:
        marks = [self.begin, *self.other, *(m for t in self.turns.values() for m in t[:2])]
        return sorted({m.strip() for m in marks})


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, m: F.replace(t, F.lit(m), F.lit(f"{m[0]}\\{m[1:]}")), template.control, text)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, template: Template, place: int, other: Column) -> Column:
    picks = [(role == name, F.lit(turn[place])) for name, turn in template.turns.items()]
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(picks), other)


def format_chats(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """rows: conv_id, turn, role, text. Returns conv_id, n_turns, valid, bad_turn (place of the first
    turn out of order, or null), segments (text, loss), formatted."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    # The machine: a move for each allowed pair of state and role; without a move it stays in error.
    moves = [F.lit(x) for state, roles in template.follows.items() for role in roles for x in (f"{state}>{role}", role)]
    moves = F.create_map(*moves)
    step = lambda s, t: F.struct(
        F.coalesce(F.try_element_at(moves, F.concat(s["state"], F.lit(">"), t["role"])), F.lit("error")).alias("state"),
        (s["seen"] + 1).alias("seen"),
        F.when(s["bad"].isNull() & F.try_element_at(moves, F.concat(s["state"], F.lit(">"), t["role"])).isNull(), s["seen"]).otherwise(s["bad"]).alias("bad"),
    )
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("bad"))
    chats = chats.withColumn("end", F.aggregate("turns", begin, step))

    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    turn_segments = lambda t: F.array(
        segment(_by_role(t["role"], template, 0, F.concat(F.lit(template.other[0]), escape(t["role"], template), F.lit(template.other[1]))), no),
        segment(escape(t["text"], template), _by_role(t["role"], template, 2, no)),
        segment(_by_role(t["role"], template, 1, F.lit(template.other[2])), no),
    )
    chats = chats.withColumn("segments", F.concat(F.array(segment(F.lit(template.begin), no)), F.flatten(F.transform("turns", turn_segments))))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.col("end.state").isin(*template.accepts).alias("valid"),
        F.col("end.bad").alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def _quote(mark: str) -> str:
    return "".join(f"\\{x}" if x in "[]/<>|" else x for x in mark)


def read_turns(formatted: str | Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    opens = "|".join(_quote(m) for m in [*(t[0] for t in template.turns.values()), template.other[0]])
    closes = "|".join(_quote(m) for m in [*(t[1] for t in template.turns.values()), template.other[2]])
    pattern = F.lit(f"(?s)({opens})(.*?)({closes})")
    marks, bodies = F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2))
    named = reduce(lambda m, x: [*m, F.lit(x[1][0]), F.lit(x[0])], template.turns.items(), [])
    role_of, split = F.create_map(*named), template.other[1]

    def turn(mark: Column, body: Column) -> Column:
        written = F.substring_index(body, split, 1)
        text = F.when(mark == template.other[0], F.substring(body, F.char_length(written) + len(split) + 1, F.char_length(body))).otherwise(body)
        return F.struct(F.coalesce(F.try_element_at(role_of, mark), unescape(written)).alias("role"), unescape(text).alias("text"))

    return F.zip_with(marks, bodies, turn)


def read_loss(segments: str | Column) -> Column:
    """All text under the loss mask, in order."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
