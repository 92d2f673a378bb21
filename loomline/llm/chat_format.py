"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags per segment.

All of it is DataFrame expressions. A conversation's turns are gathered into one array (a conversation is the unit of
output, so it is also the unit of memory); the machine is a fold over that array, the segments a transform of it.

Defined cases: a null text is empty; a null role is its own role, written apart from the empty role; turns tie-break on
role, then text, and repeated rows stay as repeated turns; a null ``turn`` sorts first; rows with a null ``conv_id``
form one conversation; an empty table gives no rows; extra columns are dropped before anything else, so clashing names
do no harm. Conversations whose order is invalid are formatted all the same and flagged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, and which of them are trained on.

    ``open`` gives the tag of each known role; any other role is written as ``[ROLE]name[/ROLE] ``. All control strings
    begin with ``[`` or ``<``; inside texts and role names these two and the backslash get a backslash after them, so
    no control string can appear there, and the change is undone exactly. A template with other control strings, or
    with tags that begin alike, is refused.
    """

    open: tuple[tuple[str, str], ...] = (("system", "[SYS] "), ("user", "[INST] "), ("assistant", "[/INST] "))
    begin: str = "<s>"
    end: str = "</s>"
    trained: tuple[str, ...] = ("assistant",)
    #: state, role, next state; a turn without an entry makes the conversation invalid from there on
    machine: tuple[tuple[str, str, str], ...] = field(
        default=(
            ("start", "system", "briefed"),
            ("start", "user", "asked"),
            ("briefed", "user", "asked"),
            ("asked", "assistant", "answered"),
            ("answered", "user", "asked"),
        )
    )
    accepting: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        tags = [tag for _, tag in self.open]
        for control in (self.begin, self.end, *tags):
            if len(control) < 2 or control[0] not in "[<" or control[1] == "\\":
                raise ValueError(f"a control string begins with [ or < and has another character, no backslash: {control!r}")
        for one in tags:
            if any(one.startswith(other) for other in ("[ROLE]", "[ROLE/] ", *(t for t in tags if t is not one))) or "[ROLE]".startswith(one):
                raise ValueError(f"no tag begins with another one: {one!r}")
        if self.end in self.begin or any(self.end in tag for tag in (*tags, "[ROLE]", "[/ROLE] ", "[ROLE/] ")):
            raise ValueError("the end of a turn is part of another control string")


DEFAULT = Template()


def escape(text: Column) -> Column:
    """``[``, ``<`` and backslash are followed by a backslash."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("["), F.lit("[\\")), F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``, from left to right."""
    return F.when(F.instr(text, "\\") > 0, F.regexp_replace(text, r"([\[<\\])\\", "$1")).otherwise(text)


def _tag(role: Column, template: Template) -> Column:
    other = F.when(role.isNull(), F.lit("[ROLE/] ")).otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE] ")))
    for name, tag in template.open:
        other = F.when(role == name, F.lit(tag)).otherwise(other)
    return F.concat(F.lit(template.begin), other)


def _end_state(roles: Column, template: Template) -> Column:
    """The machine's state after all turns, and how many turns it took before it broke."""

    def step(acc: Column, role: Column) -> Column:
        to = F.lit("broken")
        for state, name, following in template.machine:
            to = F.when((acc["state"] == state) & (role == name), F.lit(following)).otherwise(to)
        return F.struct(to.alias("state"), (acc["taken"] + F.when(to != "broken", 1).otherwise(0)).alias("taken"))

    return F.aggregate(roles, F.struct(F.lit("start").alias("state"), F.lit(0).alias("taken")), step)


def format_chats(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments (array of text and loss flag), formatted, valid, end_state, valid_turns."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(t: Column) -> Column:
        return F.array(
            F.struct(_tag(t["role"], template).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), F.coalesce(t["role"].isin(*template.trained), F.lit(False)).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    state = _end_state(F.col("roles"), template)
    return (
        chats.withColumn("segments", F.flatten(F.transform("turns", pieces)))
        .withColumn("roles", F.transform("turns", lambda t: t["role"]))
        .withColumn("machine", state)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            F.col("machine.state").isin(*template.accepting).alias("valid"),
            F.col("machine.state").alias("end_state"),
            F.col("machine.taken").cast("long").alias("valid_turns"),
        )
    )


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns back from a formatted string, as an array of role and text."""
    head = len(template.begin)

    def parse(piece: Column) -> Column:
        body = F.substring(piece, F.lit(head + 1), F.length(piece))
        name_end = F.instr(body, "[/ROLE] ")
        named = F.struct(
            unescape(F.substring(body, F.lit(7), name_end - 7)).alias("role"),
            unescape(F.substring(body, name_end + 8, F.length(body))).alias("text"),
        )
        nameless = F.struct(F.lit(None).cast("string").alias("role"), unescape(F.substring(body, F.lit(9), F.length(body))).alias("text"))
        out = F.when(F.startswith(body, F.lit("[ROLE/] ")), nameless).otherwise(named)
        for name, tag in template.open:
            known = F.struct(F.lit(name).alias("role"), unescape(F.substring(body, F.lit(len(tag) + 1), F.length(body))).alias("text"))
            out = F.when(F.startswith(body, F.lit(tag)), known).otherwise(out)
        return out

    pieces = F.split(formatted, f"\\Q{template.end}\\E")
    return F.transform(F.filter(pieces, lambda p: p != ""), parse)


def read_loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
