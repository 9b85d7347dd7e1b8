"""Operator 5: chat formatting from a declarative template, DataFrame functions only.

A template names the markers around each role's text, whether loss is taken
on it, and the transitions of a finite-state machine over roles. Formatting
emits segments (text, learn) per conversation: a beginning, then per turn an
opening marker, the text and a closing marker; only texts of learning roles
carry loss. Control strings inside texts are escaped: the escape character
becomes escape + '0', control string k becomes escape + its letter, so a
marker in the output is always structure and ``read_back`` is exact.

A conversation with very many rows is worked on in blocks of turns: a block
yields its segments and, as the machine composes, the end state for every
start state; the blocks of a conversation are then joined in order. The
joined row is as large as the conversation itself.

Defined cases: a null role is the role '', null text is empty; roles that
the template doesn't know are written under their name and lead to the error
state; rows of one turn number are ordered by role, then text, repeated rows
stay; a null turn comes first; a null conversation id is a conversation;
an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"


@dataclass(frozen=True)
class Role:
    name: str
    open: str
    close: str
    learn: bool = False


@dataclass(frozen=True)
class Template:
    roles: tuple[Role, ...] = (Role("system", "<<SYS>>", "<</SYS>>"), Role("user", "[INST]", "[/INST]"),
                               Role("assistant", "[OUT]", "</s>", True))
    begin: str = "<s>"
    #: Any other role: open, its name, between, the text, close.
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    start: str = "start"
    #: (state, role) -> state; what isn't listed is an error.
    moves: tuple[tuple[str, str, str], ...] = (("start", "system", "told"), ("start", "user", "asked"), ("told", "user", "asked"),
                                               ("asked", "assistant", "answered"), ("answered", "user", "asked"))
    accept: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        for a in self.controls:
            if not a or ESCAPE in a:
                raise ValueError(f"not a control string: {a!r}")
            for b in self.controls:
                if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))) or (a != b and b in a):
                    raise ValueError(f"control strings overlap: {a!r}, {b!r}")

    @property
    def controls(self) -> list[str]:
        return sorted({self.begin, *self.other, *(m for r in self.roles for m in (r.open, r.close))})

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.start, *(s for a, _, b in self.moves for s in (a, b)), "error"]))


def escaped(text: Column, t: Template) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for k, control in enumerate(t.controls):
        text = F.replace(text, F.lit(control), F.lit(ESCAPE + chr(65 + k)))
    return text


def unescaped(text: Column, t: Template) -> Column:
    for k, control in enumerate(t.controls):
        text = F.replace(text, F.lit(ESCAPE + chr(65 + k)), F.lit(control))
    return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _segment(text: Column, learn: Column | bool) -> Column:
    return F.struct(text.alias("text"), (learn if isinstance(learn, Column) else F.lit(learn)).alias("learn"))


def turn_segments(role: Column, text: Column, t: Template) -> Column:
    """Opening marker, text, closing marker."""
    opening = F.concat(F.lit(t.other[0]), escaped(role, t), F.lit(t.other[1]))
    closing, learn = F.lit(t.other[2]), F.lit(False)
    for r in t.roles:
        opening = F.when(role == r.name, r.open).otherwise(opening)
        closing = F.when(role == r.name, r.close).otherwise(closing)
        learn = F.when(role == r.name, r.learn).otherwise(learn)
    return F.array(_segment(opening, False), _segment(escaped(text, t), learn), _segment(closing, False))


def next_state(state: Column, role: Column, t: Template) -> Column:
    number = {s: k for k, s in enumerate(t.states)}
    out = F.lit(number["error"])
    for a, r, b in t.moves:
        out = F.when((state == number[a]) & (role == r), number[b]).otherwise(out)
    return out


def formatted(turns: DataFrame, t: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text", block: int = 64) -> DataFrame:
    """(conv_id, valid, complete, segments, formatted) per conversation.

    valid: the machine meets no error; complete: it also ends in a state of
    ``accept``. formatted is the segments' texts in turn."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.floor(F.col(turn_col) / block).alias("block"),
                        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                                 F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("row"))
    states = t.states
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(
        "conv_id", "block",
        F.array(*(F.aggregate("rows", F.lit(k), lambda s, r: next_state(s, r["role"], t)) for k in range(len(states)))).alias("ends"),
        F.flatten(F.transform("rows", lambda r: turn_segments(r["role"], r["text"], t))).alias("segments"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "ends", "segments"))).alias("blocks"))
    end = F.aggregate("blocks", F.lit(states.index(t.start)), lambda s, b: F.element_at(b["ends"], s + 1))
    out = whole.select("conv_id", end.alias("end"), F.concat(
        F.array(_segment(F.lit(t.begin), False)), F.flatten(F.transform("blocks", lambda b: b["segments"]))).alias("segments"))
    return out.select("conv_id", (F.col("end") != states.index("error")).alias("valid"),
                      F.col("end").isin([states.index(s) for s in t.accept]).alias("complete"), "segments",
                      F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(text: Column, t: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation, from the string alone."""
    closes = [*(r.close for r in t.roles), t.other[2]]
    after_close = "(?<=" + "|".join("\\Q" + c + "\\E" for c in closes) + ")"
    pieces = F.split(F.substr(text, F.lit(len(t.begin) + 1)), F.lit(after_close))

    def inner(piece, opening, closing):
        return F.substr(piece, F.lit(len(opening) + 1), F.length(piece) - len(opening) - len(closing))

    def turn(piece):
        named = F.split(inner(piece, t.other[0], t.other[2]), "\\Q" + t.other[1] + "\\E")
        role, body = unescaped(F.element_at(named, 1), t), F.element_at(named, 2)
        for r in t.roles:
            role = F.when(F.startswith(piece, F.lit(r.open)), r.name).otherwise(role)
            body = F.when(F.startswith(piece, F.lit(r.open)), inner(piece, r.open, r.close)).otherwise(body)
        return F.struct(role.alias("role"), unescaped(body, t).alias("text"))

    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def loss_text(segments: Column, t: Template = Template()) -> Column:
    """All text under the loss mask, as it was before escaping."""
    learnt = F.filter(segments, lambda s: s["learn"])
    return F.array_join(F.transform(learnt, lambda s: unescaped(s["text"], t)), "")
