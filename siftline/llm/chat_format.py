"""Chat formatting with a declarative template, in DataFrame functions only.

A finite-state machine over the roles checks the order of the turns. Every conversation becomes a list of segments, each
with its text and a loss flag; the formatted text is their concatenation. Control strings inside texts are escaped, so
the formatted text can be read back: see :func:`read_back`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.common import whole


@dataclass(frozen=True)
class Template:
    """``turns``: opening and closing mark of each role; ``other``: those of any other role, whose name stands between
    ``other[0]`` and ``other[1]``; ``loss``: roles whose texts count for the loss; ``moves``: the roles that may follow a
    role (``start`` before the first), ``ends``: roles that may come last; ``escape``: the escape character."""

    turns: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    loss: frozenset[str]
    moves: dict[str, tuple[str, ...]]
    ends: frozenset[str]
    escape: str = "\\"
    controls: list[str] = field(init=False)

    def __post_init__(self) -> None:
        marks = [*(m.strip() for pair in self.turns.values() for m in pair), *(m.strip() for m in self.other)]
        if any(len(m) < 2 or self.escape in m for m in marks):
            raise ValueError("a mark has two characters at least and no escape character")
        object.__setattr__(self, "controls", sorted(set(marks), key=lambda m: (-len(m), m)))


INSTRUCT = Template(
    turns={"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")},
    other=("<|role|>", "<|text|>", "<|end|>"),
    loss=frozenset({"assistant"}),
    moves={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=frozenset({"assistant"}),
)


def quoted(mark: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", mark)


def escaped(text: Column, t: Template) -> Column:
    """An escape character becomes two signs, and each control string gets one after its first character."""
    any_control = "|".join(quoted(c) for c in t.controls)
    doubled = F.replace(text, F.lit(t.escape), F.lit(t.escape + "0"))
    return F.regexp_replace(doubled, f"(?s)(?={any_control})(.)", "$1" + quoted(t.escape) + "1")


def unescaped(text: Column, t: Template) -> Column:
    return F.replace(F.replace(text, F.lit(t.escape + "1"), F.lit("")), F.lit(t.escape + "0"), F.lit(t.escape))


def _by_role(role: Column, t: Template, part: int, other: Column) -> Column:
    out = other
    for name, marks in t.turns.items():
        out = F.when(role == name, F.lit(marks[part])).otherwise(out)
    return out


def _valid(turns: Column, t: Template) -> Column:
    """The state machine: the state is the last role, or ``-`` after a move that is not listed."""
    moves = F.create_map(*[F.lit(x) for a, to in t.moves.items() for b in to for x in (f"{a}>{b}", b)])
    last = F.aggregate(turns, F.lit("start"), lambda state, turn: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(">"), turn["role"])), F.lit("-")))
    return last.isin(sorted(t.ends))


def format_chats(turns: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """One row per conversation of ``turns`` (``conv_id, turn, role, text``):

    ``conv_id, valid, segments (array<struct<text,loss>>), formatted``. Turns stand in the order of ``turn``, ties by role
    and text, repeated rows once each; a null ``turn`` comes first. A null text or role is empty. Conversations with a
    forbidden order of turns are formatted too and have ``valid`` false. Rows of a null ``conv_id`` form one conversation.
    Other columns are not read. The turns of one conversation meet in one row, as its text must.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), whole()
    own = escaped(role, t)
    marked = turns.select(
        "conv_id",
        F.struct(
            "turn", role.alias("role"), text.alias("text"),
            F.array(
                F.struct(_by_role(role, t, 0, F.concat(F.lit(t.other[0]), own, F.lit(t.other[1]))).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(text, t).alias("text"), role.isin(sorted(t.loss)).alias("loss")),
                F.struct(_by_role(role, t, 1, F.lit(t.other[2])).alias("text"), F.lit(False).alias("loss")),
            ).alias("segments"),
        ).alias("turn"),
    )
    gathered = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda x: x["segments"]))
    return gathered.select("conv_id", _valid(F.col("turns"), t).alias("valid"), segments.alias("segments")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_back(formatted: Column, t: Template = INSTRUCT) -> Column:
    """The turns of a formatted text: ``array<struct<role,text>>``, unescaped.

    The patterns of all roles are tried at once; each starts with its own opening mark, and no mark occurs in a text.
    """
    parts = [f"{quoted(a)}.*?{quoted(b)}" for a, b in t.turns.values()] + [f"{quoted(t.other[0])}.*?{quoted(t.other[1])}.*?{quoted(t.other[2])}"]
    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s)({'|'.join(parts)})"), 1)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(t.other[0]) + 1), F.length(piece) - sum(map(len, (t.other[0], t.other[2]))))
        at = F.instr(inner, t.other[1])
        role, text = F.substring(inner, F.lit(1), at - 1), F.substring(inner, at + len(t.other[1]), F.length(inner))
        for name, (opening, closing) in t.turns.items():
            own = piece.startswith(opening)
            role = F.when(own, F.lit(name)).otherwise(role)
            text = F.when(own, F.substring(piece, F.lit(len(opening) + 1), F.length(piece) - len(opening) - len(closing))).otherwise(text)
        return F.struct(unescaped(role, t).alias("role"), unescaped(text, t).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, t: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
