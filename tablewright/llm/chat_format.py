"""Chat formatting by a finite-state machine over roles and a declarative template.

A template declares the roles it knows: what stands before and after a turn, whether its text is
learned from, and which role may follow which. The state of a conversation is the role met last
(at first ``START``); a turn is in order if the template lists its role after that state, and a
conversation may end in the states listed before ``END``. Every turn is formatted either way, and
its order is reported beside it: a role that the template does not know gets a mark of its own.

Formatting emits segments: a row each for the mark before a turn, its text, and the mark after
it, with a flag whether the segment counts for the loss. Only texts of learned roles do. Control
strings inside texts get a backslash after their first character (and one more if they already
have some), so a text cannot end a turn or begin one; reading takes it away again.

Turns come by number, then role, then text. The segments of a turn need only the role before it,
which a sorted window streams; only :func:`read_back`, whose result is a line per conversation,
holds one conversation at a time. All steps are DataFrame operations.

Results: null texts count as empty, a null role as an unknown role with an empty name; repeated
turns are formatted each; a null conversation id is a conversation of its own; an empty table
gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, quoted

START, END = "^", "$"


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    learned: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of the known roles, of unknown ones (``{role}`` is their escaped name), and the order
    of turns: for each state the roles that may follow, ``END`` if it may be the last."""

    roles: Mapping[str, Role]
    unknown: Role
    order: Mapping[str, Sequence[str]]
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = [m for role in [*self.roles.values(), self.unknown] for m in (role.before, role.after)]
        found = sorted({c for mark in marks for c in re.findall(r"<[^<>\s]+>|\[[^\[\]\s{}]+\]|\[ROLE(?= )", mark)})
        object.__setattr__(self, "controls", tuple(found))
        for mark in marks:
            if not any(c in mark for c in found):
                raise ValueError(f"mark without control string: {mark!r}")
        for c in found:
            if any(other[0] in c[1:] for other in found):
                raise ValueError(f"control strings overlap: {c!r}")


LLAMA = Template(
    roles={
        "system": Role("<sys>", "</sys>"),
        "user": Role("[INST] ", " [/INST]"),
        "assistant": Role("<s> ", " </s>", learned=True),
    },
    unknown=Role("[ROLE {role}] ", " [/ROLE]"),
    order={
        START: ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user", END),
    },
)


# --- escaping ------------------------------------------------------------------------------

def _rests(template: Template) -> tuple[str, str]:
    """Patterns of first characters and of what follows them in a control string."""
    first = "".join(sorted({re.escape(c[0]) for c in template.controls}))
    rests = "|".join(sorted({re.escape(c[1:]) for c in template.controls}, key=len, reverse=True))
    return first, rests


def escape(text: Column, template: Template = LLAMA) -> Column:
    first, rests = _rests(template)
    return F.regexp_replace(text, F.lit(rf"([{first}])(?=\\*(?:{rests}))"), F.lit(r"$1\\"))


def unescape(text: Column, template: Template = LLAMA) -> Column:
    first, rests = _rests(template)
    return F.regexp_replace(text, F.lit(rf"([{first}])\\(?=\\*(?:{rests}))"), F.lit("$1"))


# Names of unknown roles stand inside a mark: brackets and backslashes in them are spelled out.
def _name_out(role: Column) -> Column:
    for char, code in (("\\", r"\s"), ("[", r"\o"), ("]", r"\c")):
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def _name_in(name: Column) -> Column:
    for char, code in (("]", r"\c"), ("[", r"\o"), ("\\", r"\s")):
        name = F.replace(name, F.lit(code), F.lit(char))
    return name


# --- formatting ----------------------------------------------------------------------------

def _by_role(role: Column, template: Template, pick, other: Column) -> Column:
    out = other
    for name, known in reversed(list(template.roles.items())):
        out = F.when(role == name, pick(known)).otherwise(out)
    return out


def segments(
    turns: DataFrame,
    template: Template = LLAMA,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Rows ``conversation, place, part, segment, loss, in_order, last``.

    ``place`` numbers the turns of a conversation from 1, ``part`` is 0 for the mark before a
    turn, 1 for its text and 2 for the mark after it. ``in_order`` tells whether the turn may
    follow the one before (and, of the last turn, whether the conversation may end there).
    """
    prepare(turns.sparkSession)
    rows = turns.select(
        quoted(conversation).alias("conversation"), quoted(turn).alias("turn"),
        F.coalesce(quoted(role), F.lit("")).alias("role"), F.coalesce(quoted(text), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conversation").orderBy("turn", "role", "text")
    state = F.lag("role", 1, START).over(order)
    rows = rows.withColumns({"place": F.row_number().over(order), "state": state, "next": F.lead("role").over(order)})
    moves = [(a, b) for a, after in template.order.items() for b in after if b != END]
    allowed = F.array(*[F.struct(F.lit(a).alias("state"), F.lit(b).alias("role")) for a, b in moves])
    ends = F.col("role").isin([a for a, after in template.order.items() if END in after])
    last = F.col("next").isNull()
    in_order = F.array_contains(allowed, F.struct("state", "role")) & (~last | ends)
    name = _name_out(F.col("role"))
    unknown = [F.concat(*[name if p == "{role}" else F.lit(p) for p in re.split(r"(\{role\})", mark) if p]) for mark in (template.unknown.before, template.unknown.after)]
    before = _by_role(F.col("role"), template, lambda r: F.lit(r.before), unknown[0])
    after = _by_role(F.col("role"), template, lambda r: F.lit(r.after), unknown[1])
    learned = _by_role(F.col("role"), template, lambda r: F.lit(r.learned), F.lit(template.unknown.learned))
    parts = F.array(
        F.struct(F.lit(0).alias("part"), before.alias("segment"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("part"), escape(F.col("text"), template).alias("segment"), learned.alias("loss")),
        F.struct(F.lit(2).alias("part"), after.alias("segment"), F.lit(False).alias("loss")),
    )
    out = rows.select("conversation", "place", in_order.alias("in_order"), last.alias("last"), F.explode(parts).alias("s"))
    return out.select("conversation", "place", "s.part", "s.segment", "s.loss", "in_order", "last")


def formatted(segments: DataFrame) -> DataFrame:
    """One row per conversation: ``conversation, formatted, learned, in_order``.

    ``formatted`` is the whole text, ``learned`` the segments under the loss mask in order. A
    conversation is one training sample, so its turns meet in one row here.
    """
    held = segments.groupBy("conversation").agg(
        F.sort_array(F.collect_list(F.struct("place", "part", "segment", "loss"))).alias("s"),
        F.bool_and("in_order").alias("in_order"),
    )
    whole = F.concat_ws("", F.transform("s", lambda x: x["segment"]))
    learned = F.transform(F.filter("s", lambda x: x["loss"]), lambda x: x["segment"])
    return held.select("conversation", whole.alias("formatted"), learned.alias("learned"), "in_order")


def read_back(samples: DataFrame, template: Template = LLAMA) -> DataFrame:
    """``samples`` with ``turns`` (array of ``role, text``), read from the formatted text alone.

    No escaped text holds a control string, so each turn runs from a mark before to the next mark
    after of its role."""
    kinds = [*template.roles.items(), (None, template.unknown)]
    spelled = lambda mark: re.escape(mark).replace(re.escape("{role}"), r"[^\[\]]*").replace(r"\ ", r"\x20")
    # What stands after a turn ends it; the turn's text may hold anything else.
    enders = "|".join(spelled(role.after) for _, role in kinds)
    pattern = rf"(?s)(?:{'|'.join(spelled(role.before) for _, role in kinds)})(?:(?!{enders}).)*+(?:{enders})"
    pieces = F.regexp_extract_all("formatted", F.lit(pattern), F.lit(0))

    def turn(piece: Column) -> Column:
        made = None
        for name, role in reversed(kinds):
            if name is None:
                head = F.regexp_extract(piece, "^" + spelled(role.before), 0)
                lead, tail = role.before.split("{role}")
                label = _name_in(F.substring(head, F.lit(len(lead) + 1), F.length(head) - (len(lead) + len(tail))))
            else:
                head, label = F.lit(role.before), F.lit(name)
            inner = F.substring(piece, F.length(head) + 1, F.length(piece) - F.length(head) - len(role.after))
            one = F.struct(label.alias("role"), unescape(inner, template).alias("text"))
            made = one if made is None else F.when(F.startswith(piece, F.lit(role.before)), one).otherwise(made)
        return made

    return samples.withColumn("turns", F.transform(pieces, turn))


def digests(samples: DataFrame, template: Template = LLAMA) -> DataFrame:
    """``conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, in_order``
    of :func:`formatted` samples, from what is read back."""
    back = read_back(samples, template)
    line = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("learned", lambda t: unescape(t, template)))
    return back.select(
        "conversation", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "in_order",
    )
