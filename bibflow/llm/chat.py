r"""Chat formatting from an event log, on built-in functions only.

Events of a message are folded in order of their sequence number:

* ``message`` sets its text, ``edit`` replaces it, ``regenerate`` throws it away;
* ``delta`` adds to what is there.

So a message's text is that of its last ``message``, ``edit`` or ``regenerate``
event and of all deltas after it. Events are grouped by conversation and message
before whole conversations meet, so a long conversation is folded in parallel.
A formatted conversation is one value and does meet in one task.

The template writes each turn as ``<|im_start|>role<|im_sep|>text<|im_end|>``.
Control strings in roles and texts get a backslash after their first character,
or one more than they have: ``</s>`` becomes ``<\/s>``, and ``<\/s>`` becomes
``<\\/s>``. Reading back takes one away.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of widespread chat formats. Fixed values.
CONTROL_STRINGS = (
    "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
RESETS = ("message", "edit", "regenerate")


@dataclass(frozen=True)
class Template:
    """Turn marks, strings to escape, and the roles whose texts count for the loss."""

    start: str = "<|im_start|>"
    separator: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    control: tuple[str, ...] = CONTROL_STRINGS
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not {self.start, self.separator, self.end} <= set(self.control):
            raise ValueError("the turn marks must be control strings")
        for first, rests in self._families():
            if any(not rest or "\\" in rest for rest in rests) or first == "\\":
                raise ValueError("a control string has two characters or more and no backslash")

    def _families(self) -> list[tuple[str, list[str]]]:
        firsts = dict.fromkeys(s[0] for s in self.control)
        return [(f, [s[1:] for s in self.control if s[0] == f]) for f in firsts]

    def escape(self, text: Column) -> Column:
        for first, rests in self._families():
            ahead = "|".join(map(re.escape, rests))
            text = F.regexp_replace(text, rf"({re.escape(first)}\\*)(?={ahead})", r"$1\\")
        return text

    def unescape(self, text: Column) -> Column:
        for first, rests in reversed(self._families()):
            ahead = "|".join(rf"\\*(?:{re.escape(rest)})" for rest in rests)
            text = F.regexp_replace(text, rf"({re.escape(first)})\\(?={ahead})", "$1")
        return text


def fold_events(events: DataFrame, conversation: str = "conv_id", message: list[str] | None = None,
                sequence: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conversation, message columns, ``position``, ``role`` and ``text``.

    ``position`` is the smallest sequence number of the message's events, and its
    role the first that is not null. An event that was delivered twice counts
    once. Equal sequence numbers are ordered by kind (edits after messages,
    regenerations after those, deltas last), then text. Null sequence numbers
    come first, null texts are empty, and unknown kinds raise. Null is a
    conversation or message key like any other.
    """
    message = message or ["message_id"]
    k, rank = F.col(kind), F.lit(None)
    for place, name in enumerate([*RESETS, "delta"]):
        rank = F.when(k == name, place).otherwise(rank)
    rank = F.coalesce(rank, F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce(k, F.lit("null")))))
    event = F.struct(F.col(sequence).alias("s"), rank.cast("int").alias("k"), F.col(text).alias("t"), F.col(role).alias("r"))
    folded = events.select(conversation, *message, event.alias("_event")).groupBy(conversation, *message).agg(
        F.sort_array(F.array_distinct(F.collect_list("_event"))).alias("_all"),
        F.max(F.when(F.col("_event.k") < len(RESETS), F.struct("_event.s", "_event.k", "_event.t", "_event.r"))).alias("_reset"),
    )
    live = F.filter("_all", lambda e: F.col("_reset").isNull() | (e >= F.col("_reset")))
    return folded.select(
        conversation, *message,
        F.element_at("_all", 1)["s"].alias("position"),
        F.get(F.filter(F.transform("_all", lambda e: e["r"]), lambda r: r.isNotNull()), 0).alias("role"),
        F.array_join(F.transform(live, lambda e: e["t"]), "").alias("text"),
    )


def render(messages: DataFrame, template: Template = Template(), conversation: str = "conv_id",
           order: list[str] | None = None) -> DataFrame:
    """One row per conversation: ``formatted`` and ``segments``, its parts with their loss mask.

    ``segments`` is an array of ``text`` and ``loss``; its texts in order make up
    ``formatted``. Messages are ordered by ``order`` (position and role unless
    given). Null roles and texts are empty.
    """
    order = order or ["position", "role"]
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.concat(F.lit(template.start), template.escape(role), F.lit(template.separator)).alias("head"),
        template.escape(text).alias("body"),
        role.isin(*template.loss_roles).alias("loss"),
    )
    turns = messages.select(conversation, turn.alias("_turn")).groupBy(conversation).agg(
        F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def parts(t: Column) -> Column:
        fixed = F.lit(False).alias("loss")
        return F.array(
            F.struct(t["head"].alias("text"), fixed),
            F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
            F.struct(F.lit(template.end).alias("text"), fixed),
        )

    rendered = turns.select(conversation, F.flatten(F.transform("_turns", parts)).alias("segments"))
    return rendered.select(
        conversation, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(rendered: DataFrame, template: Template = Template()) -> DataFrame:
    """Replace ``formatted`` and ``segments`` by ``turns`` (role, text) and ``loss_text``, unescaped.

    Turns come from the formatted text alone, the loss text from the masked segments.
    """
    marked = F.split("formatted", re.escape(template.end), -1)
    bodies = F.slice(marked, 1, F.size(marked) - 1)

    def turn(part: Column) -> Column:
        cut = F.split(F.substring(part, len(template.start) + 1, 2**31 - 1), re.escape(template.separator), 2)
        return F.struct(template.unescape(cut[0]).alias("role"), template.unescape(cut[1]).alias("text"))

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"]))
    kept = [c for c in rendered.columns if c not in ("formatted", "segments")]
    return rendered.select(
        *kept, F.transform(bodies, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
