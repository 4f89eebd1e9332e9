"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """What stands before and after a role's text, and whether the text is under the loss."""

    before: str
    after: str
    loss: bool = False


#: The template by role; "" is for any other role, whose name stands between ``before`` and ``NAMED``.
TEMPLATE = {
    "system": Turn("<s>[SYS] ", " [/SYS]</s>"),
    "user": Turn("<s>[INST] ", " [/INST]</s>"),
    "assistant": Turn("<s>[ANS] ", " [/ANS]</s>", loss=True),
    "": Turn("<s>[ROLE ", " [/ROLE]</s>"),
}
NAMED = "] "
#: Control strings, which no formatted text or name contains.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "[/ANS]", "[ROLE", "[/ROLE]")
#: The roles that may follow a role; "" is the beginning.
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
ESCAPE = "\\"


def escaped(text: Column) -> Column:
    """Escape signs doubled, and one put after the first sign of every control string; a name's closing bracket too."""
    inner = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
    first = {c[0] for c in CONTROL}
    heads = "".join(re.escape(c) for c in sorted(first))
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, rf"([{heads}])(?={inner})", r"$1\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if ESCAPE in text else text


def format_chats(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Segments of every turn: ``conversation, position, role, legal, segment, text, loss``, in order within partitions.

    Turns are sorted by ``turn``, ties by role and text, and stand at
    ``position`` 0, 1, ... Each has three segments: what the template puts
    before, its escaped text (under the loss for the assistant), and what
    comes after. ``legal`` says whether the machine lets the role follow the
    one before it; turns that it doesn't are formatted all the same. Null
    roles and texts count as empty; null conversations are one. Repeated rows
    are turns of their own, texts of any length stay whole, other columns are
    not kept, and an empty table gives no rows.
    """
    base = turns.select(
        F.col(f"`{conversation}`"),
        F.col(f"`{turn}`").alias("__turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"),
    )
    w = W.partitionBy(conversation).orderBy("__turn", "role", "__text")
    known = [k for k in TEMPLATE if k]
    last = F.lag("role").over(w)
    legal = F.when(last.isNull(), F.col("role").isin(*NEXT[""])).otherwise(F.lit(False))
    for before, roles in NEXT.items():
        legal = F.when(last == before, F.col("role").isin(*roles)).otherwise(legal) if before else legal

    def by_role(of) -> Column:
        out = of("")
        for k in known:
            out = F.when(F.col("role") == k, of(k)).otherwise(out)
        return out

    named = F.replace(escaped(F.col("role")), F.lit("]"), F.lit(ESCAPE + "]"))
    before = by_role(lambda k: F.lit(TEMPLATE[k].before) if k else F.concat(F.lit(TEMPLATE[k].before), named, F.lit(NAMED)))
    segments = F.array(
        F.struct(F.lit(0).alias("segment"), before.alias("text"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("segment"), escaped(F.col("__text")).alias("text"), by_role(lambda k: F.lit(TEMPLATE[k].loss)).alias("loss")),
        F.struct(F.lit(2).alias("segment"), by_role(lambda k: F.lit(TEMPLATE[k].after)).alias("text"), F.lit(False).alias("loss")),
    )
    return (
        base.withColumn("position", F.row_number().over(w) - 1)
        .withColumn("legal", legal)
        .select(conversation, "position", "role", "legal", F.explode(segments).alias("s"))
        .select(conversation, "position", "role", "legal", "s.segment", "s.text", "s.loss")
        .sortWithinPartitions(conversation, "position", "segment")
    )


def pattern() -> re.Pattern:
    """One whole turn of formatted text: its role by the template's marks (a named one: its name) and its escaped text."""
    known = [f"(?P<{k}>{re.escape(t.before)}(?P<{k}_text>.*?){re.escape(t.after)})" for k, t in TEMPLATE.items() if k]
    other = TEMPLATE[""]
    name = r"(?P<name>(?:[^\]\\]|\\.)*)"
    named = f"{re.escape(other.before)}{name}{re.escape(NAMED)}(?P<other_text>.*?){re.escape(other.after)}"
    return re.compile("|".join([*known, named]), re.DOTALL)


class Reader:
    """Reads one conversation back from its formatted text, piece by piece, each with its loss flag.

    What has been joined is cut into turns by the template's marks alone, and
    dropped with each turn that is whole; a text under the loss mask is what the
    mask covers, unescaped.
    """

    TURN = pattern()

    def __init__(self):
        self.text, self.mask = "", []
        self.turns, self.said = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = 0

    def feed(self, piece: str, loss: bool) -> None:
        if loss:
            self.mask.append((len(self.text), len(self.text) + len(piece)))
        self.text += piece
        self.formatted += len(piece)
        if not any(piece.endswith(t.after) for t in TEMPLATE.values()):
            return  # no turn ends here
        at = 0
        while m := self.TURN.match(self.text, at):
            role = next((k for k in TEMPLATE if k and m[k] is not None), None)
            text = m["other_text"] if role is None else m[f"{role}_text"]
            role = unescaped(m["name"]) if role is None else role
            self.n_turns += 1
            self.turns.update(f"{role}\n{unescaped(text)}\n".encode())
            at = m.end()
        for i, j in self.mask:
            plain = unescaped(self.text[i:j])
            self.loss_chars += len(plain)
            self.said.update(plain.encode())
        if at != len(self.text):
            raise ValueError(f"no turn at code point {at} of {self.text[:80]!r}")
        self.text, self.mask = "", []


def digests(segments: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row for each conversation, read back from the joined text of its segments, which must be in order within partitions.

    ``n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, legal``;
    a task holds one turn at a time, however long the conversation. Text that
    is no sequence of whole turns is an error.
    """
    kind = segments.schema[conversation].dataType.simpleString()
    names = [conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "legal"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, fine = None, None, True
        done: list[list] = [[] for _ in names]

        def close() -> None:
            if state.text:
                raise ValueError(f"no turn in {state.text[:80]!r}")
            row = (now, state.n_turns, state.turns.hexdigest(), state.loss_chars, state.said.hexdigest(), state.formatted, fine)
            for c, v in zip(done, row):
                c.append(v)

        for b in batches:
            for key, text, loss, legal in zip(*[c.to_pylist() for c in b.columns]):
                if state is None or key != now:
                    if state is not None:
                        close()
                    now, state, fine = key, Reader(), True
                fine &= legal
                state.feed(text, loss)
            yield batch(done)
        if state is not None:
            close()
            yield batch(done)

    def batch(done: list[list]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, kinds)], names=names)
        for c in done:
            c.clear()
        return out

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(segments.schema[conversation].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    schema = f"`{conversation}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, legal boolean"
    return segments.select(conversation, "text", "loss", "legal").mapInArrow(read, schema)
