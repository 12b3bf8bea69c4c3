"""Chat formatting: a finite-state machine over roles checks the turn order, a
declarative template turns each conversation into text segments with a loss
flag each.  DataFrame functions only.

Control strings inside texts and roles are escaped reversibly: the escape
character and the first character of every marker are replaced by two-character
codes, so no marker can begin inside a text and splitting at the markers reads
the turns back.

Defined cases: null text is empty; a null role is the empty role, which the
machine rejects.  Rows of one turn number are ordered by role, then text;
repeated rows are repeated turns.  Invalid conversations are formatted like the
others and flagged (``valid``, ``bad_turn``: the first position, from 0, that
the machine rejects, or the number of turns where only the end is missing).
Rows with a null conversation id form one conversation.  An empty table gives
no rows.  One conversation is one record: its text is one value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """``open`` + role + ``mid`` + text + ``close`` per turn."""

    open: str = "<turn "
    mid: str = ">\n"
    close: str = "</turn>\n"
    escape: str = "&"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    # (state, role) -> state; what is not listed is rejected
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    })

    def __post_init__(self):
        if not (self.open and self.mid and self.close) or len(self.escape) != 1:
            raise ValueError("markers must not be empty, the escape is one character")
        if any(m[0] in (self.escape + "0123456789") for m in (self.open, self.mid, self.close)):
            raise ValueError("a marker must not begin with the escape or a digit")

    @property
    def codes(self) -> list[tuple[str, str]]:
        """(character, code) in the order of escaping."""
        leads = sorted({m[0] for m in (self.open, self.mid, self.close)})
        return [(c, f"{self.escape}{i}") for i, c in enumerate([self.escape, *leads])]

    def escaped(self, c: Column) -> Column:
        for raw, code in self.codes:
            c = F.replace(c, F.lit(raw), F.lit(code))
        return c

    def unescaped(self, c: Column) -> Column:
        for raw, code in reversed(self.codes):
            c = F.replace(c, F.lit(code), F.lit(raw))
        return c


SEGMENTS = "array<struct<text:string,loss:boolean>>"


def format_conversations(df: DataFrame, template: ChatTemplate | None = None,
                         conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """conv, valid, bad_turn, segments (text, loss) per conversation."""
    t = template or ChatTemplate()
    rows = df.select(F.col(conv).alias("conv"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    moves = F.create_map(*[F.lit(x) for (s, r), to in sorted(t.moves.items())
                           for x in (f"{s}\n{r}", to)])
    dead = "\n"  # no state has this name
    step = lambda s, x: F.struct(
        F.coalesce(F.element_at(moves, F.concat(s["state"], F.lit("\n"), x["role"])),
                   F.lit(dead)).alias("state"),
        F.when(s["state"] == dead, s["ok"]).when(
            F.element_at(moves, F.concat(s["state"], F.lit("\n"), x["role"])).isNull(), s["ok"])
        .otherwise(s["ok"] + 1).alias("ok"))
    walked = F.aggregate("turns", F.struct(F.lit(t.start).alias("state"),
                                           F.lit(0).alias("ok")), step)
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(F.concat(F.lit(t.open), t.escaped(x["role"]), F.lit(t.mid)).alias("text"),
                 F.lit(False).alias("loss")),
        F.struct(t.escaped(x["text"]).alias("text"),
                 x["role"].isin(*t.loss_roles).alias("loss")),
        F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")))))
    out = convs.withColumn("walked", walked).withColumn(
        "valid", F.col("walked.state").isin(*t.accept))
    return out.select(F.col("conv").alias(conv), "valid",
                      F.when(~F.col("valid"), F.col("walked.ok")).alias("bad_turn"),
                      segments.cast(SEGMENTS).alias("segments"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """array<struct<role, text>> read back from formatted text alone."""
    t = template or ChatTemplate()
    # the text ends with a close marker: what follows the last one is empty
    pieces = F.split(formatted, "\\Q" + t.close + "\\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(t.open) + 1))
        at = F.instr(body, t.mid)
        return F.struct(t.unescaped(F.substr(body, F.lit(1), at - 1)).alias("role"),
                        t.unescaped(F.substr(body, at + len(t.mid))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    t = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: t.unescaped(s["text"])), "")
