"""Chat formatting from a declarative template, with a finite-state machine over roles.

A template names the mark of each role, which roles carry loss, the machine's transitions and the control strings. Every turn becomes three text segments (mark, escaped text,
end) with a loss flag each. Control strings inside texts are escaped by a backslash within them, so the output can be read back.
A run of turns acts on the machine as a function from states to states; such functions are built per chunk of a conversation and composed in order,
so chunks of one long conversation are worked on apart. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256  # turn numbers that share a chunk


@dataclass(frozen=True)
class Template:
    """`labels`: role -> what its mark shows. `moves`: (state, role) -> state; a missing move is a violation, which nothing leaves."""

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    opening: str = "### "
    closing: str = "</turn>\n"
    controls: tuple[str, ...] = ("##", "</turn>")  # what must not stand in a text as it is

    def __post_init__(self):
        alone = [c for c in self.controls if len(c) > 1 and c[0] not in c[1:] and c in self.closing]
        if not alone or not any(c in self.opening for c in self.controls) or any("\\" in c or len(c) < 2 for c in self.controls):
            raise ValueError("controls have two characters or more and no backslash; one is in the opening, and one, whose first character comes once, in the closing")
        if any(":" in label or "\\" in label or label.startswith("?") for label in self.labels.values()) or len(set(self.labels.values())) < len(self.labels):
            raise ValueError("labels differ, hold no colon or backslash, and don't begin with a question mark")

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.start, *[s for s, _ in self.moves], *self.moves.values()]))

    def table(self) -> list[int]:
        """Next states, row by row: a row for each state and one for violations; a column for each role and one for unknown roles."""
        states, roles = self.states, list(self.labels)
        bad = len(states)
        rows = [[states.index(self.moves[s, r]) if (s, r) in self.moves else bad for r in roles] + [bad] for s in states]
        return sum(rows, []) + [bad] * (len(roles) + 1)


def escape(text: Column, t: Template) -> Column:
    """No control string of the template is left whole inside; each escape is a backslash before the character it stands for."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in t.controls:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def mark(role: Column, t: Template) -> Column:
    """What stands before a turn's text. A role that the template doesn't name is shown escaped after a question mark."""
    shown = F.concat(F.lit("?"), F.replace(escape(role, t), F.lit(":"), F.lit("\\:")))
    for name, label in t.labels.items():
        shown = F.when(role == name, F.lit(label)).otherwise(shown)
    return F.concat(F.lit(t.opening), shown, F.lit(": "))


def format_conversations(df: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, valid, segments array<struct<text, loss>>), a row for each conversation.

    Turns are ordered by turn number; those that tie by role and text, and repeated rows all stay. Null texts and roles are empty strings; null turn
    numbers come first; rows of a null conv_id form one conversation. An empty role is unknown, and an unknown role makes its conversation invalid, as does a turn out of order, but all
    its turns are still formatted. Other columns are not read. An empty table gives no rows. A conversation ends as one row, so it must fit into one.
    """
    t = template or Template()
    roles = len(t.labels) + 1
    states = len(t.states) + 1
    table = F.array(*[F.lit(s) for s in t.table()])
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.floor(F.col(turn_col) / CHUNK).alias("chunk"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))

    def number(r: Column) -> Column:
        n = F.lit(roles - 1)
        for k, name in enumerate(t.labels):
            n = F.when(r == name, F.lit(k)).otherwise(n)
        return n

    def step(acc: Column, x: Column) -> Column:
        return F.transform(acc, lambda s: F.get(table, s * roles + number(x["role"])))

    def segments(x: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(part(mark(x["role"], t), no), part(escape(x["text"], t), x["role"].isin(*t.loss)), part(F.lit(t.closing), no))

    chunks = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv_id",
        F.struct(
            "chunk",
            F.size("turns").alias("n"),
            F.aggregate("turns", F.array(*[F.lit(s) for s in range(states)]), step).alias("moves"),
            F.flatten(F.transform("turns", segments)).alias("segments"),
        ).alias("c"),
    )
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list("c"), lambda a, b: F.when(a["chunk"].isNull(), -1).when(b["chunk"].isNull(), 1).when(a["chunk"] < b["chunk"], -1).otherwise(1)).alias("cs"))
    end = F.aggregate("cs", F.lit(t.states.index(t.start)), lambda s, c: F.get(c["moves"], s))
    return whole.select(
        "conv_id",
        F.aggregate("cs", F.lit(0).cast("long"), lambda n, c: n + c["n"]).alias("n_turns"),
        (end < states - 1).alias("valid"),
        F.flatten(F.transform("cs", lambda c: c["segments"])).alias("segments"),
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, from its text alone."""
    t = template or Template()
    parts = F.split(text, F.lit("\\Q" + t.closing + "\\E"))

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(t.opening) + 1))
        hidden = F.replace(F.replace(body, F.lit("\\\\"), F.lit("--")), F.lit("\\:"), F.lit("--"))  # a role's own colons
        label = F.substr(body, F.lit(1), F.instr(hidden, ":") - 1)
        role = unescape(F.substr(label, F.lit(2)))
        for name, shown in t.labels.items():
            role = F.when(label == shown, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.substr(body, F.length(label) + 3)).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
