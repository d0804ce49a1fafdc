"""Chat formatting: a finite-state machine over roles driven by a declarative template.

``format_chats`` turns rows (conversation, turn, role, text) into one row per conversation with the formatted text,
its segments with loss flags and the verdict of the role machine. ``read_back`` parses formatted texts again.

Control strings inside roles and texts are escaped reversibly: in every run ``<``, backslashes, ``|`` one backslash
is added, so that ``<|`` never occurs in an escaped text. Roles are also URL-encoded, which leaves the usual role
names as they are and frees them of line ends.

Defined results: a null text or role is empty; rows that tie on turn are ordered by role, then text; repeated rows
are repeated turns; rows with a null conversation id form one conversation of their own; an empty table gives no
rows; columns besides the four named ones are ignored. A role the machine does not know, or a turn out of order,
is formatted all the same and marked by ``valid = false`` and the first bad position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = (r"<(\\*)\|", r"<$1\\|")
UNESCAPE = (r"<(\\*)\\\|", r"<$1|")


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn, roles under the loss, and the machine: state (last role) -> roles that may follow."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_end: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    def __post_init__(self) -> None:
        if not (self.start.startswith("<|") and self.end.startswith("<|")):
            raise ValueError("marks must start with '<|', the string that escaped texts never hold")
        if "<|" in self.after_role + self.after_end or not self.after_role.startswith("\n"):
            raise ValueError("what follows a mark may not start one, and a role ends at a line end")


CHATML = ChatTemplate()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _machine(turns: Column, template: ChatTemplate) -> Column:
    """The 0-based position of the first turn that the machine refuses, null if it accepts all."""
    table = F.create_map(*[x for state, to in template.follows.items() for x in (F.lit(state), F.array(*map(F.lit, to)))])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        allowed = F.coalesce(F.array_contains(F.try_element_at(table, acc["state"]), turn["role"]), F.lit(False))
        bad = F.coalesce(acc["bad"], F.when(~allowed, acc["at"]))
        return F.struct(turn["role"].alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    return F.aggregate(turns, start, step, lambda acc: acc["bad"])


def format_chats(rows: DataFrame, template: ChatTemplate = CHATML, conv: str = "conv_id") -> DataFrame:
    """One row per conversation: ``conv``, ``n_turns``, ``formatted``, ``segments``, ``valid``, ``bad_turn``.

    ``segments`` is an array of (text, loss) whose texts concatenate to ``formatted``; each turn gives its opening
    mark, its escaped text and its closing mark, and only the text of a loss role is under the loss.
    """
    clean = rows.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
        ).alias("turn"),
    )
    grouped = clean.groupBy("conv").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    t = template

    def pieces(turn: Column) -> Column:
        opening = F.concat(F.lit(t.start), F.url_encode(turn["role"]), F.lit(t.after_role))
        return F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), turn["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.end + t.after_end).alias("text"), F.lit(False).alias("loss")),
        )

    made = grouped.select(
        "conv",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", pieces)).alias("segments"),
        _machine(F.col("turns"), t).alias("bad_turn"),
    )
    return made.select(
        F.col("conv").alias(conv),
        "n_turns",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.col("bad_turn").isNull().alias("valid"),
        "bad_turn",
    )


def loss_spans(segments: Column) -> Column:
    """(start, length) in code points of the segments under the loss, in order: the mask as stored beside a text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        n = F.length(s["text"])
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        return F.struct((acc["at"] + n).alias("at"), F.when(s["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(segments, start, step, lambda acc: acc["spans"])


def read_back(formatted: Column, template: ChatTemplate = CHATML) -> Column:
    """The turns of a formatted text as an array of (role, text), marks removed and escapes undone."""
    t = template
    turns = F.split(F.regexp_replace(formatted, "^" + _quoted(t.start), ""), _quoted(t.start))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, t.after_role, 1)
        body = F.substr(piece, F.length(role) + F.lit(1 + len(t.after_role)))
        text = F.substr(body, F.lit(1), F.length(body) - F.lit(len(t.end + t.after_end)))
        return F.struct(F.url_decode(role).alias("role"), unescape(text).alias("text"))

    return F.when(formatted == "", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.transform(turns, turn))


def _quoted(mark: str) -> str:
    return r"\Q" + mark + r"\E"


def digests(chats: DataFrame, template: ChatTemplate = CHATML, conv: str = "conv_id") -> DataFrame:
    """Counts and SHA-256 digests of what ``read_back`` finds in ``formatted`` and of the text under the loss mask."""
    read = chats.select(
        conv,
        "formatted",
        read_back(F.col("formatted"), template).alias("turns"),
        F.transform(loss_spans(F.col("segments")), lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))).alias("lost"),
        "valid",
    )
    nl = F.lit("\n")
    return read.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], nl, x["text"], nl)), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(F.array_join("lost", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("lost", "").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
