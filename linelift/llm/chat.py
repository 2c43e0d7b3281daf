"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names, for each role, the marks around its text and whether the text is under
the loss mask; the machine names the roles that may follow each state. Every turn
becomes text segments with loss flags. A special character starts every mark, and inside a
text an escape follows each such character, so no control string can occur in a text and
the formatted string can be read back exactly. All steps are Spark SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linelift.llm.common import need_columns
from linelift.llm.native import bound, running_sums

ESCAPE = "\\"
OTHER = ""
BLOCK_TURNS = 256


@dataclass(frozen=True)
class RoleMarks:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``roles``: marks by role; the role ``OTHER`` stands for any role not named, and its
    ``before`` is followed by the role and ``named``. Marks start with ``<`` or ``[``.
    ``follows``: state -> roles that may come next; the state after a turn is its
    role, ``start`` before the first. ``final``: roles that may come last."""

    begin: str = "<s>"
    roles: dict = field(default_factory=lambda: {
        "system": RoleMarks("<<SYS>>", "<</SYS>>"),
        "user": RoleMarks("[INST]", "[/INST]"),
        "assistant": RoleMarks("[ANSWER]", "</s>", loss=True),
        OTHER: RoleMarks("[ROLE]", "[/TURN]"),
    })
    named: str = "[/ROLE]"
    follows: dict = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user",)})
    final: tuple = ("user", "assistant")


LLAMA_LIKE = Template()


def escape(text: Column) -> Column:
    """Put the escape after each character that can start a mark, and after itself."""
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def _by_role(role: Column, template: Template, value) -> Column:
    out = F.lit(value(template.roles[OTHER]))
    for name, marks in template.roles.items():
        if name != OTHER:
            out = F.when(role == name, F.lit(value(marks))).otherwise(out)
    return out


def turn_segments(turns: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """Every turn of ``turns`` (conv_id, turn, role, text) with its segments.

    Adds ``position`` (from 1, by turn, ties by role and text), ``valid`` (the machine
    allows the role here) and ``segments``: array of (text, loss), marks and escaped text in
    order. A null role is the role '', a null text is empty. Turns of all conversations
    are kept, valid or not.
    """
    need_columns(turns, "conv_id", "turn", "role", "text")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    before = F.lag("role", 1, None).over(order)
    allowed = F.lit(False)
    for state, roles in template.follows.items():
        here = before.isNull() if state == "start" else before == state
        allowed = allowed | (here & F.col("role").isin(*roles))
    marks_before = _by_role(F.col("role"), template, lambda m: m.before)
    named = F.when(F.col("role").isin(*[r for r in template.roles if r != OTHER]), F.lit(""))
    named = named.otherwise(F.concat(escape(F.col("role")), F.lit(template.named)))
    segments = F.array(
        F.struct(F.concat(marks_before, named).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text")).alias("text"),
                 _by_role(F.col("role"), template, lambda m: m.loss).alias("loss")),
        F.struct(_by_role(F.col("role"), template, lambda m: m.after).alias("text"),
                 F.lit(False).alias("loss")))
    return (t.withColumn("position", F.row_number().over(order))
            .withColumn("valid", F.coalesce(allowed, F.lit(False)))
            .withColumn("segments", segments))


def format_conversations(turns: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """One row per conversation: conv_id, formatted (the whole string), loss_spans (array of
    (start, end) under the loss mask, in code points of ``formatted``, end exclusive), valid
    (the machine accepts the order of turns and the last role may come last).

    Turns are first joined to strings per block of turns, so that a very long
    conversation's last step handles one string per block. Repeated rows are turns of
    their own; a null conv_id is a conversation. Other columns are ignored; an empty table
    gives no rows.
    """
    s = turn_segments(turns, template)
    block = F.floor((F.col("position") - 1) / BLOCK_TURNS)
    piece = F.concat(*[F.col("segments")[i]["text"] for i in range(3)])
    blocks = (s.select("conv_id", block.alias("block"), "position", "valid", "role",
                       piece.alias("piece"), F.col("segments")[1]["loss"].alias("loss"),
                       F.length(F.col("segments")[0]["text"]).alias("before"),
                       F.length(F.col("segments")[1]["text"]).alias("inside"))
              .groupBy("conv_id", "block").agg(
                  F.sort_array(F.collect_list(F.struct("position", "piece", "loss", "before",
                                                       "inside"))).alias("turns"),
                  F.min("valid").alias("valid"),
                  F.max(F.struct("position", "role")).alias("last")))
    sizes = F.transform("turns", lambda t: F.length(t["piece"]).cast("bigint"))
    spans = bound(running_sums(sizes), lambda starts: F.filter(F.transform("turns", lambda t, i: F.when(
        t["loss"], F.struct((F.get(starts, i) + t["before"]).alias("start"),
                            (F.get(starts, i) + t["before"] + t["inside"]).alias("end")))),
        lambda span: span.isNotNull()))
    blocks = blocks.select("conv_id", "block", "valid", "last",
                           F.array_join(F.col("turns.piece"), "").alias("piece"),
                           F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("size"),
                           spans.alias("spans"))
    whole = blocks.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("block", "piece", "size", "spans"))).alias("blocks"),
        F.min("valid").alias("valid"), F.max("last").alias("last"))
    begin = len(template.begin)
    moved = bound(running_sums(F.transform("blocks", lambda b: b["size"])), lambda starts: F.flatten(
        F.transform("blocks", lambda b, i: F.transform(b["spans"], lambda s: F.struct(
            (F.get(starts, i) + begin + s["start"]).alias("start"),
            (F.get(starts, i) + begin + s["end"]).alias("end"))))))
    return whole.select(
        "conv_id", F.concat(F.lit(template.begin), F.array_join("blocks.piece", ""))
        .alias("formatted"), moved.alias("loss_spans"),
        (F.col("valid") & F.col("last.role").isin(*template.final)).alias("valid"))


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def read_back(formatted: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """The turns of each formatted conversation, read from its string alone.

    Adds ``turns`` (array of (role, text), unescaped) and ``loss_text`` (the text of the roles under
    the loss mask, unescaped; what ``loss_spans`` cover). The string is split once, so the work grows
    with its length alone.
    """
    opens = "|".join(_quoted(m.before) for m in template.roles.values())
    body = F.expr(f"substring(formatted, {len(template.begin) + 1})")
    pieces = F.filter(F.split(body, f"(?={opens})", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        other = template.roles[OTHER]
        inner = p.substr(F.lit(len(other.before) + 1),
                         F.length(p) - len(other.before) - len(other.after))
        role = F.substring_index(inner, template.named, 1)
        out = F.struct(unescape(role).alias("role"), unescape(inner.substr(
            F.length(role) + len(template.named) + 1, F.length(inner))).alias("text"))
        for name, m in template.roles.items():
            if name != OTHER:
                text = p.substr(F.lit(len(m.before) + 1),
                                F.length(p) - len(m.before) - len(m.after))
                out = F.when(p.startswith(m.before),
                             F.struct(F.lit(name).alias("role"), unescape(text).alias("text"))
                             ).otherwise(out)
        return out

    lossy = [name for name, m in template.roles.items() if m.loss and name != OTHER]
    plain = [name for name, m in template.roles.items() if not m.loss and name != OTHER]

    def has_loss(turn: Column) -> Column:
        if template.roles[OTHER].loss:
            return ~turn["role"].isin(*plain)
        return turn["role"].isin(*lossy)

    back = formatted.withColumn("turns", F.transform(pieces, turn))
    return back.withColumn("loss_text", F.array_join(F.transform(
        F.filter("turns", has_loss), lambda t: t["text"]), ""))


def conversation_digests(formatted: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """Digests of what ``read_back`` finds: n_turns, turns_sha256 (of role, newline, text,
    newline per turn), loss_chars, loss_sha256, formatted_chars."""
    back = read_back(formatted, template)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
