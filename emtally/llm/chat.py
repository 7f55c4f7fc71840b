"""Chat formatting: a finite-state machine over roles, and text segments with loss flags, all in DataFrame functions.

A template is declared as data: what opens and closes a turn, which roles are trained on, which role may
follow which. The machine's state is the last turn's role, so a turn's step needs only its own role and the one before,
and all steps of a conversation are taken in one pass over its turns: each says whether the turn may stand there and
whether the state that it leads to is trained on, and emits the turn's segments. Texts and roles are escaped so that no control string of the template can occur in them, and
the escape is reversible, so ``read_back`` recovers every turn from the formatted string alone.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    trained_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> roles that may come next; the state after a turn is its role
    follows: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accept: tuple[str, ...] = ("user", "assistant")
    #: (in the text, in the output), applied in this order and undone in the opposite one. After the first,
    #: each ``%`` is followed by ``p`` or ``n``, so the second's output is not found in an escaped text.
    escapes: tuple[tuple[str, str], ...] = (("%", "%p"), ("<|", "<%b"))
    role_escapes: tuple[tuple[str, str], ...] = (("%", "%p"), ("<|", "<%b"), ("\n", "%n"))


#: Between a state and the role that comes next. No role of a template holds it, so no other pair gives the same string.
_TO = "\0>"


def _escape(c: Column, pairs) -> Column:
    for plain, safe in pairs:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def _unescape(c: Column, pairs) -> Column:
    for plain, safe in reversed(pairs):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def format_chat(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per ``conv_id`` (null is a conversation of its own): ``turns`` array<struct<role,text>>,
    ``segments`` array<struct<text,loss>>, ``formatted`` (the segments' texts joined), ``valid`` (the roles
    follow the template from its start to an accepting state) and ``rejected_at`` (index of the first turn
    that may not stand where it does, or null).

    Turns are ordered by (turn, role, text), nulls first; repeated rows are kept. A null role or text is
    empty. Conversations with a wrong turn order are formatted too, with ``valid`` false. Other columns of
    the input are ignored. A conversation is the unit of the result, so its turns meet in one row.
    """
    rows = conversations.select(
        F.col("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    allowed = [state + _TO + role for state, roles in template.follows.items() for role in roles]

    def step(t: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col("turns"), i - 1)["role"], F.lit(template.start))
        return F.struct(
            F.concat(before, F.lit(_TO), t["role"]).isin(allowed).alias("may"),
            F.array(
                F.struct(F.concat(F.lit(template.open), _escape(t["role"], template.role_escapes), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
                F.struct(_escape(t["text"], template.escapes).alias("text"), t["role"].isin(*template.trained_roles).alias("loss")),
                F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
            ).alias("segments"),
        )

    bad = F.array_position(F.transform("steps", lambda s: s["may"]), False).cast("int")
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .withColumn("steps", F.transform("turns", step))
        .select(
            "conv_id",
            F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
            F.flatten(F.transform("steps", lambda s: s["segments"])).alias("segments"),
            ((bad == 0) & F.element_at("turns", -1)["role"].isin(*template.accept)).alias("valid"),
            F.when(bad > 0, bad - 1).alias("rejected_at"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Adds ``read_turns`` (array<struct<role,text>>, parsed from ``formatted`` alone) and ``loss_text``
    (the unescaped text under the loss flags, in order, nothing between). It is cut from ``formatted`` too: a turn has three segments,
    what opens it, its text and what closes it, so the text of the i-th turn that is read is under the flag of segment 3 i + 1."""
    pieces = F.filter(F.split("formatted", F.concat(F.lit("\\Q"), F.lit(template.close), F.lit("\\E")), -1), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(template.open) + 1))
    role = lambda p: F.substring_index(body(p), template.after_role, 1)
    flags = F.transform(F.filter("segments", lambda s, i: i % 3 == 1), lambda s: s["loss"])
    return formatted.withColumn("flags", flags).withColumn(
        "read_turns",
        F.transform(
            pieces,
            lambda p: F.struct(
                _unescape(role(p), template.role_escapes).alias("role"),
                _unescape(F.substr(p, F.length(role(p)) + len(template.open) + len(template.after_role) + 1), template.escapes).alias("text"),
            ),
        ),
    ).withColumn("loss_text", F.array_join(F.transform(F.filter("read_turns", lambda t, i: F.get("flags", i)), lambda t: t["text"]), "")).drop("flags")
