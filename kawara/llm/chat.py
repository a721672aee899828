"""Chat formatting with a grammar that reads back exactly what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quality import let

START, END = "<|im_start|>", "<|im_end|>"

#: A control string in a text, after any number of backslashes.
_CONTROL = r"\|(im_start|im_end)\|>"


def escape(text: Column) -> Column:
    """One more backslash in every control string, and in every escaped one."""
    return F.regexp_replace(text, r"<(\\*)" + _CONTROL, r"<\\$1|$2|>")


def unescape(text: Column) -> Column:
    """One backslash less in every escaped control string."""
    return F.regexp_replace(text, r"<\\(\\*)" + _CONTROL, r"<$1|$2|>")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("|"), F.lit("%7C"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), _role_out(role), F.lit("\n"), body, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>; null if it doesn't follow the grammar.

    conversation := turn*; turn := START role newline body END newline. A role holds no newline; a body reaches to the
    next END and holds no START.
    """
    cut = F.split(formatted, r"<\|im_end\|>", -1)

    def turns(pieces: Column) -> Column:
        bodies = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, i: F.when(i > 0, F.when(p.startswith("\n"), p.substr(F.lit(2), F.length(p))).otherwise("")).otherwise(p))
        inner = F.transform(bodies, lambda p: F.when(p.startswith(START), p.substr(F.lit(len(START) + 1), F.length(p))))
        good = lambda p: p.isNotNull() & ~p.contains(START) & p.contains("\n")
        split = lambda p: F.struct(_role_in(F.substring_index(p, "\n", 1)).alias("role"), unescape(p.substr(F.instr(p, "\n") + 1, F.length(p))).alias("text"))
        last = F.element_at(pieces, -1)
        ends = ((F.size(pieces) > 1) & (last == "\n")) | ((F.size(pieces) == 1) & (last == ""))
        return let(inner, lambda p: F.when(ends & F.forall(p, lambda x: F.coalesce(good(x), F.lit(False))), F.transform(p, split)))

    return let(cut, turns)


def _conflicts(role: Column, text: Column, body: Column) -> Column:
    want = F.array(F.struct(role.alias("role"), text.alias("text")))
    return ~F.coalesce(parse(render(role, body)) == want, F.lit(False))


def format_chats(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant", rounds: int = 2) -> DataFrame:
    """One row a conversation: id_col, formatted, n_turns and loss_spans, array<struct<start, end>> in code points.

    Each turn is rendered as it stands and parsed again; where that doesn't give the turn back, its text is escaped,
    and so on until it does. The whole conversation is parsed once more and compared to its source; a difference is an
    error, never a row. The spans hold the bodies of ``trained_role``.

    Turns are ordered by number, then role and text, so ties have one order; null numbers come first. A null text or
    role is empty; rows of a null id are one conversation; no rows, none. Extra columns go. A conversation is one
    value of the result, so one task puts it together.
    """
    ident, turn, role, text = (F.col(c) for c in (id_col, turn_col, role_col, text_col))
    rows = turns.select(ident.alias("id"), turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    body = text
    for _ in range(rounds):
        body = let(body, lambda b: F.when(_conflicts(role, text, b), escape(b)).otherwise(b))
    rows = rows.withColumn("body", body).withColumn("piece", render(role, F.col("body")))
    order = Window.partitionBy("id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("end", before + F.length("piece") - len(END) - 1)
    rows = rows.withColumn("start", F.col("end") - F.length("body"))
    out = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "piece", "start", "end"))).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == trained_role), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    out = out.select("id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"), spans.alias("loss_spans"), source.alias("source"))
    same = F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't read back")).cast("string"))
    return out.select(F.col("id").alias(id_col), checked.alias("formatted"), "n_turns", "loss_spans")


def trained_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, read from the formatted conversation and unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
