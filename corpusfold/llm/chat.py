"""Chat formatting from an event log, with native functions only.

A conversation is a log of events: ``message`` and ``delta`` append text to a message, ``edit`` replaces
its text, ``regenerate`` discards it so that the deltas that follow build it anew. Events are dealt by
conversation and folded in the order of their sequence; what survives is rendered with a template whose
control strings cannot come from a text, since texts are escaped reversibly.

Defined results: a null text is empty and a null role is the empty role; events with equal sequence are
ordered by kind, then text, and equal rows all count; messages are ordered by number and ties by role;
a message whose last event discards it stays, empty; a log without rows gives no conversations. Columns
of other names are not looked at. A conversation is one value, so it is limited to the 2 GB of a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
EVENTS = ("conv_id", "seq", "message", "kind", "role", "text")


def escape(text: Column) -> Column:
    """No ``<|`` and no backslash that does not begin an escape is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """As ``escape``; a role also ends its line, so line ends become an escape of their own."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # pairs of backslashes first: runs of backslashes always begin at an escape
    plain = F.transform(
        F.split(role, r"\\\\"),
        lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")),
    )
    return F.array_join(plain, "\\")


def fold(events: DataFrame) -> DataFrame:
    """The final messages of every conversation: conv_id, message, role, text."""
    clean = events.select(
        "conv_id", "seq", "message", F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    resets = F.col("kind").isin("edit", "regenerate")
    order = [F.col(c) for c in ("seq", "kind", "text")]
    whole = W.partitionBy("conv_id", "message", "role")
    placed = clean.withColumn("_place", F.row_number().over(whole.orderBy(*order)))
    last = F.coalesce(F.max(F.when(resets, F.col("_place"))).over(whole), F.lit(0))
    alive = placed.withColumn("_alive", (F.col("_place") >= last) & (F.col("kind") != "regenerate"))
    parts = F.sort_array(F.collect_list(F.when(F.col("_alive"), F.struct("_place", "text"))))
    return alive.groupBy("conv_id", "message", "role").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and loss_spans: (start, length) in code points of every trained text."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    pieces = messages.select(
        "conv_id", "message", "role", F.concat(head, body, F.lit(END)).alias("_piece"),
        F.length(head).alias("_head"), F.length(body).alias("_body"),
    )
    order = W.partitionBy("conv_id").orderBy("message", "role")
    before = F.coalesce(F.sum(F.length("_piece")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.select(
        "conv_id", F.row_number().over(order).alias("_n"), "_piece",
        F.when(F.col("role") == loss_role, F.struct((before + F.col("_head")).alias("start"), F.col("_body").cast("long").alias("length"))).alias("_span"),
    )
    rows = F.sort_array(F.collect_list(F.struct("_n", "_piece", "_span")))
    return placed.groupBy("conv_id").agg(rows.alias("_rows")).select(
        "conv_id",
        F.array_join(F.transform("_rows", lambda r: r["_piece"]), "").alias("formatted"),
        F.array_compact(F.transform("_rows", lambda r: r["_span"])).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order: role, text, and the length of the text as it stands there."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        line = F.instr(p, "\n")
        raw = F.substr(p, line + 1)
        return F.struct(
            unescape_role(F.substr(p, F.lit(len(START) + 1), line - len(START) - 1)).alias("role"),
            unescape(raw).alias("text"),
            F.length(raw).cast("long").alias("length"),
        )

    return F.transform(pieces, turn)


def read_back(rendered: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Digests of every conversation, taken from the formatted text and its mask alone."""
    turns = rendered.select("conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("_turns"))
    trained = F.filter("_turns", lambda t: t["role"] == loss_role)
    turns = turns.withColumn("_trained", trained)
    # the mask must lie over the trained texts, one span for each
    agrees = F.transform("_trained", lambda t: t["length"]) == F.transform("loss_spans", lambda s: s["length"])
    text = F.array_join(F.transform("_trained", lambda t: t["text"]), "")
    digested = turns.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.when(agrees, text).otherwise(F.raise_error(F.lit("loss mask and turns disagree"))).alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return digested.select(
        "conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log with one event a row.

    Every row is a message of its own, also where rows share turn and role: these are ordered by text.
    """
    order = ["turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    number = F.row_number().over(W.partitionBy("conv_id").orderBy(*order)).cast("long")
    return turns.select(
        "conv_id", F.col("turn").alias("seq"), number.alias("message"), F.lit("message").alias("kind"), "role", "text"
    )


def format_conversations(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Folds the log and renders every conversation."""
    return render(fold(events), loss_role)
