"""Chat formatting from an event log, in DataFrame functions only.

Events of a conversation address a turn: a `message` starts one, a `delta` adds to it, an `edit` or a `regenerate`
replaces what it said. Events are grouped by conversation and turn, sorted by sequence and folded into final messages;
these are grouped by conversation, sorted and rendered. In texts and roles a backslash is doubled and `<|` becomes
`<\\|`, so the template's marks stand nowhere else and a reader gets every text back.

Defined results: null texts and roles are empty; a null turn sorts first; repeated messages of one turn all stay, in
the order of sequence, role and text; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, messages (role, text) from conv_id, turn, seq, kind, role, text."""
    event = F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(event)).alias("log"))
    starts = F.filter(F.sequence(F.lit(1), F.size("log")), lambda i: (i == 1) | (F.element_at("log", i)["kind"] == "message"))

    def message(first: Column, k: Column) -> Column:
        after = F.coalesce(F.get(F.col("starts"), k + 1), F.size("log") + 1)
        own = F.slice("log", first, after - first)
        resets = F.transform(own, lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i + 1).otherwise(1))
        said = F.slice(own, F.array_max(resets), F.size(own))
        return F.struct(F.element_at(own, 1)["role"].alias("role"), F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text"))

    return log.withColumn("starts", starts).select("conv_id", "turn", F.transform("starts", message).alias("messages"))


def as_events(rows: DataFrame) -> DataFrame:
    """The event log in which rows (conv_id, turn, role, text) were written: other roles than the assistant's open with the
    first half of their text and are edited to the whole; the assistant streams the first half, regenerates and streams
    both halves. Rows of one turn stand in the order of role and text."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2)
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    at = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), text)).cast("long") * 8

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*(F.struct((F.col("at") + k).alias("seq"), F.lit(kind).alias("kind"), said.alias("text")) for k, (kind, said) in enumerate(events)))

    streamed = log(("message", F.lit("")), ("delta", first), ("regenerate", F.lit("")), ("delta", first), ("delta", second))
    edited = log(("message", first), ("edit", text))
    both = rows.withColumn("at", at).withColumn("e", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)))
    return both.select("conv_id", "turn", "e.seq", "e.kind", "role", "e.text")


def render(folded: DataFrame) -> DataFrame:
    """conv_id and the formatted conversation."""
    grouped = folded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "messages"))).alias("turns"))
    messages = F.flatten(F.transform("turns", lambda t: t["messages"]))
    shown = F.transform(messages, lambda m: F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT), escape(m["text"]), F.lit(END)))
    return grouped.select("conv_id", F.array_join(shown, "").alias("formatted"))


def read(formatted: Column) -> Column:
    """The messages (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p != "")
    body = F.transform(parts, lambda p: F.split(F.substring(p, len(TURN) + 1, F.length(p)), r"<\|text\|>", 2))
    return F.transform(body, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def digests(rendered: DataFrame) -> DataFrame:
    """What a reader finds in each formatted conversation; loss falls on the texts of the assistant."""
    m = rendered.withColumn("m", read(F.col("formatted")))
    lost = F.array_join(F.transform(F.filter("m", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    return m.select(
        "conv_id",
        F.size("m").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
