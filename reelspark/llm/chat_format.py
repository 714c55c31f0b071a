"""Chat formatting: conversations rebuilt from an event log, then rendered with a reversible template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.llm.common import read, text_or_empty

HEAD, SEP, END = "### ", ": ", "</turn>"


def escaped(text: Column) -> Column:
    r"""Puts a backslash inside every control string, so that `###` and `</turn>` never occur in the result."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(text, "(?<=#)#", r"\\#"), F.lit(END), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(SEP), F.lit(":\\ "))


def rebuild(events: DataFrame) -> DataFrame:
    """Final messages of each conversation: conv_id, turn, ord, role, text.

    events has conv_id, seq, kind, turn, role, text, one row per logged event:
    `message` opens a message at its turn; `delta` appends text to the message open at that turn; `edit` replaces
    that message's text; `regenerate` empties it, for the deltas that follow. An edit or regeneration at a turn
    discards every message of a later turn that was opened before it. Events of a turn are sorted by seq, then
    kind (message, edit, regenerate, delta), role and text, so that ties and repeated rows have one result; deltas, edits
    and regenerations before any message open one with their own role. Nulls: text counts as empty, kind as `message`, role
    as empty; a null conv_id, turn or seq is a value of its own that sorts first.

    The events of one turn are folded first, dealt by conversation and turn; only whole messages are then
    gathered by conversation.
    """
    e = events.select("conv_id", F.col("turn").cast("long").alias("turn"), "seq", F.coalesce("kind", F.lit("message")).alias("kind"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "regenerate", 2).otherwise(3)
    turns = W.partitionBy("conv_id", "turn").orderBy("seq", "rank", "role", "text")
    up_to = turns.rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("rank", rank).withColumn("place", F.row_number().over(turns))
    e = e.withColumn("message", F.sum(F.when((F.col("rank") == 0) | (F.col("place") == 1), 1).otherwise(0)).over(up_to))
    # within a message, the last opening, edit or regeneration starts its text anew
    e = e.withColumn("version", F.sum((F.col("rank") < 3).cast("int")).over(up_to))
    m = e.groupBy("conv_id", "turn", "message").agg(
        F.min_by("seq", "place").alias("opened"),
        F.min_by("role", "place").alias("role"),
        F.max("version").alias("version"),
        F.sort_array(F.collect_list(F.struct("place", "version", "rank", "text"))).alias("parts"),
        F.max(F.when(F.col("rank").isin(1, 2), F.struct(F.col("seq").isNotNull().alias("some"), "seq"))).alias("cut"),
    )
    kept = F.filter("parts", lambda p: (p["version"] == F.col("version")) & (p["rank"] != 2))
    m = m.withColumn("text", F.array_join(F.transform(kept, lambda p: p["text"]), ""))
    m = m.withColumn("turn_cut", F.max("cut.seq").over(W.partitionBy("conv_id", "turn")))
    m = m.withColumn("carried", F.max("turn_cut").over(W.partitionBy("conv_id").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)))
    m = m.filter(F.col("carried").isNull() | F.col("opened").isNull() | (F.col("opened") > F.col("carried")))
    return m.select("conv_id", "turn", F.col("message").alias("ord"), "role", "text")


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, end in code points, end exclusive).

    Each turn reads `### role: text</turn>` and a newline, control strings inside roles and texts escaped; the
    spans cover the escaped text of the roles to learn, in order. Messages are sorted by turn, ord, role, text.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "ord", "role", "text")
    m = messages.withColumn("head", F.concat(F.lit(HEAD), escaped_role(F.col("role")), F.lit(SEP))).withColumn("body", escaped(F.col("text")))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    m = m.withColumn("place", F.row_number().over(order))
    m = m.withColumn("before", F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("before") + F.length("head")
    m = m.withColumn("span", F.when(F.col("role").isin(*learn), F.struct(start.alias("start"), (start + F.length("body")).alias("end"))))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "span"))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return g.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """Reads turns and learnt text back from render's output: conv_id, turns (array of role, text), loss (text)."""
    pieces = F.filter(F.split("formatted", END + "\n"), lambda p: F.length(p) > 0)
    at = lambda p: F.instr(p, SEP)
    turns = F.transform(pieces, lambda p: F.struct(unescaped(F.substring(p, len(HEAD) + 1, at(p) - len(HEAD) - 1)).alias("role"), unescaped(F.substring(p, at(p) + len(SEP), F.length(p))).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Whole rows as events: each opens one message of its turn."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")


def streamed_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log of a chat that came to them: a third of the texts is streamed in deltas, a third drafted and edited, a third drafted and
    regenerated, by the text's crc32. Rows without a turn, or that share one, are whole messages. rebuild gives the rows again."""
    text, turn = F.col("text"), F.col("turn").cast("decimal(38,0)")
    third = F.floor(F.length(text) / 3).cast("int")
    parts = [F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substring(text, 2 * third + 1, F.length(text))]
    draft = F.concat(F.lit("draft "), F.reverse(F.substring(text, 1, 24)))
    event = lambda k, kind, said: F.struct((turn * 8 + k).alias("seq"), F.lit(kind).alias("kind"), F.col("role").alias("role"), said.alias("text"))
    deltas = lambda k: [event(k + i, "delta", p) for i, p in enumerate(parts)]
    streamed = F.array(event(0, "message", F.lit("")), *deltas(1))
    edited = F.array(event(0, "message", draft), event(1, "delta", F.lit(" and more")), event(2, "edit", parts[0]), event(3, "delta", F.concat(*parts[1:])))
    again = F.array(event(0, "message", draft), event(1, "delta", F.lit(" and more")), event(2, "regenerate", F.lit("")), *deltas(3))
    how = F.crc32(text.cast("binary")) % 3
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text_or_empty("text").alias("text"))
    rows = rows.withColumn("_n", F.count("*").over(W.partitionBy("conv_id", "turn")))
    log = F.when(F.col("turn").isNull() | (F.col("_n") > 1), F.array(event(0, "message", text))).when(how == 0, streamed).when(how == 1, edited).otherwise(again)
    return rows.select("conv_id", "turn", F.explode(log).alias("e")).select("conv_id", "e.seq", "e.kind", "turn", "e.role", "e.text")


def format_chats(events: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    return render(rebuild(events), learn)


CONTROL = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    p = parse(format_chats(streamed_events(rows.unionByName(extra))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return p.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op1_chat_format": op1_chat_format}
ORACLE = {
    "op1_chat_format": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (SELECT *, length(replace(text, '\', '\\')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS grown,
             list_sum(list_transform(regexp_extract_all(text, '#+'), lambda x: length(x) - 1)) AS hashes,
             length(replace(role, '\', '\\')) AS role_len FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + role_len + 2 + grown + coalesce(hashes, 0) + 8) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""
}
