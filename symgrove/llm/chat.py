"""Chats rebuilt from their event logs.

A log row is (conv_id, seq, msg, kind, role, text).  Messages are numbered by
``msg`` within their conversation, and events apply in the order of ``seq``:

* ``open`` starts message ``msg`` for ``role``;
* ``delta`` appends ``text`` to it;
* ``edit`` replaces its content by ``text``;
* ``regenerate`` empties it, and deltas for the new content follow.

Edits and regenerations also drop all messages after ``msg`` that the log has
had so far, as chat interfaces do.  So an event counts unless a later edit or
regeneration is of its own message or an earlier one, which a window minimum
over the rest of the conversation tells: the fold needs no Python and a single
shuffle, by conversation.  An ``open`` outlives those of its own message.

``render`` writes ``<|im_start|>role``, the text and ``<|im_end|>``.

Defined cases: events with a null conv_id, seq or msg, or of another kind, are
left out.  Of rows with the same conv_id and seq one counts, the least by
(msg, kind, role, text).  A null text is empty.  The role is that of the last
open that counts, ``unknown`` if that is null or there is none.  A conversation
without any message left has an empty text and 0 messages.  ``<|`` in a text
becomes ``< |``.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ["open", "delta", "edit", "regenerate"]
LOG = ["conv_id", "seq", "msg", "kind", "role", "text"]
#: Characters of a delta in the log made by as_log().
PIECE = 48


def as_log(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """The event log of finished conversations (conv_id, turn, role, text).

    A stand-in for a chat server's log.  Turns are streamed in deltas; by a
    hash of (conv_id, turn) some are drafted and edited, or regenerated, of
    these some after an abandoned next message.  Folding it gives back the
    turns.  Of rows that repeat a turn the last by (role, text) remains.  Rows
    with a null conv_id or turn are left out.
    """
    src = conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), "text"))
    style = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), 1, 1), 16, 10).cast("int")
    null = F.lit(None).cast("string")
    event = lambda kind, text=null, role=null, msg=F.col("turn"): F.struct(msg.alias("msg"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.array().cast("array<struct<msg:bigint,kind:string,role:string,text:string>>")
    when = lambda test, *events: F.when(test, F.array(*events)).otherwise(none)
    draft = event("delta", F.substring("text", 1, 24))
    events = F.concat(
        when(F.col("nth") > 1, event("regenerate")),
        F.array(event("open", role=F.col("role"))),
        when(F.col("style") < 8, draft),
        when(F.col("style").isin(4, 5), event("open", role=F.lit("user"), msg=F.col("turn") + 1), event("delta", F.lit("never mind"), msg=F.col("turn") + 1)),
        when(F.col("style") < 6, event("regenerate")),
        when(F.col("style").isin(6, 7), event("edit", F.col("text"))),
        F.when(F.col("style").isin(6, 7), none).otherwise(F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), lambda x: event("delta", x))),
    )
    each = src.withColumns({"nth": nth, "style": style}).select("conv_id", "turn", "nth", F.posexplode(events).alias("step", "e"))
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "nth", "step"))
    return each.select("conv_id", seq.cast("long").alias("seq"), "e.msg", "e.kind", "e.role", "e.text")


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, n_events, messages): messages are (msg, role, text) in order."""
    log = log.select(*[F.col(c).cast("long" if c in LOG[:3] else "string").alias(c) for c in LOG]).filter(F.col("conv_id").isNotNull() & F.col("seq").isNotNull() & F.col("msg").isNotNull() & F.col("kind").isin(KINDS))
    # distributed by conversation, for the windows and groups alike
    once = F.row_number().over(Window.partitionBy("conv_id", "seq").orderBy("msg", "kind", "role", "text"))
    log = log.repartition("conv_id").withColumn("once", once).filter("once = 1")
    rest = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    resets = F.min(F.when(F.col("kind").isin("edit", "regenerate"), F.col("msg"))).over(rest)
    log = log.withColumn("cut", F.coalesce(resets, F.lit((1 << 63) - 1)))
    says = F.col("kind").isin("delta", "edit", "regenerate") & (F.col("cut") > F.col("msg"))
    opens = (F.col("kind") == "open") & (F.col("cut") >= F.col("msg"))
    per = log.groupBy("conv_id", "msg").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(says, F.struct("seq", F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))))).alias("said"),
        F.max_by("role", F.when(opens, F.col("seq"))).alias("role"),
        F.max(F.when(opens, F.col("seq"))).isNotNull().alias("opened"),
    )
    message = F.struct("msg", F.coalesce("role", F.lit("unknown")).alias("role"), F.array_join(F.transform("said", lambda x: x["text"]), "").alias("text"))
    whole = F.sort_array(F.collect_list(F.when(F.col("opened") | (F.size("said") > 0), message)))
    return per.groupBy("conv_id").agg(F.sum("n").alias("n_events"), whole.alias("messages"))


def render(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), F.replace(m["role"], F.lit("<|"), F.lit("< |")), F.lit("\n"), F.replace(m["text"], F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))), "")


def rebuilt(log: DataFrame) -> DataFrame:
    """(conv_id, n_events, n_messages, text) of each conversation in the log."""
    return fold(log).select("conv_id", "n_events", F.size("messages").cast("long").alias("n_messages"), render(F.col("messages")).alias("text"))


def oracle(piece: int = PIECE) -> str:
    """DuckDB SQL for rebuilt(as_log(conversations)), straight from the turns."""
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, coalesce(text, '')) AS nth,
                 count(*) OVER (PARTITION BY conv_id, turn) AS of,
                 CAST('0x' || substr(md5(conv_id || '|' || turn), 1, 1) AS INTEGER) AS style
               FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    e AS (SELECT *, CASE WHEN nth > 1 THEN 1 ELSE 0 END + CASE WHEN style IN (6, 7) THEN 3
                 ELSE 1 + CAST(ceil(length(text) / {piece}.0) AS BIGINT) + CASE WHEN style < 4 THEN 2 WHEN style < 6 THEN 4 ELSE 0 END END AS n FROM t)
    SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_events, count(*) FILTER (WHERE nth = of) AS n_messages,
      string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (WHERE nth = of) AS text
    FROM e GROUP BY conv_id"""
