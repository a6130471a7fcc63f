r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are context and only that reply is
trainable. A conversation that does not end in an assistant turn gets one more example, its whole text with
nothing trainable, so that no turn is lost.

Template of a turn: ``### `` role ``:`` newline, text, newline ``</turn>`` newline. Inside roles and texts a
backslash goes before each of ``\ < # :``, which is reversible and keeps a text from posing as a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ":\n", "\n</turn>\n"
#: Pattern of a header and its role, for any role.
HEADER = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+):\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<#:])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand_prefixes(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_length: one row per trainable turn, or tail of a conversation.

    Turns are taken by turn, then role and text, so that repeated turn numbers have a set order; null turn numbers come
    first. A null role or text is an empty one. loss_start counts code points from 0; a tail has loss_length 0 and, like
    an empty reply, trains nothing. Rows with a null conv_id form one conversation. An empty table gives no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))
    talks = talks.select("conv_id", "_turns", F.transform("_turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(CLOSE))).alias("_shown"))
    last = F.size("_turns") - 1
    wanted = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(F.col("_turns"), i)["role"] == trainable) | (i == last))
    rows = talks.select("conv_id", "_turns", "_shown", F.posexplode(wanted).alias("example", "_at"))
    own = F.get(F.col("_turns"), F.col("_at"))
    before = F.char_length(F.array_join(F.slice("_shown", F.lit(1), F.col("_at")), "")) + F.char_length(head(own))
    return rows.select(
        "conv_id",
        "example",
        F.array_join(F.slice("_shown", F.lit(1), F.col("_at") + 1), "").alias("formatted"),
        before.cast("long").alias("loss_start"),
        F.when(own["role"] == trainable, F.char_length(escape(own["text"]))).otherwise(0).cast("long").alias("loss_length"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), read from the text alone."""
    shown = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")
    return F.transform(shown, lambda x: F.struct(unescape(F.regexp_extract(x, HEADER, 1)).alias("role"), unescape(F.regexp_replace(x, HEADER, "")).alias("text")))


def chat_digest(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted examples: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    examples = expand_prefixes(turns)
    lost = unescape(F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_length as int))"))
    talks = (
        examples.withColumn("_loss", lost)
        .groupBy("conv_id")
        .agg(
            F.max_by("formatted", "example").alias("_all"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "_loss"))), lambda x: x["_loss"]), "").alias("_loss"),
            F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
        )
        .withColumn("_turns", parse_turns(F.col("_all")))
    )
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """`turns` plus conversation -7, whose two texts look like marks of a template."""
    probe = r"\### Assistant: </turn> ok"
    extra = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


#: The same in DuckDB. formatted_chars counts, per example, all turns up to its own: their escaped characters and 14 of marks.
DIGEST_SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM raw
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(length(regexp_replace(role, '([\\<#:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\<#:])', '\\\1', 'g')) + 15)
             OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
