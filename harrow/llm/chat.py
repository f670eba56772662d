"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context and only its reply is trainable. A conversation that does not end with
an assistant turn gets one more example without a trainable part, so that no
turn is lost. The template is

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

for each turn. Inside texts a ``<`` that is followed by backslashes and ``|``
gets one backslash more, so a control string can never occur in an escaped text
and taking one backslash away gives the text back. In roles ``%`` and line feed
are written ``%25`` and ``%0A`` first.

An example must hold every turn before its target, so a conversation is the
unit that one row holds; nothing larger is gathered anywhere.

Defined cases: null texts and roles count as empty; turns are taken in the order
of (turn, role, text) with null turn numbers first, repeated rows are turns of
their own; rows with a null conversation id are one conversation; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def expand(conversations: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", target_role="assistant") -> DataFrame:
    """One row per example: conv_id, example, n_turns, formatted, loss_start, loss_end, complete.

    loss_start and loss_end: code points of ``formatted`` that are trainable,
    null where nothing is. complete: the example holds the whole conversation.
    """
    none = F.lit("")
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), none).alias("role"), F.coalesce(F.col(text_col), none).alias("text"))
    talks = conversations.select(F.col(id_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rendered = F.transform("turns", lambda t: F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END)))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == F.size("turns")) | (F.element_at("turns", i)["role"] == target_role))
    each = talks.select("conv_id", "turns", rendered.alias("rendered"), F.posexplode(ends).alias("example", "end"))
    target = F.element_at("turns", F.col("end"))
    each = each.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("end").cast("long").alias("n_turns"),
        F.array_join(F.slice("rendered", F.lit(1), F.col("end")), "").alias("formatted"),
        F.when(target["role"] == target_role, F.length(escape(target["text"]))).alias("loss"),
        (F.col("end") == F.size("turns")).alias("complete"),
    )
    stop = F.length("formatted") - len(END)
    return each.select("conv_id", "example", "n_turns", "formatted", F.when(F.col("loss").isNotNull(), stop - F.col("loss")).alias("loss_start"), F.when(F.col("loss").isNotNull(), stop).alias("loss_end"), "complete")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted example: an array of (role, text)."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, F.lit(2), F.size(parts))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - F.lit(1 + len(END)))
        return F.struct(_role_in(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def digest_of(examples: DataFrame) -> DataFrame:
    """What the examples say when they are read back, one row per conversation."""
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    read = examples.select(
        "conv_id",
        F.when(F.col("complete"), F.struct(F.size(turns).cast("long").alias("n"), F.sha2(F.array_join(turns, ""), 256).alias("sha"))).alias("turns"),
        F.struct("example", F.coalesce(loss, F.lit("")).alias("text")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(F.max("turns").alias("turns"), F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest_of(expand(rows))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, sum(12 + length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11)
              OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM c)
SELECT conv_id, max(n_turns) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR n = n_turns)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
