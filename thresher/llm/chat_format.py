"""Chat formatting with DataFrame functions only.

A template is declarative: a mark before and after each turn, the roles that carry loss, a table of which role may follow
which, and the control strings of any tokenizer that a text must not be able to forge. A finite-state machine whose state
is the role of the turn before checks the order of turns; conversations out of order are reported, not dropped. The
output is a list of segments, each with a loss flag, whose texts joined are the formatted conversation.

Escaping: a backslash is doubled and one is put after the first character of every control string, so that none is left;
reading back drops a backslash before any character. This is reversible for every string.

Cases: a null text or role is empty; a null turn sorts first; ties of a turn are ordered by role, then text; repeated rows
are repeated turns; rows with a null conv_id are one conversation. Any role string is kept and escaped; one that the table
doesn't know is out of order. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


@dataclass(frozen=True)
class Template:
    open: str = "<|turn:"
    close: str = "|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: State (the role before; "" at the start) to the roles that may come.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    controls: tuple[str, ...] = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


DEFAULT = Template()


def escape(text: Column, t: Template = DEFAULT) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in t.controls:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, in_order, first_bad (the number of the first turn out of order, or null), segments (array of
    text, loss), formatted."""
    empty = F.lit("")
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")))).alias("turns"))
    table = F.create_map(*(x for a, bs in t.follows.items() for b in bs for x in (F.lit(f"{a}\n{b}"), F.lit(True))))

    def good(x: Column, i: Column) -> Column:
        state = F.when(i == 0, empty).otherwise(F.get("turns", i - 1)["role"])
        return F.coalesce(table[F.concat(state, F.lit("\n"), x["role"])], F.lit(False))

    def segments(x: Column) -> Column:
        mark = F.concat(F.lit(t.open), escape(x["role"], t), F.lit(t.close))
        return F.array(
            F.struct(mark.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
        )

    out = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_position(F.transform("turns", good), False).alias("bad"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select("conv_id", "n_turns", (F.col("bad") == 0).alias("in_order"), F.when(F.col("bad") > 0, F.col("bad") - 1).alias("first_bad"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column, t: Template = DEFAULT) -> Column:
    """The array of turns (role, text) that a formatted conversation holds."""
    parts = F.split(formatted, re.escape(t.end), -1)  # what follows the last end is empty
    at = len(t.open) + 1
    stop = lambda x: F.instr(x, F.lit(t.close))
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda x: F.struct(unescape(F.substring(x, F.lit(at), stop(x) - at)).alias("role"), unescape(F.substring(x, stop(x) + len(t.close), F.char_length(x))).alias("text")),
    )


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    out = format_chats(rows.union(more)).withColumns({"back": read_turns(F.col("formatted")), "loss": read_loss(F.col("segments"))})
    told = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "in_order", F.coalesce("first_bad", F.lit(-1)).cast("long").alias("first_bad"),
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w - 1 AS i, coalesce(lag(role) OVER w, '') AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), e AS (
  SELECT *, (before || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS good,
    replace(text, chr(92), chr(92) || chr(92)) AS x, replace(role, chr(92), chr(92) || chr(92)) AS y FROM n
), s AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(x, '<|', '<\|'), '|>', '|\>'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS xx FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(xx) + length(y) + 16) AS BIGINT) AS formatted_chars, bool_and(good) AS in_order, coalesce(min(i) FILTER (NOT good), -1) AS first_bad
FROM s GROUP BY conv_id
"""
