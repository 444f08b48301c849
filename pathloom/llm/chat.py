"""Prefix-target expansion of conversations.

Every assistant turn becomes one training example: all preceding turns are context and only that
reply is trainable. A conversation that doesn't end with a reply yields one more example without
a trainable part, so that no turn is lost. Rows of a conversation are ordered by turn, then role,
then text (nulls first), so repeated and tied rows have a fixed order. Null texts and roles are
empty, a null conversation id is an id of its own, an empty table gives no examples.

A turn is written as ``### role: text</turn>`` and a line end. Inside roles and texts the
characters ``\\ # <`` (in roles ``:`` as well) become ``\\b \\h \\l \\c``, so no marker can occur
there and the texts can be read back exactly.

A conversation is the unit of work: its examples hold O(turns squared) text by definition of the
expansion, and each is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for raw, safe in (("#", "\\h"), ("<", "\\l"), *([(":", "\\c")] if role else [])):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def unescape(text: Column) -> Column:
    for raw, safe in (("#", "\\h"), ("<", "\\l"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def prefix_targets(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per example: conv id, example (from 0), n_turns in it, formatted, loss_start (1-based code point) and loss_len, null without a trainable part."""
    rows = turns.select(
        F.col(conv).alias(conv),
        F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")).alias("turn_"),
    )
    talks = rows.groupBy(conv).agg(F.sort_array(F.collect_list("turn_")).alias("turns_"))
    head = lambda x: F.concat(F.lit(OPEN), escape(x["r"], True), F.lit(SEP))
    talks = talks.select(
        conv,
        F.transform("turns_", lambda x: F.concat(head(x), escape(x["x"]), F.lit(CLOSE))).alias("parts_"),
        F.filter(F.transform("turns_", lambda x, i: F.when(x["r"] == target, i + 1).otherwise(F.lit(0))), lambda i: i > 0).alias("replies_"),
        F.transform("turns_", lambda x: F.char_length(escape(x["x"]))).alias("lens_"),
    )
    ends = F.when(F.coalesce(F.try_element_at("replies_", F.lit(-1)), F.lit(0)) == F.size("parts_"), F.col("replies_")).otherwise(F.concat("replies_", F.array(F.size("parts_"))))
    each = talks.select(conv, "parts_", "lens_", F.size("replies_").alias("n_replies_"), F.posexplode(ends).alias("example", "n_turns"))
    each = each.select(
        conv,
        "example",
        "n_turns",
        F.array_join(F.slice("parts_", 1, F.col("n_turns")), "").alias("formatted"),
        F.when(F.col("example") < F.col("n_replies_"), F.element_at("lens_", F.col("n_turns"))).alias("loss_len"),
    )
    return each.withColumn("loss_start", F.char_length("formatted") - len(CLOSE) - F.col("loss_len") + 1)


def read_turns(formatted: Column) -> Column:
    """The turns of an example as array of (role, text), read back from its text."""
    parts = F.slice(F.split(formatted, F.lit(CLOSE)), 1, F.size(F.split(formatted, F.lit(CLOSE))) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substr(F.substring_index(p, SEP, 1), F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(p, F.char_length(F.substring_index(p, SEP, 1)) + len(SEP) + 1)).alias("text"),
        ),
    )


def digests(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from the formatted examples alone: turns, trainable text and lengths."""
    loss = unescape(F.substr("formatted", F.col("loss_start"), F.col("loss_len")))
    per = examples.select(conv, "example", "n_turns", "formatted", F.struct("example", F.coalesce(loss, F.lit("")).alias("text")).alias("loss_"))
    per = per.groupBy(conv).agg(
        F.max_by("formatted", "example").alias("whole_"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss_")), lambda x: x["text"]), "").alias("loss_"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns = read_turns(F.col("whole_"))
    return per.select(
        conv,
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        F.col("n_examples").cast("long").alias("n_examples"),
    )


PLANTED = ((-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"))


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return digests(prefix_targets(turns.unionByName(planted)))


def _sql_escape(x: str, role: bool = False) -> str:
    out = f"replace(replace(replace({x}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"
    return f"replace({out}, ':', '\\c')" if role else out


ORACLE = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), sized as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as n,
    sum(length('### ' || {_sql_escape("role", True)} || ': ' || {_sql_escape("text")} || '</turn>') + 1) over w as upto
  from turns window w as (partition by conv_id order by turn, role, text rows between unbounded preceding and current row)
)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(length(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' or i = n then upto else 0 end) as bigint) as formatted_chars,
  cast(sum(case when role = 'assistant' or i = n then 1 else 0 end) as bigint) as n_examples
from sized group by conv_id
"""
