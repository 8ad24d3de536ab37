"""Chat formatting from event logs, in DataFrame functions.

A log has one row for each event of a conversation: a message opened, a delta streamed to it, an edit (its whole text
anew), a regeneration (its text so far thrown away) or a removal. Logs are partitioned by conversation, sorted by
sequence and folded to final messages, which are then rendered. Each turn stands between marks of its own; where a
text holds a mark of this or another common template, a tilde after its first character keeps it from being one, and
one more where tildes stand there already, so that reading back restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: What follows the first character of the control strings that texts must not show.
_TAILS = r"(?:\|(?:im_start|im_sep|im_end|system|user|assistant|endoftext|eot_id|start_header_id|end_header_id|begin_of_text)\|>|/?s>|</?SYS>>|/?INST\])"
OPEN, DELTA, EDIT, REGENERATE, REMOVE = "open", "delta", "edit", "regenerate", "remove"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(?=~*{_TAILS})", "$1~")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])~(?=~*{_TAILS})", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, msg, kind, role, text) -> final messages (conv_id, msg, seq, role, text).

    Events of a conversation apply by seq, ties by kind (open first), role and text. A message's text is the text of
    its last open, edit or regeneration and the deltas after it; its role that of its first event that has one; its
    place that of its first event. A message whose last open, edit, regeneration or removal is a removal goes. Null
    texts are empty, null roles too where no event has one; a null seq comes first; null conv_id or msg are values of
    their own; unknown kinds are deltas.
    """
    rank = F.when(F.col("kind") == OPEN, 0).otherwise(1)
    order = [F.col("seq").asc_nulls_first(), rank, F.col("kind"), F.col("role"), F.col("text")]
    w = Window.partitionBy("conv_id", "msg").orderBy(*order)
    resets = F.col("kind").isin(OPEN, EDIT, REGENERATE, REMOVE)
    staged = events.withColumn("nth", F.row_number().over(w)).withColumn("era", F.sum(F.when(resets, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gone = F.max(F.when(resets, F.struct("nth", (F.col("kind") == REMOVE).alias("gone"))))["gone"]
    part = F.struct("era", "nth", F.coalesce("text", F.lit("")).alias("text"))
    made = staged.groupBy("conv_id", "msg").agg(
        F.min("seq").alias("seq"), F.coalesce(gone, F.lit(False)).alias("gone"), F.max("era").alias("last"), F.sort_array(F.collect_list(part)).alias("parts"), F.min(F.when(F.col("role").isNotNull(), F.struct("nth", "role")))["role"].alias("role")
    )
    kept = F.transform(F.filter("parts", lambda p: p["era"] == F.col("last")), lambda p: p["text"])
    return made.where(~F.col("gone")).select("conv_id", "msg", "seq", F.coalesce("role", F.lit("")).alias("role"), F.concat_ws("", kept).alias("text"))


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Messages (conv_id, msg, seq, role, text) -> one row for each conversation: conv_id, formatted, loss_spans.

    Messages stand by seq, then msg. loss_spans are (start, end) in code points of formatted, over the escaped texts
    of the roles to learn. A conversation is one string, so one row holds all of it.
    """
    m = F.struct(F.col("seq"), F.col("msg"), escape("role").alias("role"), escape("text").alias("text"), F.col("role").isin(*learn).alias("loss"))
    made = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(m)).alias("m"))
    turn = lambda x: F.concat(F.lit(START), x["role"], F.lit(SEP), x["text"], F.lit(END))
    made = made.select("conv_id", F.concat_ws("", F.transform("m", turn)).alias("formatted"), F.transform("m", lambda x: F.struct(F.length(x["role"]).alias("r"), F.length(x["text"]).alias("t"), x["loss"].alias("loss"))).alias("sizes"))
    fixed, head = len(START + SEP + END), len(START + SEP)

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["r"] + head
        add = F.when(x["loss"], F.array(F.struct(start.alias("start"), (start + x["t"]).alias("end")))).otherwise(F.array().cast("array<struct<start:long,end:long>>"))
        return F.struct((s["at"] + x["r"] + x["t"] + fixed).alias("at"), F.concat(s["spans"], add).alias("spans"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    return made.select("conv_id", "formatted", F.aggregate("sizes", first, step, lambda s: s["spans"]).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), as they were before rendering."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p, i: i > 0)
    role, rest = lambda p: F.substring_index(p, SEP, 1), lambda p: F.substring(p, F.length(F.substring_index(p, SEP, 1)) + len(SEP) + 1, F.length(p))
    text = lambda p: F.substring(rest(p), F.lit(1), F.length(rest(p)) - len(END))
    return F.transform(turns, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text")))


def learned(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    own = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.concat_ws("", F.transform(spans, own))


def conversation_events(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as events: each opens a message with its role and streams its text to it.

    Rows that share a conversation and a turn are messages of their own, by role and text.
    """
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    kinds = "conv_id long, turn long, role string, text string"
    own = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(kinds)))
    own = own.withColumn("msg", copy)
    both = F.explode(F.array(F.struct(F.lit(OPEN).alias("kind"), F.lit("").alias("text")), F.struct(F.lit(DELTA).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))))
    return own.select("conv_id", F.col("turn").alias("seq"), F.struct("turn", "msg").alias("msg"), "role", both.alias("e")).select("conv_id", "seq", "msg", "role", "e.kind", "e.text")


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    rows = table(spark, sf_dir, "conversations").select(*probe.columns).unionByName(probe)
    made = render(fold(conversation_events(rows)))
    turns, loss = parse(F.col("formatted")), learned(F.col("formatted"), F.col("loss_spans"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    back = made.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


#: DuckDB. formatted_chars counts the marks and one tilde for each control string of a text.
OP8_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START + SEP + END)} + length(regexp_replace(role, '([<\[]~*){_TAILS}', 'x\0', 'g')) + length(regexp_replace(text, '([<\[]~*){_TAILS}', 'x\0', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
