"""Chat formatting: multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant
and everybody else as a named user, with the spans that training may learn from. ``dialogues`` gives one row
for each conversation and perspective; a conversation of more turns than a row should hold goes on in further
parts, by the count of its turns, whatever their numbers. ``rotate_perspectives`` gives one row for each turn instead, of which ``assemble`` makes whole
dialogues where conversations are known to be short.

Marks inside texts and names are broken by a backslash, so that no text ends its turn or begins another's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import prefix

#: Template of a piece: <|role|>[ name=NAME] newline content <|end|> newline.
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
#: What a row without a role is called; it is never a perspective.
NOBODY = "unknown"
#: Turns in a part of a dialogue.
PART_TURNS = 256


def safe(content: Column) -> Column:
    """A text without marks of the template."""
    return F.replace(content, F.lit("<|"), F.lit("<\\|"))


def safe_name(name: Column) -> Column:
    """A name that stays on its line and inside its mark."""
    return F.replace(F.replace(safe(name), F.lit("|>"), F.lit("|\\>")), F.lit("\n"), F.lit(" "))


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv_id, turn, speaker, named, content)`` of the rows that take part."""
    return turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.nullif(F.col(role), F.lit("")), F.lit(NOBODY)).alias("speaker"),
        (F.coalesce(F.col(role), F.lit("")) != "").alias("named"), safe(F.coalesce(F.col(text), F.lit(""))).alias("content"),
    ).where(F.col("conv_id").isNotNull())


def _people(rows: DataFrame) -> DataFrame:
    return rows.where("named").select("conv_id", F.col("speaker").alias("perspective")).distinct()


def _head(target: Column, speaker: Column) -> Column:
    return F.when(target, F.lit(f"{OPEN}assistant{CLOSE}\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), safe_name(speaker), F.lit(f"{CLOSE}\n")))


def dialogues(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv_id, perspective, part, n_turns, n_target, dialogue, mask_spans)``.

    ``mask_spans`` lists the 0-based character bounds (``start-end``, joined by commas) in ``dialogue`` of what the
    model is trained to produce: content and end mark of the assistant's turns; empty for none. Turns are in order
    of turn number, speaker and content, and ``part`` counts ``part_turns`` of them, from 0. Rows without
    conversation id take no part; a null or empty role is a user named ``unknown`` and no perspective, so a
    conversation of only such rows gives nothing; null text is empty; a null turn number comes first; repeated rows
    stay repeated; further columns are ignored. Empty tables give an empty result.

    Turns are numbered by ranges and sums over ranges, so that no conversation fills a task. Parts are gathered before
    they meet the participants, so that texts are shuffled as they are and not once for each perspective; the
    participants' side is pre-aggregated, and AQE splits a hot conversation on the parts' side.
    """
    rows = prefix.running_count(_rows(turns, conv, turn, role, text), "conv_id", ["turn", "speaker"], "place", ties=["content", "named"])
    part = F.floor((F.col("place") - 1) / part_turns).cast("long")
    parts = rows.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "content", "named"))).alias("turns"))
    met = parts.join(_people(rows), "conv_id")

    def rendered(t: Column) -> Column:
        target = t["named"] & (t["speaker"] == F.col("perspective"))
        head = _head(target, t["speaker"])
        return F.struct(head.alias("head"), F.concat(t["content"], F.lit(END)).alias("body"), target.alias("target"))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(p["target"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    pieces = met.withColumn("pieces", F.transform("turns", rendered))
    return pieces.select(
        "conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["target"])).cast("long").alias("n_target"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("dialogue"), F.array_join(F.aggregate("pieces", none, add)["spans"], ",").alias("mask_spans"),
    )


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, perspective, turn, speaker, chat_role, rendered, mask_start, mask_end, is_target)``.

    ``mask_start`` and ``mask_end`` are 0-based character bounds in ``rendered`` of what the model is
    trained to produce (content and end mark of the assistant's pieces; 0, 0 for all others). Rows without
    conversation id take no part; a null or empty role is a user named ``unknown`` and no perspective, so a
    conversation of only such rows gives nothing; null text is empty; repeated rows stay repeated; further
    columns are ignored. Empty tables give an empty result.

    Turns meet the participants of their conversation in an equi-join on the conversation: the
    participants side is pre-aggregated, and AQE splits a hot conversation on the turns' side.
    """
    rows = _rows(turns, conv, turn, role, text)
    target = F.col("named") & (F.col("speaker") == F.col("perspective"))
    head = _head(target, F.col("speaker"))
    zero = F.lit(0).cast("long")
    long: Column = F.length("rendered").cast("long")
    return (
        rows.join(_people(rows), "conv_id")
        .withColumns({"is_target": target, "head": head})
        .withColumns({"rendered": F.concat("head", "content", F.lit(END))})
        .select(
            "conv_id", "perspective", "turn", "speaker", F.when(F.col("is_target"), "assistant").otherwise("user").alias("chat_role"), "rendered",
            F.when(F.col("is_target"), F.length("head").cast("long")).otherwise(zero).alias("mask_start"), F.when(F.col("is_target"), long).otherwise(zero).alias("mask_end"), "is_target",
        )
    )


def assemble(pieces: DataFrame) -> DataFrame:
    """``(conv_id, perspective, dialogue, mask_spans)`` for conversations short enough to be one value.

    Spans are character bounds in the dialogue, in order.
    """
    piece = F.struct("turn", "speaker", "rendered", "mask_start", "mask_end")
    add = lambda acc, p: F.struct(
        F.concat(acc["text"], p["rendered"]).alias("text"),
        F.when(p["mask_end"] > 0, F.concat(acc["spans"], F.array(F.struct((F.length(acc["text"]) + p["mask_start"]).alias("start"), (F.length(acc["text"]) + p["mask_end"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    empty = F.struct(F.lit("").alias("text"), F.lit([]).cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    whole = pieces.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return whole.select("conv_id", "perspective", F.aggregate("p", empty, add).alias("a")).select("conv_id", "perspective", F.col("a.text").alias("dialogue"), F.col("a.spans").alias("mask_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(role, '') <> '' AS named, replace(coalesce(text, ''), '<|', '<\|') AS content
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, content, named) - 1) // 256 AS part FROM r), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE named),
j AS (
  SELECT r.conv_id, perspective, part, turn, speaker, content, named, named AND speaker = perspective AS target,
    CASE WHEN named AND speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || replace(replace(replace(speaker, '<|', '<\|'), '|>', '|\>'), chr(10), ' ') || '|>' END || chr(10) AS head,
    content || '<|end|>' || chr(10) AS body
  FROM o AS r JOIN p ON r.conv_id = p.conv_id
), k AS (
  SELECT *, row_number() OVER w AS n, sum(length(head) + length(body)) OVER (w ROWS UNBOUNDED PRECEDING) AS ends FROM j
  WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, speaker, content, named)
)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (WHERE target) AS n_target, string_agg(head || body, '' ORDER BY n) AS dialogue,
  coalesce(string_agg(CAST(ends - length(body) AS VARCHAR) || '-' || CAST(ends AS VARCHAR), ',' ORDER BY n) FILTER (WHERE target), '') AS mask_spans
FROM k GROUP BY conv_id, perspective, part
"""
