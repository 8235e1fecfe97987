"""Chat formatting by prefix-target expansion (built-in DataFrame functions only).

Every assistant turn is a training example of its own: the preceding turns are its
context and only that reply is trainable. A turn is written as

    <|im_start|>role
    text<|im_end|>

with ``\\``, ``<`` and ``[`` inside roles and texts escaped by ``\\``, so that no
text can contain a control string and unescaping gives the text back exactly.

The contexts of a conversation's examples are prefixes of one another, so the
output (``write``) keeps each formatted turn once: ``segments``, with the turn's place
in the formatted conversation, and ``examples``, a row for each assistant turn with
the end of its context and the span of its reply, the loss mask. Its size is
proportional to the input even for long conversations; ``expand`` writes out context
and reply of the examples that a reader wants.

A conversation is ordered as a whole (its digest needs all its turns), like a
document. Turns are ordered by turn, then role, then text; null roles and texts
are empty; a null conv_id is a conversation of its own; repeated rows are turns of
their own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, table

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, segment, begin, reply_begin, reply_end: each turn's formatted text and its place.

    Offsets count characters in the formatted conversation; those of the reply are null but for trained turns.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")).select("conv_id", F.posexplode("t").alias("pos", "t"))
    head = F.concat(F.lit(START), escape(F.col("t.role")), F.lit("\n"))
    parts = rows.select("conv_id", "pos", head.alias("head"), escape(F.col("t.text")).alias("body"), (F.col("t.role") == TRAINED).alias("trained"))
    parts = parts.withColumn("segment", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("begin", F.coalesce(F.sum(F.length("segment").cast("long")).over(before), F.lit(0)).cast("long"))
    reply = F.when(F.col("trained"), F.col("begin") + F.length("head"))
    return parts.select("conv_id", "pos", "segment", "begin", reply.alias("reply_begin"), (reply + F.length("body")).alias("reply_end"))


def examples(segs: DataFrame) -> DataFrame:
    """conv_id, pos, context_end, reply_begin, reply_end, chars of every example.

    An example is the formatted conversation up to ``chars``; its loss mask is [reply_begin, reply_end).
    """
    return segs.where(F.col("reply_begin").isNotNull()).select(
        "conv_id", "pos", F.col("begin").alias("context_end"), "reply_begin", "reply_end", (F.col("begin") + F.length("segment")).alias("chars")
    )


def expand(segs: DataFrame, wanted: DataFrame) -> DataFrame:
    """conv_id, pos, context, target, mask_begin, mask_end of the examples (conv_id, pos) in ``wanted``, written out in full."""
    whole = segs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "segment"))).alias("s")).withColumn("s", F.transform("s", lambda x: x["segment"]))
    few = wanted.select(F.col("conv_id").alias("c"), F.col("pos").alias("p"))
    found = examples(segs).join(few, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left_semi")
    found = found.join(whole.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    return found.select(
        "conv_id",
        "pos",
        F.array_join(F.slice("s", F.lit(1), F.col("pos")), "").alias("context"),
        F.get("s", F.col("pos")).alias("target"),
        (F.col("reply_begin") - F.col("context_end")).alias("mask_begin"),
        (F.col("reply_end") - F.col("context_end")).alias("mask_end"),
    )


def write(conversations: DataFrame, folder: str) -> None:
    """Writes segments and examples below folder."""
    segments(conversations).write.parquet(f"{folder}/segments")
    examples(conversations.sparkSession.read.parquet(f"{folder}/segments")).write.parquet(f"{folder}/examples")


def read_turns(segs: DataFrame) -> DataFrame:
    """Roles and texts parsed back from formatted segments, beside these."""
    head = F.length(F.substring_index("segment", "\n", 1)) + 1
    role = F.substring("segment", F.lit(len(START) + 1), head - len(START) - 1)
    text = F.substring("segment", head + 1, F.length("segment") - head - len(END))
    return segs.select("conv_id", "pos", "segment", "begin", unescape(role).alias("role"), unescape(text).alias("text"))


def digest(segs: DataFrame, exs: DataFrame) -> DataFrame:
    """One row per conversation: its turns from the segments, its loss text and lengths from the examples.

    An example whose context doesn't end where its turn begins ends the job with an error.
    """
    turns = read_turns(segs).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "segment", "begin", "role", "text"))).alias("t"))
    own = exs.groupBy(F.col("conv_id").alias("c")).agg(F.array_sort(F.collect_list(F.struct("pos", "context_end", "reply_begin", "reply_end", "chars"))).alias("e"))
    rows = turns.join(own, F.col("conv_id").eqNullSafe(F.col("c")), "left").withColumn("e", F.coalesce("e", F.array().cast(own.schema["e"].dataType)))

    def reply(x: Column) -> Column:
        turn = F.get("t", x["pos"])
        span = F.substring(turn["segment"], (x["reply_begin"] - x["context_end"] + 1).cast("int"), (x["reply_end"] - x["reply_begin"]).cast("int"))
        return F.when(turn["begin"] == x["context_end"], unescape(span)).otherwise(F.raise_error(F.lit("an example's context is wrong")).cast("string"))

    told = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = rows.withColumn("loss", F.array_join(F.transform("e", reply), ""))
    return rows.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{tricky}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{tricky}'")
    folder = f"{shared_dir(spark)}/chat"
    write(rows.unionByName(own), folder)
    return digest(spark.read.parquet(f"{folder}/segments"), spark.read.parquet(f"{folder}/examples"))
