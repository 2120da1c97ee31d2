"""Dialogues rendered from the view of every participant, in DataFrame functions only.

In the rendering for one speaker that speaker is the assistant, whose words are to be
learned; all others are users under their own names, and system messages stay
what they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.common import stage

SYSTEM = "system"
#: Turns in one row at most; a longer dialogue continues in further parts.
TURNS_PER_PART = 256


def _numbered(turns: DataFrame) -> DataFrame:
    """The turns with ``place``, their number in the dialogue from 0 by (turn, role, text), nulls first.

    Rows are sorted over all partitions, so a dialogue of any length is split; a partition
    counts its own rows, and the rows of earlier partitions are added.
    """
    order = ["conv_id", "turn", "role", "text"]
    sorted_ = turns.repartitionByRange(*order, F.xxhash64(F.monotonically_increasing_id())).withColumn("piece", F.spark_partition_id())
    sorted_ = stage(sorted_, "chat-sorted")
    counts = sorted_.groupBy("conv_id", "piece").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    own = Window.partitionBy("conv_id", "piece").orderBy("turn", "role", "text")
    ranked = sorted_.withColumn("own", F.row_number().over(own) - 1)
    joined = ranked.join(counts, ranked["conv_id"].eqNullSafe(counts["conv_id"]) & (ranked["piece"] == counts["piece"])).drop(counts["conv_id"], counts["piece"])
    return joined.withColumn("place", F.col("own") + F.col("offset")).drop("own", "offset", "piece")


def _plain(text: Column) -> Column:
    r"""The text without marks: ``<|`` becomes ``<\|``, and where backslashes stand between the two there is one more, so it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _name(role: Column) -> Column:
    r"""A name that can neither end its header nor begin another: marks as in texts, ``|>`` likewise, line ends as ``\n`` and ``\r``."""
    inner = F.regexp_replace(_plain(role), r"\|(\\*)>", r"|\\$1>")
    return F.replace(F.replace(inner, F.lit("\n"), F.lit(r"\n")), F.lit("\r"), F.lit(r"\r"))


def _line(role: Column, name: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), _name(name))).otherwise(""), F.lit("|>\n"))


def rotate_perspectives(conversations: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """(conv_id, speaker, part, n_turns, n_own, rendered, spans, messages) for every participant of every dialogue.

    Participants are the distinct roles but ``system``.  For a speaker, their turns
    are ``assistant`` turns with mask 1; other participants' are ``user`` turns with
    ``name`` and mask 0; system turns stay, without name, mask 0.  ``rendered`` holds a header line, the text and an end line
    for each turn, ``spans`` the begin and end of each masked text in it in characters, ``messages`` the turns as
    (role, name, content, mask).  In ``rendered``, marks inside of texts and names are escaped by a
    backslash, so no text can pose as another turn; ``messages`` hold texts and names as they are.  Dialogues of more than ``turns_per_part`` turns
    are cut into numbered parts of that size, which together hold every turn.

    Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have a fixed
    order and all stay.  A null role is a participant named ``unknown``; a null text is empty; turns with
    a null conv_id form one dialogue.  A dialogue of system turns only has no participants and no rows.
    Other columns are ignored, an empty table gives no rows.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = _numbered(turns).select(
        "conv_id", (F.col("place") / turns_per_part).cast("long").alias("part"), F.struct("place", "role", "text").alias("said")
    )
    parts = placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("said")).alias("said"))
    speakers = turns.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    views = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["conv_id"])).drop(speakers["conv_id"])

    def message(said: Column) -> Column:
        own, system = said["role"] == F.col("speaker"), said["role"] == SYSTEM
        return F.struct(
            F.when(system, SYSTEM).when(own, "assistant").otherwise("user").alias("role"),
            F.when(~system & ~own, said["role"]).alias("name"), said["text"].alias("content"), own.cast("int").alias("mask"),
        )

    views = views.withColumn("messages", F.transform("said", message))
    end = "\n<|end|>\n"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))

    def advance(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(_line(m["role"], m["name"]))
        stop = begin + F.length(_plain(m["content"]))
        span = F.array(F.struct(begin.cast("long").alias("begin"), stop.cast("long").alias("end")))
        return F.struct((stop + len(end)).cast("long").alias("at"), F.when(m["mask"] == 1, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    rendered = F.transform("messages", lambda m: F.concat(_line(m["role"], m["name"]), _plain(m["content"]), F.lit(end)))
    return views.select(
        "conv_id", "speaker", "part", F.size("messages").cast("long").alias("n_turns"),
        F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + m["mask"]).alias("n_own"),
        F.array_join(rendered, "").alias("rendered"), F.aggregate("messages", start, advance, lambda a: a["spans"]).alias("spans"), "messages",
    )
