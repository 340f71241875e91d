"""Chat formatting by perspective rotation: every participant in turn is the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.prefix import running_before
from touchline.session import stage

SYSTEM = "system"
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, perspective and turn: conversation, perspective, place, turn, speaker, shown_role, rendered, start, stop, trained_start, trained_stop.

    Every speaker but ``system`` is a participant and gives a perspective, in which its turns are the assistant's and all
    others are those of users named after their speaker; system turns stay what they are. The rendered turns of a
    perspective, joined by place, are its dialogue; start and stop are code points in it, stop exclusive. The trained
    span is the assistant's text with its end mark, and empty (both null) for all others. A dialogue is given turn by
    turn because one conversation may hold a third of all rows and must not come into one task. Places and offsets are
    found on rows without text; texts move once, to their offsets.

    Turns stand by number, then by hash of speaker and text; turns that repeat all of them stay separate. A null speaker is called
    ``unknown``, a null text is empty, null conversations are one, null turn numbers come first. A conversation without
    participants gives no rows. Extra columns are ignored, whatever their names. Empty tables give no rows.
    """
    name = F.coalesce(F.col(speaker).cast("string"), F.lit(UNKNOWN))
    said = F.coalesce(F.col(text), F.lit(""))
    read = turns.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), name.alias("speaker"), said.alias("said"))
    read = read.withColumns({"row": F.monotonically_increasing_id(), "tie": F.md5(F.concat("speaker", F.lit("\n"), "said")), "said_size": F.length("said")})
    read = stage(read, "turns")
    people = stage(read.where(F.col("speaker") != SYSTEM).select(F.col("conversation").alias("of"), F.col("speaker").alias("perspective")).distinct(), "participants")
    seen = read.join(people, F.col("conversation").eqNullSafe(F.col("of")))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    head = F.concat(F.lit(START), F.col("shown_role"), F.when(F.col("shown_role") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("\n"))
    seen = seen.withColumn("shown_role", role).withColumn("head", head)
    size = (F.length("head") + F.col("said_size") + len(END)).cast("long")
    seen = seen.select(
        F.struct("conversation", "perspective").alias("dialogue"), "turn", "tie", "row", "speaker", "shown_role", "head", size.alias("size"), F.lit(1).cast("long").alias("one")
    )
    placed = running_before(seen, "dialogue", ["turn", "tie", "row"], ["size", "one"])
    placed = placed.join(read.select("row", "said"), "row")
    rendered = F.concat("head", "said", F.lit(END))
    trained = F.col("shown_role") == "assistant"
    return placed.select(
        F.col("dialogue.conversation").alias(conversation),
        F.col("dialogue.perspective").alias("perspective"),
        F.col("before_one").alias("place"),
        F.col("turn").alias(turn),
        "speaker",
        "shown_role",
        rendered.alias("rendered"),
        F.col("before_size").alias("start"),
        (F.col("before_size") + F.col("size")).alias("stop"),
        F.when(trained, F.col("before_size") + F.length("head")).alias("trained_start"),
        F.when(trained, F.col("before_size") + F.col("size")).alias("trained_stop"),
    )
