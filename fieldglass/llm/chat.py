"""Chat formatting: every participant's view of a dialogue, with masks.

Each dialogue is rendered once per participant: that speaker is the assistant,
everybody else a named user, and masks mark what the assistant says.  A
dialogue is cut into segments of consecutive turns, so that one of any length is
spread over tasks; an ordinary one is a single segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Turn numbers in one segment, and messages in it beyond which it is cut further, by turn and by hash.
SEGMENT_TURNS = 64
CROWDED = 512
SYSTEM = "system"
NOBODY = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def messages(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Different messages with their segment: conv_id, turn, speaker, text, copies, segment, sub, part."""
    plain = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.when(F.trim(F.coalesce(F.col(role), F.lit(""))) == "", NOBODY).otherwise(F.trim(F.col(role))).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    plain = plain.groupBy("conv_id", "turn", "speaker", "text").agg(F.count("*").alias("copies"))
    plain = plain.withColumn("segment", F.floor(F.col("turn") / SEGMENT_TURNS))
    crowds = plain.groupBy("conv_id", "segment").count().where(F.col("count") > CROWDED)
    heaps = plain.groupBy("conv_id", "turn").agg(F.count("*").alias("heap"))
    crowds = crowds.select("conv_id", "segment", F.lit(True).alias("crowded"))
    crowded = _null_safe(plain, crowds, ["conv_id", "segment"])
    crowded = _null_safe(crowded, heaps, ["conv_id", "turn"])
    digest = F.conv(F.substring(F.md5(F.concat_ws("\x1f", "speaker", "text")), 1, 8), 16, 10).cast("bigint")
    # The part of a crowded turn grows with the digest, so that parts follow each other in the order of messages.
    parts = F.ceil(F.col("heap") / CROWDED)
    return crowded.select(
        "conv_id", "turn", "speaker", "text", "copies", "segment", digest.alias("digest"),
        F.when(F.col("crowded"), F.col("turn")).alias("sub"),
        F.when(F.col("crowded"), F.floor(digest * parts / F.lit(1 << 32))).otherwise(F.lit(0)).cast("bigint").alias("part"),
    )


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which null keys meet null keys."""
    other = right.select(*(F.col(c).alias(f"_{c}") for c in on), *(c for c in right.columns if c not in on))
    condition = None
    for c in on:
        equal = F.col(c).eqNullSafe(F.col(f"_{c}"))
        condition = equal if condition is None else condition & equal
    return left.join(other, condition, "left").drop(*(f"_{c}" for c in on))


def head_of(speaker: Column, view: Column) -> Column:
    """The opening of a message as the viewing participant sees its speaker."""
    return F.when(speaker == SYSTEM, F.lit(f"{OPEN}system\n")).when(speaker == view, F.lit(f"{OPEN}assistant\n")).otherwise(
        F.concat(F.lit(f"{OPEN}user name="), F.regexp_replace(speaker, r"[\x00-\x20<>|]+", "_"), F.lit("\n"))
    )


def rotate(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Every participant's rendering of every dialogue, one row per participant and segment.

    Columns: conv_id, view (the participant), segment, sub, part, n_messages,
    n_copies, rendered (text), masks (array of start and end of what the
    assistant says, in code points of ``rendered``, end marks included).
    Concatenated in the order of segment, sub and part they give the whole
    dialogue; sub and part are set only in segments of more than 512 messages.

    Participants are all speakers but the system, whose messages every view
    holds as they are; a dialogue of system messages alone has no view.  Null or
    blank roles are one speaker, 'unknown'; null texts are empty messages.
    Messages of one turn come in the order of a digest of speaker and text;
    repeated rows are one message and are counted in n_copies.  Messages without
    a turn form the first segment, those without a conversation one dialogue.
    Other columns are left out; an empty table gives an empty one.

    A segment is gathered, a dialogue never is; the rows of a long one are as
    many as segments times participants, which is what the rotation asks for.
    """
    rows = messages(turns, conv, turn, role, text)
    item = F.struct("turn", "digest", "speaker", "text", "copies")
    segments = rows.groupBy("conv_id", "segment", "sub", "part").agg(F.sort_array(F.collect_list(item)).alias("items"))
    views = rows.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("view")).distinct()
    both = _null_safe(segments, views, ["conv_id"]).where("view is not null")
    piece = F.transform(
        "items",
        lambda m: F.struct(
            head_of(m["speaker"], F.col("view")).alias("head"), m["text"].alias("text"),
            (m["speaker"] == F.col("view")).alias("own"),
        ),
    )
    both = both.withColumn("pieces", piece)
    masks = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), masks.alias("masks"))
    after = len(CLOSE)
    spans = F.aggregate(
        "pieces", start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["text"]) + after).alias("at"),
            F.when(p["own"], F.concat(acc["masks"], F.array(F.struct(
                (acc["at"] + F.length(p["head"])).alias("start"),
                (acc["at"] + F.length(p["head"]) + F.length(p["text"]) + after).alias("end"),
            )))).otherwise(acc["masks"]).alias("masks"),
        ),
        lambda acc: acc["masks"],
    )
    return both.select(
        "conv_id", "view", "segment", "sub", "part", F.size("items").cast("long").alias("n_messages"),
        F.aggregate("items", F.lit(0).cast("long"), lambda n, m: n + m["copies"]).alias("n_copies"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "").alias("rendered"),
        spans.alias("masks"),
    )
