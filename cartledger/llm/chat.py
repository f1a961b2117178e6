"""Chat formatting: multi-party perspective rotation.

Every participant of a conversation in turn becomes the assistant: the dialogue
is rendered once per participant, with that speaker's turns as ``assistant``, all
others as ``user`` with their names, and a mask that marks the assistant's words.
System turns are instructions, stay what they are, and are nobody's perspective.

A conversation of any length is cut into parts of at most ``turns_per_part``
turns, each a row of its own, so no group is unbounded.  The place of a turn comes
from a global order that is range-partitioned, not from a window over the
conversation.  All steps are built-in functions.

Rendered form of a message::

    <|im_start|>user name=NAME\\nTEXT<|im_end|>\\n

The mask holds character spans [begin, end) of the rendered text: the assistant's
words and the closing mark after them.

Defined results: equal rows count once; turns are ordered by turn number (null
last), then speaker, then text; a null text is empty; a turn without a speaker
is a user without a name and no perspective; a conversation without a
participant gives no row; a null conversation id is one conversation; control
marks inside a text are broken up by a blank, so no text can end a message;
white space in a name becomes an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartledger.operators.ranking import row_index
from cartledger.staging import StageArea

# The marks of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class ChatFormat:
    system_role: str = "system"
    turns_per_part: int = 512


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_last(), F.col("content").asc()]


def _parts(turns: DataFrame, chat: ChatFormat) -> DataFrame:
    """(conv, part, turns): the ordered turns of each part."""
    indexed = row_index(turns, _order(), StageArea.of(turns.sparkSession), "at")
    first = indexed.groupBy(F.col("conv").alias("of")).agg(F.min("at").alias("first"))
    placed = indexed.join(first, F.col("conv").eqNullSafe(F.col("of"))).withColumn("place", F.col("at") - F.col("first"))
    part = F.floor(F.col("place") / chat.turns_per_part).alias("part")
    # At most turns_per_part rows meet in a group.
    return placed.groupBy("conv", part).agg(
        F.sort_array(F.collect_list(F.struct("place", "speaker", "content"))).alias("turns")
    )


def _message(turn: Column, chat: ChatFormat) -> Column:
    system = F.coalesce(turn.speaker == chat.system_role, F.lit(False))
    trained = F.coalesce(turn.speaker == F.col("perspective"), F.lit(False))
    role = F.when(system, "system").when(trained, "assistant").otherwise("user")
    name = F.when(~system & ~trained, F.regexp_replace(turn.speaker, "\\s", "_"))
    return F.struct(role.alias("role"), name.alias("name"), turn.content.alias("content"), trained.alias("trained"))


def _head(message: Column) -> Column:
    return F.concat(F.lit(START), message.role, F.coalesce(F.concat(F.lit(" name="), message["name"]), F.lit("")), F.lit("\n"))


def _spans(messages: Column) -> Column:
    """Character spans of the trained words, closing mark included."""
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(so_far: Column, message: Column) -> Column:
        begin = so_far.at + F.char_length(_head(message))
        end = begin + F.char_length(message.content) + len(END)
        mine = F.array(F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end")))
        spans = F.when(message.trained, F.concat(so_far.spans, mine)).otherwise(so_far.spans)
        return F.struct((end + 1).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(messages, nothing, step, lambda done: done.spans)


def perspectives(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chat: ChatFormat = ChatFormat(),
) -> DataFrame:
    """(conv_id, part, perspective, messages, rendered, mask), one row per part and participant."""
    content = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |"))
    turns = conversations.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("speaker"), content.alias("content")
    ).distinct()
    speakers = turns.where(F.col("speaker") != chat.system_role)
    speakers = speakers.select(F.col("conv").alias("heard"), F.col("speaker").alias("perspective")).distinct()
    views = _parts(turns, chat).join(speakers, F.col("conv").eqNullSafe(F.col("heard")))
    views = views.withColumn("messages", F.transform("turns", lambda t: _message(t, chat)))
    rendered = F.array_join(
        F.transform("messages", lambda m: F.concat(_head(m), m.content, F.lit(END + "\n"))), ""
    )
    return views.select(
        F.col("conv").alias(conv_id),
        "part",
        "perspective",
        "messages",
        rendered.alias("rendered"),
        _spans(F.col("messages")).alias("mask"),
    )
