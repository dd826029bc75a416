"""Conversation analytics (H1-H11) on ``(conv_id, turn, role, text)`` rows.

Per-conversation values are aggregates keyed by the conversation (map-side
combined where the aggregate allows it); the cut point is joined back to the
turns, so a very long conversation is split by AQE's skew-join handling
instead of being sorted in one window task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodframe.functions.text import clean_text, emotion_to_emoji
from moodframe.operators.scoring import assign_emotion, enrich_posts

# Words that end a conversation (matched as substrings of the
# lower-cased user turn), and the transcript prefixes.
EXIT_WORDS = ["bye", "end", "quit", "exit", "goodbye"]
USER_PREFIX = "You: "
BOT_PREFIX = "Bot: "


def conversation_turns(df: DataFrame, role_col: str = "role") -> DataFrame:
    """H1: user and bot turns (system turns do not exist in a chat log)."""
    return df.where(F.col(role_col).isNull() | (F.col(role_col) != "system"))


def exit_pattern(words: list[str] = EXIT_WORDS, word_boundary: bool = False) -> str:
    alt = "|".join(words)
    return rf"\b(?:{alt})\b" if word_boundary else alt


def is_exit(text_col: str = "text", role_col: str = "role", words: list[str] = EXIT_WORDS,
            word_boundary: bool = False) -> Column:
    """H2: a user turn containing an exit word (substring match by default,
    so ``weekend`` counts; ``word_boundary=True`` for whole words)."""
    hit = F.lower(F.col(text_col)).rlike(exit_pattern(words, word_boundary))
    return (F.col(role_col) == "user") & F.coalesce(hit, F.lit(False))


def conversation_cut(turns: DataFrame, key_col: str = "conv_id", turn_col: str = "turn",
                     text_col: str = "text", role_col: str = "role",
                     word_boundary: bool = False) -> DataFrame:
    """H3: turns strictly before the first exit turn; ``ended`` marks
    conversations that have one. The exit turn itself is not kept, nor are
    turns without a number of a conversation that has one. Turns without a
    key are one conversation. Only conversations with an exit turn are joined."""
    exits = turns.where(is_exit(text_col, role_col, word_boundary=word_boundary))
    cuts = exits.groupBy(F.col(key_col).alias("_key")).agg(F.min(turn_col).alias("_cut")).where(F.col("_cut").isNotNull())
    return (turns.join(cuts, F.col(key_col).eqNullSafe(F.col("_key")), "left")
            .where(F.col("_cut").isNull() | (F.col(turn_col) < F.col("_cut")))
            .withColumn("ended", F.col("_cut").isNotNull())
            .drop("_key", "_cut"))


def _ordered_join(values: Column, turn_col: str, sep: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("t"), values.alias("v"))))
    return F.array_join(F.transform(items, lambda x: x["v"]), sep)


def conversation_text(kept: DataFrame, key_col: str = "conv_id", turn_col: str = "turn",
                      text_col: str = "text", sep: str = " ") -> DataFrame:
    """H4 (``sep=' '``) / H5 (``sep='\\n'``): kept turns joined in turn order.
    The output row holds the whole transcript, so its size is the
    conversation's; the personality step (H11) works on tokens instead."""
    return kept.groupBy(key_col).agg(_ordered_join(F.col(text_col), turn_col, sep).alias("text"),
                                     F.count(F.lit(1)).cast("bigint").alias("n_turns"))


def last_turn_prompt(kept: DataFrame, key_col: str = "conv_id", turn_col: str = "turn",
                     text_col: str = "text", role_col: str = "role") -> DataFrame:
    """H6: the newest user turn only (a history window of one)."""
    return (kept.where(F.col(role_col) == "user").groupBy(key_col)
            .agg(F.max(turn_col).alias("turn"), F.max_by(text_col, turn_col).alias("prompt")))


def last_turns(kept: DataFrame, k: int, key_col: str = "conv_id", turn_col: str = "turn",
               text_col: str = "text", role_col: str = "role", sep: str = "\n") -> DataFrame:
    """H6 with a history of ``k``: the newest ``k`` user turns in turn order,
    joined by ``sep``, and their number. Of a turn number that repeats, texts
    later in order count as newer; a null text is left out of the prompt. Tasks
    cut each conversation to ``k`` rows before the shuffle, so a conversation of
    any length is ``k`` rows a task."""
    newest = Window.partitionBy(key_col).orderBy(F.desc(turn_col), F.desc(text_col))
    held = (kept.where((F.col(role_col) == "user") & F.col(turn_col).isNotNull())
            .select(key_col, turn_col, text_col).withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= k))
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("at"), F.col(text_col).alias("text"))))
    return held.groupBy(key_col).agg(F.count(F.lit(1)).cast("bigint").alias("n_turns"),
                                     F.array_join(F.transform(in_order, lambda t: t["text"]), sep).alias("prompt"))


def role_prefixed_transcript(kept: DataFrame, key_col: str = "conv_id", turn_col: str = "turn",
                             text_col: str = "text", role_col: str = "role") -> DataFrame:
    """H7: ``You: ...`` / ``Bot: ...`` lines joined by newlines."""
    line = F.concat(F.when(F.col(role_col) == "user", F.lit(USER_PREFIX))
                    .otherwise(F.lit(BOT_PREFIX)), F.coalesce(F.col(text_col), F.lit("")))
    return kept.groupBy(key_col).agg(_ordered_join(line, turn_col, "\n").alias("transcript"))


def segment_emotions(kept: DataFrame, scorer, key_col: str = "conv_id", turn_col: str = "turn",
                     text_col: str = "text") -> DataFrame:
    """H8: emotion and emoji of every kept turn, bot turns included (the
    same clean -> chunk -> score -> reduce plan as for posts)."""
    return enrich_posts(kept, scorer, [key_col, turn_col], text_col)


def emotion_frequency(segments: DataFrame, key_col: str = "conv_id",
                      turn_col: str = "turn") -> DataFrame:
    """H9: count per emotion per conversation, with the first turn showing it
    (turns without an emotion are not counted)."""
    return (segments.where(F.col("emotion").isNotNull()).groupBy(key_col, "emotion")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.min(turn_col).alias("first_turn")))


def dominant_emotion(freq: DataFrame, key_col: str = "conv_id") -> DataFrame:
    """Most frequent emotion, ties -> first seen, with its emoji."""
    dom = freq.groupBy(key_col).agg(
        F.min_by(F.col("emotion"), F.struct(-F.col("n"), F.col("first_turn"))).alias("dominant_emotion"))
    return dom.withColumn("emoji", emotion_to_emoji("dominant_emotion"))


def conversation_summary(kept: DataFrame, scorer, nb_model, key_col: str = "conv_id",
                         turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Personality of the conversation text (naive Bayes ``type`` head),
    dominant emotion and its emoji. Naive Bayes is additive over tokens, so
    the turns are scored as one document per conversation without building
    the joined string."""
    from moodframe.operators.models import argmax_rows, naive_bayes_scores

    seg = segment_emotions(kept, scorer, key_col, turn_col, text_col)
    dom = dominant_emotion(emotion_frequency(seg, key_col, turn_col), key_col)
    docs = kept.select(key_col, clean_text(text_col).alias("_clean"))
    scores = naive_bayes_scores(docs, key_col, "_clean", nb_model, heads=["type"])
    pers = argmax_rows(scores, [key_col], out_col="personality")
    dom = dom.withColumnRenamed(key_col, "_key")
    return pers.join(dom, F.col(key_col).eqNullSafe(F.col("_key")), "left").select(
        key_col, "personality", "dominant_emotion", "emoji")
