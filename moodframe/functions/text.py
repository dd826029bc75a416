"""Text scalar functions (Column -> Column), all native JVM expressions.

The cleaning rules are defined by Python ``re`` semantics on ``str``, where
``\\s``, ``\\w`` and ``\\d`` are Unicode-aware. Java regex (Spark) treats them
as ASCII, so every class is spelled out explicitly below; the same classes
are used by the DuckDB twins in ``moodframe.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the behaviour being reproduced).
# Whitespace as Python's str.isspace(): \t-\r, \x1c-\x1f, \x85 and the
# Unicode separators (Zs, Zl, Zp).
WS_CLASS = r"\t-\r\x1c-\x1f\x85\p{Z}"
# URL rule: "http" or "www" followed by non-whitespace.
URL_PATTERN = r"(?:http|www)[^" + WS_CLASS + r"]+"
# Mention (@ + word characters), the hash sign, digit runs.
MENTION_HASH_DIGIT_PATTERN = r"@[\p{L}\p{N}_]+|#|\p{Nd}+"
# Anything that is neither an ASCII letter nor whitespace.
NON_LETTER_PATTERN = r"[^a-zA-Z" + WS_CLASS + r"]"
WS_RUN_PATTERN = r"[" + WS_CLASS + r"]+"
# The whitespace runs that are not one space already.
WS_FOLD_PATTERN = r"[" + WS_CLASS + r"&&[^ ]][" + WS_CLASS + r"]*| [" + WS_CLASS + r"]+"
# Second recipe: after lower-casing keep a-z and whitespace only.
NON_LOWER_LETTER_PATTERN = r"[^a-z" + WS_CLASS + r"]"
# Chunk size in characters.
CHUNK_MAX_CHARS = 512
# Emotion -> emoji, and the default for anything else.
EMOJI_MAP = {
    "anger": "\U0001F621",
    "fear": "\U0001F628",
    "joy": "\U0001F60A",
    "love": "❤️",
    "sadness": "\U0001F622",
    "surprise": "\U0001F632",
    "neutral": "\U0001F610",
}
DEFAULT_EMOJI = "\U0001F937‍♂️"
# ---------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_urls(col: Column | str) -> Column:
    """B1: delete http.../www... runs (case-sensitive, not word-anchored)."""
    return F.regexp_replace(_c(col), URL_PATTERN, "")


def strip_mentions_hash_digits(col: Column | str) -> Column:
    """B2: delete whole @mentions, the '#' sign only, and digit runs."""
    return F.regexp_replace(_c(col), MENTION_HASH_DIGIT_PATTERN, "")


def strip_non_letters(col: Column | str) -> Column:
    """Keep ASCII letters and whitespace; nothing is replaced by a space."""
    return F.regexp_replace(_c(col), NON_LETTER_PATTERN, "")


def collapse_ws(col: Column | str) -> Column:
    """Whitespace runs -> one space, trimmed."""
    return F.trim(F.regexp_replace(_c(col), WS_FOLD_PATTERN, " "))


def clean_text(col: Column | str) -> Column:
    """B1 -> B2 -> B3 -> B4. Null in, null out.

    Only URLs and mentions take letters with them; a text without their marks
    goes to B3, which removes hash signs and digits, too."""
    raw = _c(col)
    marked = F.contains(raw, F.lit("http")) | F.contains(raw, F.lit("www")) | F.contains(raw, F.lit("@"))
    return collapse_ws(strip_non_letters(F.when(marked, strip_mentions_hash_digits(strip_urls(raw))).otherwise(raw)))


def normalize_lower(col: Column | str) -> Column:
    """Lower-case, then drop everything except a-z and whitespace."""
    return F.regexp_replace(F.lower(_c(col)), NON_LOWER_LETTER_PATTERN, "")


def tokenize_words(col: Column | str) -> Column:
    """Split on whitespace runs, empty pieces dropped (``str.split()``)."""
    return F.filter(F.split(_c(col), WS_RUN_PATTERN), lambda x: x != "")


def remove_stopwords(tokens: Column | str, stop_words: list[str]) -> Column:
    """Drop tokens in the stop list, keep order and duplicates.

    ``array_except`` would de-duplicate, so a filter is used; ``isin`` over the
    literals becomes one hash set.
    """
    stop = sorted(set(stop_words))
    return F.filter(_c(tokens), lambda x: ~x.isin(stop))


def rejoin_tokens(tokens: Column | str) -> Column:
    """Tokens joined by one space."""
    return F.array_join(_c(tokens), " ")


def chunk_pattern(max_chars: int = CHUNK_MAX_CHARS) -> str:
    """Greedy word packing as one regex: the longest run of at most
    ``max_chars`` characters that ends at a word end, else one over-long
    word on its own."""
    return r"(\S.{0," + str(max_chars - 1) + r"}|\S+)(?: |$)"


def chunk_text(cleaned: Column | str, max_chars: int = CHUNK_MAX_CHARS) -> Column:
    """ARRAY<STRING> of chunks of a cleaned text (single spaces only).

    Empty text gives an empty array; the reference's leading empty chunk
    for an over-long first word is not produced.
    """
    return F.regexp_extract_all(_c(cleaned), F.lit(chunk_pattern(max_chars)), 1)


def emoji_map_column() -> Column:
    items = []
    for k, v in EMOJI_MAP.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def emotion_to_emoji(emotion: Column | str) -> Column:
    """Case-insensitive lookup with the default emoji for anything else
    (null emotion included)."""
    return F.coalesce(F.try_element_at(emoji_map_column(), F.lower(_c(emotion))),
                      F.lit(DEFAULT_EMOJI))
