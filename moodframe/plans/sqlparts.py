"""DuckDB SQL building blocks for the oracle twins (RE2 regex syntax).

Every fragment mirrors one library function; the oracle strings in
``moodframe.plans.oracle`` are composed from them.
"""

from __future__ import annotations

from moodframe.functions.text import DEFAULT_EMOJI, EMOJI_MAP
from moodframe.operators.scoring import DEFAULT_PRIORS
from moodframe.sources.fixtures import LEMMAS, LEXICON, PHRASES, TYPES, spark_stop_words

# Same classes as moodframe.functions.text, in RE2 spelling.
WS = r"\t-\r\x{1c}-\x{1f}\x{85}\p{Z}"
URL = r"(?:http|www)[^" + WS + r"]+"
MHD = r"@[\p{L}\p{N}_]+|#|\p{Nd}+"
NONLET = r"[^a-zA-Z" + WS + r"]"
WSRUN = r"[" + WS + r"]+"
NONLOWER = r"[^a-z" + WS + r"]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    e = f"regexp_replace({x}, {q(URL)}, '', 'g')"
    e = f"regexp_replace({e}, {q(MHD)}, '', 'g')"
    e = f"regexp_replace({e}, {q(NONLET)}, '', 'g')"
    return f"trim(regexp_replace({e}, {q(WSRUN)}, ' ', 'g'))"


def normalize_lower(x: str) -> str:
    return f"regexp_replace(lower({x}), {q(NONLOWER)}, '', 'g')"


def tokens(x: str) -> str:
    """str.split(): whitespace runs, empty pieces dropped."""
    return f"list_filter(regexp_split_to_array({x}, {q(WSRUN)}), lambda t: t <> '')"


def chunks(x: str, max_chars: int = 512) -> str:
    pat = r"(\S.{0," + str(max_chars - 1) + r"}|\S+)(?: |$)"
    return f"regexp_extract_all({x}, {q(pat)}, 1)"


def emoji(x: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in EMOJI_MAP.items())
    return f"COALESCE(CASE lower({x}) {whens} END, {q(DEFAULT_EMOJI)})"


def values(rows, cols: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return q(v)
        return repr(float(v)) if isinstance(v, float) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({cols}))"


TYPES_LIST = "[" + ", ".join(q(t) for t in TYPES) + "]"

POSTS_V = (f"SELECT doc_id, {TYPES_LIST}[(CAST(substr(source, 4) AS INTEGER) % 16) + 1] AS type, "
           f"lang, text AS posts, n_chars FROM documents")
LEXICON_V = values([(w, l, 1.0) for w, l in LEXICON], "word, label, weight")
PHRASES_V = values(PHRASES, "phrase, label, weight")
LEMMA_V = values(LEMMAS, "form, lemma")
STOP_V = values([(w,) for w in spark_stop_words()], "word")
LABELS = sorted(DEFAULT_PRIORS)
PRIORS_V = values([(l, float(DEFAULT_PRIORS[l])) for l in LABELS], "label, prior")
TOTAL_PRIOR = float(sum(DEFAULT_PRIORS.values()))

# clean -> chunk -> score -> reduce, as CTEs (names: posts, cleaned, chunks,
# tok, pc, scored, means, assigned).
ENRICH_CTES = f"""
posts AS ({POSTS_V}),
cleaned AS (SELECT *, {clean('posts')} AS cleaned_posts FROM posts),
chunk_lists AS (SELECT doc_id, {chunks('cleaned_posts')} AS cl FROM cleaned),
chunks AS (SELECT doc_id, CAST(unnest(range(0, len(cl))) AS BIGINT) AS chunk_idx,
                  unnest(cl) AS chunk FROM chunk_lists),
tok AS (SELECT doc_id, chunk_idx, lower(unnest(string_split(chunk, ' '))) AS word FROM chunks),
hits AS (SELECT t.doc_id, t.chunk_idx, l.label, SUM(l.weight) AS h
         FROM tok t LEFT JOIN {LEXICON_V} l ON t.word = l.word GROUP BY 1, 2, 3),
htot AS (SELECT doc_id, chunk_idx, COALESCE(SUM(h), 0.0) AS h_total FROM hits GROUP BY 1, 2),
cand AS (SELECT c.doc_id, c.chunk_idx, p.label, COALESCE(h.h, 0.0) + p.prior AS v, c.h_total
         FROM htot c CROSS JOIN {PRIORS_V} p
         LEFT JOIN hits h ON h.doc_id = c.doc_id AND h.chunk_idx = c.chunk_idx AND h.label = p.label),
scored AS (SELECT doc_id, chunk_idx, label, v / (h_total + {TOTAL_PRIOR}) AS score FROM (
             SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY v DESC, label) AS rn
             FROM cand) WHERE rn = 1),
means AS (SELECT doc_id, label, SUM(score) / COUNT(*) AS mean_score, COUNT(*) AS n_chunks,
                 MIN(chunk_idx) AS first_idx FROM scored GROUP BY 1, 2),
assigned AS (SELECT doc_id, label AS emotion FROM (
               SELECT *, row_number() OVER (PARTITION BY doc_id
                        ORDER BY round(mean_score, 9) DESC, first_idx) AS rn FROM means) WHERE rn = 1),
enriched AS (SELECT c.*, a.emotion, {emoji('a.emotion')} AS emoji
             FROM cleaned c LEFT JOIN assigned a USING (doc_id))
"""


def score_ctes(p: str, src: str, keys: list[str], text: str) -> str:
    """The enrich plan for any keyed text table; CTE names start with ``p``;
    the last one, ``{p}enriched``, holds ``keys, cleaned, emotion, emoji``."""
    k = ", ".join(keys)
    return f"""
{p}cl AS (SELECT {k}, {clean(text)} AS cleaned FROM {src}),
{p}chl AS (SELECT {k}, {chunks('cleaned')} AS cl FROM {p}cl),
{p}ch AS (SELECT {k}, CAST(unnest(range(0, len(cl))) AS BIGINT) AS chunk_idx, unnest(cl) AS chunk FROM {p}chl),
{p}tok AS (SELECT {k}, chunk_idx, lower(unnest(string_split(chunk, ' '))) AS word FROM {p}ch),
{p}hits AS (SELECT {", ".join("t." + c for c in keys)}, t.chunk_idx, l.label, SUM(l.weight) AS h
            FROM {p}tok t LEFT JOIN {LEXICON_V} l ON t.word = l.word GROUP BY ALL),
{p}htot AS (SELECT {k}, chunk_idx, COALESCE(SUM(h), 0.0) AS h_total FROM {p}hits GROUP BY ALL),
{p}cand AS (SELECT c.*, pr.label, COALESCE(h.h, 0.0) + pr.prior AS v FROM {p}htot c CROSS JOIN {PRIORS_V} pr
            LEFT JOIN {p}hits h ON {" AND ".join(f"h.{c} = c.{c}" for c in keys)}
                 AND h.chunk_idx = c.chunk_idx AND h.label = pr.label),
{p}scored AS (SELECT {k}, chunk_idx, label, v / (h_total + {TOTAL_PRIOR}) AS score FROM (
              SELECT *, row_number() OVER (PARTITION BY {k}, chunk_idx ORDER BY v DESC, label) AS rn
              FROM {p}cand) WHERE rn = 1),
{p}means AS (SELECT {k}, label, SUM(score) / COUNT(*) AS mean_score, MIN(chunk_idx) AS first_idx
             FROM {p}scored GROUP BY ALL),
{p}assigned AS (SELECT {k}, label AS emotion FROM (
                SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY round(mean_score, 9) DESC, first_idx)
                AS rn FROM {p}means) WHERE rn = 1),
{p}enriched AS (SELECT c.*, a.emotion, {emoji('a.emotion')} AS emoji
                FROM {p}cl c LEFT JOIN {p}assigned a USING ({k}))"""
