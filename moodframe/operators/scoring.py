"""Emotion scoring: explode chunks -> score each chunk -> reduce per post.

A scorer has ``labels`` and ``score(chunks, key_cols, chunk_col)``, which gives
``(keys..., label, score)`` with one row per chunk. Three are here: a lexicon,
a trained naive Bayes head, and any function over Arrow batches of chunks.
Per-chunk and per-post results come from one conditional aggregate each
(map-side combined), and only the final join back moves the post text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodframe.functions.text import chunk_text, clean_text, emotion_to_emoji

# Label priors of the smoothed lexicon scorer (a chunk with no
# lexicon hit scores neutral at 1 / 4 = 0.25).
DEFAULT_PRIORS = {
    "anger": 0.5,
    "fear": 0.5,
    "joy": 0.5,
    "love": 0.5,
    "sadness": 0.5,
    "surprise": 0.5,
    "neutral": 1.0,
}
# Decimals used when comparing mean scores, so ties are stable across engines.
SCORE_TIE_DECIMALS = 9

def _keys(key_col: str | list[str]) -> list[str]:
    return [key_col] if isinstance(key_col, str) else list(key_col)


def explode_chunks(df: DataFrame, text_col: str = "cleaned_posts",
                   key_col: str | list[str] = "doc_id", max_chars: int = 512) -> DataFrame:
    """B12 as a table function: one row ``(key..., chunk_idx, chunk)`` per chunk."""
    return df.select(
        *_keys(key_col),
        F.posexplode(chunk_text(text_col, max_chars)).alias("chunk_idx", "chunk"),
    ).withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


@dataclass
class LexiconScorer:
    """C1 default scorer: smoothed share of lexicon hits per chunk.

    ``score(l) = (hits(l) + prior(l)) / (sum(hits) + sum(priors))`` over the
    scorer's label set (the keys of ``priors``); the chunk's top-1 label is
    the best score, rounded as in :data:`SCORE_TIE_DECIMALS`, ties by label
    name.

    Posts are enriched by joining the exploded tokens with the lexicon, of any
    size. ``in_row`` takes a ``word -> weights`` map inside the row instead, with
    equal results: it shuffles nothing, but its look-ups cost more the more words
    the lexicon has, so it is for small ones.
    """

    lexicon: DataFrame
    priors: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_PRIORS))
    lowercase: bool = True
    in_row: bool = False

    @property
    def labels(self) -> list[str]:
        return sorted(self.priors)

    def score(self, chunks: DataFrame, key_cols: list[str] | None = None,
              chunk_col: str = "chunk") -> DataFrame:
        key_cols = key_cols or ["doc_id", "chunk_idx"]
        labels = self.labels
        total_prior = float(sum(self.priors.values()))
        word = F.explode(F.split(F.col(chunk_col), " ")).alias("word")
        tokens = chunks.select(*key_cols, word)
        if self.lowercase:
            tokens = tokens.withColumn("word", F.lower("word"))
        lex = self.lexicon.where(F.col("label").isin(labels)).select("word", "label", "weight")
        sums = [F.sum(F.when(F.col("label") == l, F.col("weight"))).alias(f"h{i}")
                for i, l in enumerate(labels)]
        # Left join: tokens without a hit keep null sums, so every chunk gets
        # its aggregate row (a chunk always has at least one token).
        per_chunk = tokens.join(lex, "word", "left").groupBy(*key_cols).agg(*sums)
        return top1_from_sums(per_chunk, key_cols, labels,
                              [self.priors[l] for l in labels], total_prior)

    def weight_map(self) -> Column:
        """``MAP<word, ARRAY<DOUBLE>>`` (summed weight per label, in
        ``labels`` order) as a scalar subquery."""
        labels = self.labels
        lex = self.lexicon.where(F.col("label").isin(labels) & F.col("word").isNotNull())
        per_word = lex.groupBy("word").agg(F.array(*[
            F.coalesce(F.sum(F.when(F.col("label") == l, F.col("weight"))), F.lit(0.0))
            .cast("double") for l in labels]).alias("w"))
        return per_word.select(F.map_from_entries(F.collect_list(F.struct("word", "w")))).scalar()

    def words(self) -> list[str]:
        """The words of the lexicon, which is small where they are asked for."""
        lex = self.lexicon.where(F.col("label").isin(self.labels) & F.col("word").isNotNull())
        return sorted({r["word"] for r in lex.select("word").collect()})

    def with_emotion(self, df: DataFrame, cleaned_col: str, out_col: str = "emotion",
                     max_chars: int = 512) -> DataFrame | None:
        """C1 + C4 inside each row: chunk the cleaned text, score every chunk
        from the lexicon map, reduce to the post's emotion. Same result as
        ``assign_emotion(score(explode_chunks(...)))`` per row, but narrow:
        nothing is shuffled. None when ``in_row`` is off."""
        if not self.in_row:
            return None
        wmap, known = self.weight_map(), self.words()
        labels = self.labels
        priors = [float(self.priors[l]) for l in labels]
        total_prior = float(sum(priors))
        zeros = F.array(*[F.lit(0.0) for _ in labels])

        def hit_sums(chunk):
            # a set leaves the words of the lexicon; only they are looked up
            words = F.filter(F.split(F.lower(chunk) if self.lowercase else chunk, " "), lambda w: w.isin(known))
            weights = F.transform(words, lambda w: F.try_element_at(F.col("_lex"), w))
            hits = F.filter(weights, lambda x: x.isNotNull())
            return F.aggregate(hits, zeros, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))

        def top1(h):
            vals = [h.getItem(i) + F.lit(p) for i, p in enumerate(priors)]
            return F.struct(_largest(vals, labels).alias("best"), F.aggregate(h, F.lit(0.0), lambda a, x: a + x).alias("total"))

        def scored(t, idx):
            return F.struct(t["best"]["label"].alias("label"),
                            (-t["best"]["nv"] / (t["total"] + F.lit(total_prior))).alias("score"), idx.alias("idx"))

        label_arr = F.array(*[F.lit(l) for l in labels])
        zero = F.array(*[F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(-1).alias("f"))
                         for _ in labels])

        def add_chunk(acc, c):
            return F.transform(acc, lambda st, i: F.when(
                F.get(label_arr, i) == c["label"],
                F.struct((st["s"] + c["score"]).alias("s"), (st["n"] + 1).alias("n"),
                         F.when(st["f"] < 0, c["idx"]).otherwise(st["f"]).alias("f")))
                .otherwise(st))

        # Each intermediate (chunks -> per-chunk top-1 -> per-label sum, count,
        # first chunk -> best) is used exactly once, so the optimizer may
        # inline it anywhere (filter pushdown) without evaluating it twice.
        chunks = chunk_text(cleaned_col, max_chars)
        per_chunk = F.transform(F.transform(F.transform(chunks, hit_sums), top1), scored)
        stats = F.aggregate(per_chunk, zero, add_chunk)
        best = F.array_min(F.transform(stats, lambda st, i: F.when(st["n"] > 0, F.struct(
            (-F.round(st["s"] / st["n"], SCORE_TIE_DECIMALS)).alias("nm"), st["f"].alias("first"),
            F.get(label_arr, i).alias("label")))))
        return (df.withColumn("_lex", wmap).withColumn(out_col, best["label"]).drop("_lex"))


def _largest(vals: list[Column], labels: list[str]) -> Column:
    """``(nv, label)`` of the largest value, ties to the smallest name; values
    are rounded, so that the order of summing does not decide."""
    least = [F.struct((-F.round(v, SCORE_TIE_DECIMALS)).alias("nv"), F.lit(l).alias("label"))
             for v, l in zip(vals, labels)]
    return F.least(*least) if len(least) > 1 else least[0]


@dataclass
class NaiveBayesScorer:
    """C1 scorer from a trained naive Bayes head: a chunk's label is the
    head's class of the largest posterior, its score that probability."""

    model: object
    head: str

    @property
    def labels(self) -> list[str]:
        return [r["class"] for r in self.model.classes() if r["head"] == self.head]

    def score(self, chunks: DataFrame, key_cols: list[str] | None = None,
              chunk_col: str = "chunk") -> DataFrame:
        from moodframe.operators.models import class_probabilities, naive_bayes_scores

        key_cols = key_cols or ["doc_id", "chunk_idx"]
        keyed = chunks.select(F.struct(*key_cols).alias("_key"), chunk_col)
        scores = naive_bayes_scores(keyed, "_key", chunk_col, self.model, heads=[self.head])
        probs = class_probabilities(scores, "_key")
        order = F.struct(-F.round("score", SCORE_TIE_DECIMALS), F.col("class"))
        best = probs.groupBy("_key").agg(F.min_by(F.struct("class", "prob"), order).alias("b"))
        return best.select("_key.*", F.col("b.class").alias("label"), F.col("b.prob").alias("score"))


@dataclass
class BatchScorer:
    """C1 scorer from a function over batches: ``fn`` gets the chunks of an
    Arrow batch as a pandas Series and returns a frame with ``label`` and
    ``score``, one row per chunk in the same order."""

    fn: Callable
    labels: list[str]

    def score(self, chunks: DataFrame, key_cols: list[str] | None = None,
              chunk_col: str = "chunk") -> DataFrame:
        key_cols, fn = key_cols or ["doc_id", "chunk_idx"], self.fn

        def run(frames):
            for frame in frames:
                rated = fn(frame[chunk_col])
                yield frame[key_cols].assign(label=list(rated["label"]), score=list(rated["score"]))

        schema = StructType(chunks.select(*key_cols).schema.fields).add("label", "string").add("score", "double")
        return chunks.select(*key_cols, chunk_col).mapInPandas(run, schema)


def top1_from_sums(per_chunk: DataFrame, key_cols: list[str], labels: list[str],
                   priors: list[float], total_prior: float) -> DataFrame:
    """Top-1 (label, score) from per-label hit sums ``h0..h{K-1}``."""
    vals = [F.coalesce(F.col(f"h{i}"), F.lit(0.0)) + F.lit(float(p)) for i, p in enumerate(priors)]
    best = _largest(vals, labels)
    h_total = sum([F.coalesce(F.col(f"h{i}"), F.lit(0.0)) for i in range(len(labels))],
                  F.lit(0.0))
    return (per_chunk.select(*key_cols, best.alias("best"), h_total.alias("h_total"))
            .select(*key_cols, F.col("best.label").alias("label"),
                    (-F.col("best.nv") / (F.col("h_total") + F.lit(total_prior))).alias("score")))


def emotion_vote(scored: DataFrame, key_col: str | list[str] = "doc_id") -> DataFrame:
    """Most frequent top-1 label of a post, ties -> first seen chunk."""
    keys = _keys(key_col)
    counts = scored.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk_idx").alias("first_idx"))
    return counts.groupBy(*keys).agg(
        F.min_by(F.col("label"), F.struct(-F.col("n"), F.col("first_idx"))).alias("vote_emotion"))


def emotion_mean_scores(scored: DataFrame, key_col: str | list[str] = "doc_id") -> DataFrame:
    """Per post and label, mean top-1 score, chunk count, first chunk."""
    return scored.groupBy(*_keys(key_col), "label").agg(
        F.avg("score").alias("mean_score"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.min("chunk_idx").alias("first_idx"),
    )


def assign_emotion(scored: DataFrame, labels: list[str],
                   key_col: str | list[str] = "doc_id") -> DataFrame:
    """C4: label with the largest mean score, ties -> first seen chunk.

    One aggregate per post with a conditional sum/count/min per label (the
    label set is the scorer's), so the per-(post,label) step needs no shuffle
    of its own.
    """
    aggs = []
    for i, l in enumerate(labels):
        hit = F.col("label") == l
        aggs += [F.sum(F.when(hit, F.col("score"))).alias(f"s{i}"),
                 F.count(F.when(hit, F.lit(1))).alias(f"n{i}"),
                 F.min(F.when(hit, F.col("chunk_idx"))).alias(f"f{i}")]
    keys = _keys(key_col)
    per_post = scored.groupBy(*keys).agg(*aggs)
    cands = []
    for i, l in enumerate(labels):
        mean = F.col(f"s{i}") / F.col(f"n{i}")
        cands.append(F.when(F.col(f"n{i}") > 0, F.struct(
            (-F.round(mean, SCORE_TIE_DECIMALS)).alias("nm"), F.col(f"f{i}").alias("first"),
            F.lit(l).alias("label"))))
    best = F.least(*cands) if len(cands) > 1 else cands[0]
    return per_post.select(*keys, best["label"].alias("emotion"))


def enrich_posts(posts: DataFrame, scorer, key_col: str | list[str] = "doc_id",
                 text_col: str = "posts", max_chars: int = 512) -> DataFrame:
    """Clean -> chunk -> score -> reduce -> emoji, one plan.

    A scorer that works inside the row (``with_emotion``) makes a narrow plan:
    scan, project, no shuffle. Otherwise each distinct text is scored once,
    known by its digest, since the emotion follows from the text alone: rows
    with a null or repeated key are enriched each for itself, too, and the
    text crosses the network twice (distinct texts, join back). Posts with no
    chunk (empty after cleaning) keep their row with a null emotion and the
    default emoji. ``scorer`` is any object with ``labels`` and
    ``score(chunks_df, key_cols, chunk_col) -> (keys..., label, score)``.
    """
    keys = _keys(key_col)
    rest = [c for c in posts.columns if c not in keys]
    out = [*keys, *rest, "cleaned_posts", "emotion", emotion_to_emoji("emotion").alias("emoji")]
    in_row = getattr(scorer, "with_emotion", None)
    if in_row:
        cleaned = posts.withColumn("cleaned_posts", clean_text(text_col))
        done = in_row(cleaned, "cleaned_posts", "emotion", max_chars)
        if done is not None:
            return done.select(*out)
    numbered = posts.withColumn("_text", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    texts = numbered.select("_text", text_col).dropDuplicates(["_text"])
    chunks = explode_chunks(texts.select("_text", clean_text(text_col).alias("cleaned_posts")), "cleaned_posts", "_text",
                            max_chars)
    emotions = assign_emotion(scorer.score(chunks, ["_text", "chunk_idx"], "chunk"), scorer.labels, "_text")
    # only the raw posts cross the network for the join back; the cleaned
    # text is recomputed after it (same CPU, half the shuffled bytes)
    return numbered.join(emotions, "_text", "left").withColumn("cleaned_posts", clean_text(text_col)).select(*out)
