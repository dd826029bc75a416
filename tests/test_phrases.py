"""C1 with phrases: both paths, single words, overlaps, edge rows and size."""

from __future__ import annotations

import random
import time

import pyarrow as pa

from moodframe.functions import text as T
from moodframe.operators import phrases as PH
from moodframe.operators import scoring as S
from moodframe.sources import fixtures as fx
from conftest import SF_SMALL


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def by_hand(text, entries, priors):
    words, sums = text.lower().split(), dict.fromkeys(priors, 0.0)
    for phrase, label, weight in entries:
        p = (phrase or "").lower().split()
        if p and label in priors:
            sums[label] += (weight or 0.0) * sum(words[k:k + len(p)] == p for k in range(len(words) - len(p) + 1))
    best = min(priors, key=lambda l: (-(sums[l] + priors[l]), l))
    return best, round((sums[best] + priors[best]) / (sum(sums.values()) + sum(priors.values())), 9)


def test_single_words_score_as_the_lexicon(spark):
    docs = fx.text_table(spark, SF_SMALL, "documents").select("doc_id", T.clean_text("text").alias("cleaned_posts"))
    chunks = S.explode_chunks(docs)
    words = S.LexiconScorer(fx.lexicon(spark)).score(chunks)
    phrases = PH.PhraseScorer(fx.lexicon(spark).withColumnRenamed("word", "phrase")).score(chunks)
    assert rows(words) == rows(phrases)


def test_both_paths_equal_the_count_by_hand(spark):
    rng = random.Random(2)
    entries = [(" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))), rng.choice(["joy", "fear", "other"]), rng.choice([1.0, 0.5, 3.0]))
               for _ in range(60)] + [("A  b", "joy", 1.0), ("", "joy", 9.0), (None, "fear", 9.0), (" ", "fear", 9.0), ("a", "joy", None), ("é b", "fear", 2.0)]
    texts = [" ".join(rng.choice(["a", "b", "c", "ab", "B", "é"]) for _ in range(rng.randrange(0, 30))) for _ in range(80)]
    texts += ["", "a" * 10, "a a a a", "c\ta\n b", "a b " * 2_000]
    lexicon = spark.createDataFrame(entries, "phrase string, label string, weight double")
    chunks = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)] + [(None, 0, None)], "doc_id long, chunk_idx long, chunk string")
    priors = {"joy": 0.5, "fear": 0.75}
    want = {k: by_hand(t, entries, priors) for k, t in enumerate(texts)} | {None: by_hand("", entries, priors)}
    for bound in (PH.MAX_CHARS, 0):
        got = PH.PhraseScorer(lexicon, priors, max_chars=bound).score(chunks).collect()
        assert {r.doc_id: (r.label, round(r.score, 9)) for r in got} == want and len(got) == len(want)
    assert PH.PhraseScorer(lexicon, priors).score(chunks.limit(0)).collect() == []
    for bound in (PH.MAX_CHARS, -1):
        nothing = PH.PhraseScorer(lexicon.limit(0), priors, max_chars=bound).score(chunks).collect()
        assert {(r.label, r.score) for r in nothing} == {("fear", 0.6)} and len(nothing) == len(want)


def test_plan_moves_no_text(spark):
    docs = fx.text_table(spark, SF_SMALL, "documents").select("doc_id", T.clean_text("text").alias("cleaned_posts"))
    plan = PH.PhraseScorer(fx.phrase_lexicon(spark)).score(S.explode_chunks(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_enrich_with_phrases(spark):
    posts = spark.createDataFrame([(1, "Der die das"), (1, "of that"), (None, None), (3, "...")], "doc_id long, posts string")
    lexicon = spark.createDataFrame([("die das", "joy", 5.0), ("of that", "fear", 5.0)], "phrase string, label string, weight double")
    got = S.enrich_posts(posts, PH.PhraseScorer(lexicon))
    assert rows(got.select("doc_id", "posts", "emotion")) == rows(spark.createDataFrame(
        [(1, "Der die das", "joy"), (1, "of that", "fear"), (None, None, None), (3, "...", None)], "doc_id long, posts string, emotion string"))


def test_time_does_not_follow_the_entries():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = " ".join(word() for _ in range(100_000))
    took = {}
    for n in (1_000, 200_000):
        table = pa.table({"phrase": [f"{word()} {word()}" for _ in range(n)], "weights": [[1.0]] * n})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        machine, _ = PH._automaton(f"test {n}", sink.getvalue().to_pybytes())
        start = time.perf_counter()
        for _ in range(3):
            list(machine.iter(text))
        took[n] = time.perf_counter() - start
    assert took[200_000] < 20 * took[1_000]  # two hundred times the entries
