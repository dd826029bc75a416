"""Rules for rows that the fixture tables do not have: CSV cells, unknown
classes, null and repeated keys, uncapped vocabularies, replayed batches,
saved models, and the scorers besides the lexicon."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from moodframe.functions.text import clean_text
from moodframe.operators import conversation as H
from moodframe.operators import models as M
from moodframe.operators import prep as E
from moodframe.operators import scoring as S
from moodframe.plans import catalog as C
from moodframe.session import cut_lineage, scratch_dir
from moodframe.sources import fixtures as fx
from moodframe.sources import io as IO
from moodframe.streaming import conversations as ST


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_csv_round_trip_keeps_every_cell(spark, tmp_path):
    cells = ["  lead and trail  ", "", None, "a\r\nb\nc\rd", 'say ""hi"", "x', ",", '"', "\\", '\\"', " ", "\t", "# no comment", "é 日本"]
    rows = [(k, c, c, "x", None) for k, c in enumerate(cells)]
    df = spark.createDataFrame(rows, IO.POSTS_SCHEMA)
    IO.write_csv(df.coalesce(1), str(tmp_path / "csv"), rows_per_file=4)
    back = IO.read_posts_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == rows
    assert len(back.inputFiles()) == 4


@pytest.mark.parametrize("weight", [1.0, 0.3])
def test_both_lexicon_paths_agree_on_null_and_repeated_keys(spark, weight):
    rows = [(7, "and and"), (7, "is is is is"), (None, "la"), (None, None), (8, "#1"), (9, "and is la der " * 90)]
    lexicon = fx.lexicon(spark).withColumn("weight", F.lit(weight))
    posts = spark.createDataFrame(rows, "doc_id bigint, posts string")
    a = S.enrich_posts(posts, S.LexiconScorer(lexicon, in_row=True))
    b = S.enrich_posts(posts, S.LexiconScorer(lexicon))
    assert same(a, b) and a.count() == len(rows)
    emotions = {(r.doc_id, r.posts): r.emotion for r in b.collect()}
    assert emotions[7, "and and"] == "joy" and emotions[7, "is is is is"] == "anger"
    assert emotions[None, "la"] == ("joy" if weight == 1.0 else "neutral") and emotions[None, None] is None


def test_naive_bayes_and_batch_scorers(spark):
    train = spark.createDataFrame([(1, "sun sun warm", "joy"), (2, "rain cold", "sadness"), (3, "warm sun", "joy")],
                                  "doc_id bigint, text string, emotion string")
    model = M.train_naive_bayes(train, "doc_id", "text", ["emotion"])
    scorer = S.NaiveBayesScorer(model, "emotion")
    assert scorer.labels == ["joy", "sadness"]
    chunks = spark.createDataFrame([(1, 0, "sun"), (1, 1, "cold rain"), (2, 0, "unknown")], "doc_id bigint, chunk_idx bigint, chunk string")
    got = {(r.doc_id, r.chunk_idx): (r.label, r.score) for r in scorer.score(chunks).collect()}
    # priors 2/3 and 1/3; 5 and 2 tokens, 4 types
    joy, sad = 2 / 3 * 4 / 9, 1 / 3 * 1 / 6
    assert got[1, 0] == ("joy", pytest.approx(joy / (joy + sad)))
    assert got[1, 1][0] == "sadness" and got[2, 0] == ("joy", pytest.approx(2 / 3))
    posts = spark.createDataFrame([(1, "sun sun"), (None, "cold rain"), (3, None)], "doc_id bigint, posts string")
    assert {r.posts: r.emotion for r in S.enrich_posts(posts, scorer).collect()} == {"sun sun": "joy", "cold rain": "sadness", None: None}

    def by_length(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"label": ["long" if len(t) > 7 else "short" for t in texts], "score": 1.0})

    batch = S.BatchScorer(by_length, ["long", "short"])
    assert {r.posts: r.emotion for r in S.enrich_posts(posts, batch).collect()} == {"sun sun": "short", "cold rain": "long", None: None}


def test_lemma_paths_agree(spark):
    rows = [(1, ["des", "x", "des"]), (2, []), (3, None), (1, ["x"]), (1, ["x"]), (None, ["was"]), (2, None), (4, [None, "es"]), (5, ["a,b"]), (5, ["a", "b"])]
    tokens = spark.createDataFrame(rows, "doc_id bigint, t array<string>")
    a = E.lemmatize(tokens, fx.lemma(spark), "doc_id", "t", in_row=True)
    b = E.lemmatize(tokens, fx.lemma(spark), "doc_id", "t")
    want = [(1, ["de", "x", "de"]), (1, ["x"]), (1, ["x"]), (2, []), (2, []), (3, []), (4, [None, "e"]), (5, ["a", "b"]), (5, ["a,b"]), (None, ["be"])]
    assert [sorted(((r.doc_id, list(r.lemmas)) for r in t.collect()), key=str) for t in (a, b)] == [sorted(want, key=str)] * 2


def test_large_dictionaries_are_joined_by_default(spark):
    """No array of the dictionary: a million forms and words."""
    many = spark.range(1_000_000).select(F.concat(F.lit("w"), "id").alias("form"), F.concat(F.lit("l"), "id").alias("lemma"))
    tokens = spark.createDataFrame([(1, ["w7", "x", "w999999"])], "doc_id bigint, t array<string>")
    got = E.lemmatize(tokens, many, "doc_id", "t")
    assert got.first().lemmas == ["l7", "x", "l999999"]
    words = many.select(F.col("form").alias("word"), F.lit("joy").alias("label"), F.lit(5.0).alias("weight"))
    # letters only remain of a cleaned post
    words = words.unionAll(spark.createDataFrame([("sun", "fear", 9.0)], words.schema))
    posts = spark.createDataFrame([(1, "the sun"), (2, "the rain")], "doc_id bigint, posts string")
    rated = S.enrich_posts(posts, S.LexiconScorer(words))
    assert {r.doc_id: r.emotion for r in rated.collect()} == {1: "fear", 2: "neutral"}
    assert "map_from_entries" not in rated._jdf.queryExecution().optimizedPlan().toString()


def test_vocabulary_has_every_token_unless_told_otherwise(spark):
    df = spark.createDataFrame([("b a a c",), ("a b zz é",)], "t string")
    rows = {r.token: (r.token_id, r.n) for r in E.build_vocabulary(df, "t").collect()}
    assert rows == {"[PAD]": (0, 0), "[UNK]": (1, 0), "[CLS]": (2, 0), "[SEP]": (3, 0), "a": (4, 3), "b": (5, 2), "c": (6, 1),
                    "zz": (7, 1), "é": (8, 1)}
    cut = {r.token: r.token_id for r in E.build_vocabulary(df, "t", min_count=2, size=6).collect()}
    assert cut == {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "a": 4, "b": 5}


def test_dense_and_sparse_scores_agree(spark):
    sp, model = C._nb(spark, SF_SMALL)
    val = sp.where(F.col("split") == "val")
    a = M.naive_bayes_scores(val, "doc_id", "cleaned_posts", model, heads=["type", "emoji"])
    b = M.naive_bayes_scores(val, "doc_id", "cleaned_posts", model, heads=["type", "emoji"], dense=False)
    key = lambda r: (r.doc_id, r.head, r["class"])
    left, right = {key(r): r.score for r in a.collect()}, {key(r): r.score for r in b.collect()}
    assert left.keys() == right.keys() and all(abs(left[k] - right[k]) < 1e-6 for k in left)
    counted = M.document_tokens(val, "doc_id", "cleaned_posts")
    assert {key(r): r.score for r in M.naive_bayes_scores(val, "doc_id", "cleaned_posts", model, heads=["type", "emoji"], counts=counted)
            .collect()}.keys() == left.keys()


def test_joint_loss_counts_unknown_classes(spark):
    train = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id bigint, t string, h string")
    model = M.train_naive_bayes(train, "doc_id", "t", ["h"])
    val = spark.createDataFrame([(3, "a", "x"), (4, "a", "new")], "doc_id bigint, t string, h string")
    scores = M.naive_bayes_scores(val, "doc_id", "t", model)
    p = {r["class"]: r.prob for r in M.class_probabilities(scores, "doc_id").where("doc_id = 3").collect()}
    loss = {r["head"]: r.loss for r in M.joint_loss(scores, val, "doc_id", ["h"]).collect()}
    assert loss["h"] == pytest.approx((-math.log(p["x"]) - math.log(M.LOSS_FLOOR)) / 2) and loss["sum"] == loss["h"]


def test_saved_models_predict_the_same(spark):
    sp = C._split_lab(spark, SF_SMALL)
    sp = cut_lineage(sp)
    train, val = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val")
    codes = C._codes(sp)
    model = M.train_naive_bayes(train, "doc_id", "cleaned_posts", C.HEAD_COLS)
    path = scratch_dir(spark, "model-test")
    model.save(path, codes)
    loaded = M.NaiveBayesModel.load(spark, path)
    for a, b in ((model.class_params, loaded.class_params), (model.token_params, loaded.token_params), (model.vocab, loaded.vocab)):
        assert same(a, b.select(*a.columns))
    assert {c: sorted(map(tuple, t.collect())) for c, t in M.load_codes(spark, path).items()} == {
        c: sorted(map(tuple, t.collect())) for c, t in codes.items()}
    heads = M.train_logistic_heads(train, "cleaned_posts", ["type"], num_features=256, max_iter=3)
    M.save_logistic_heads(heads, path)
    again = M.load_logistic_heads(path, ["type"])
    a = M.predict_logistic_heads(val, "doc_id", "cleaned_posts", heads, num_features=256)
    assert same(a, M.predict_logistic_heads(val, "doc_id", "cleaned_posts", again, num_features=256)) and a.count() == val.count()


CONV = "conv_id bigint, turn bigint, role string, text string"
TURNS = [(1, 0, "user", "and la"), (1, 1, None, "der"), (1, 2, "user", "bye now"), (1, 3, "assistant", "la"), (1, None, "user", "is"),
         (2, 0, "system", "x"), (2, 1, "user", "la la"), (2, 2, "assistant", None), (3, 0, "user", "goodbye"),
         (None, 0, "user", "der der"), (None, 1, "assistant", "la")]


def test_conversation_cut_keeps_turns_without_a_key(spark):
    kept = H.conversation_cut(H.conversation_turns(spark.createDataFrame(TURNS, CONV)))
    assert sorted(((r.conv_id, r.turn, r.ended) for r in kept.collect()), key=str) == sorted(
        [(1, 0, True), (1, 1, True), (2, 1, False), (2, 2, False), (None, 0, False), (None, 1, False)], key=str)


def test_stream_equals_batch_and_bears_replay(spark):
    scorer = S.LexiconScorer(fx.lexicon(spark))
    train = spark.createDataFrame([(1, "and la", "INTJ"), (2, "der is", "ENFP")], "doc_id bigint, t string, type string")
    model = M.train_naive_bayes(train, "doc_id", "t", ["type"])
    turns = spark.createDataFrame(TURNS, CONV)
    src, work = scratch_dir(spark, "stream-test"), scratch_dir(spark, "stream-test")
    for k in (2, 0, 1):
        turns.where(F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(src)
    got = ST.run_conversation_stream(spark, src, CONV, scorer, model, work_dir=work)
    want = H.conversation_summary(H.conversation_cut(H.conversation_turns(turns)), scorer, model)
    cols = ["conv_id", "personality", "dominant_emotion", "emoji"]
    assert same(got.where("n_kept > 0").select(*cols), want.select(*cols))
    assert {(r.conv_id, r.n_kept, r.ended) for r in got.collect()} == {(1, 2, True), (2, 2, False), (3, 0, True), (None, 2, False)}
    # a batch that is written again replaces its folder
    before = sorted(map(str, got.collect()))
    last = spark.read.parquet(f"{work}/updates").agg(F.max("batch_id")).first()[0]
    rows = cut_lineage(spark.read.parquet(f"{work}/updates/batch_id={last}"))
    ST.write_batch(rows, last, f"{work}/updates")
    updates = spark.read.schema(ST.OUTPUT + ", batch_id bigint").parquet(f"{work}/updates")
    published = spark.read.schema(ST.PUBLISHED).parquet(f"{work}/turns")
    assert sorted(map(str, ST.with_text(ST.summaries(ST.latest_totals(updates), model), published).collect())) == before
    # a batch of turns that is published again stays as it is
    files = sorted(spark.read.parquet(f"{work}/turns").inputFiles())
    ST.publish_batch(published.drop("batch_id"), 0, work)
    assert sorted(spark.read.parquet(f"{work}/turns").inputFiles()) == files


def test_enrich_takes_no_exchange_over_a_scan(spark):
    posts = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", F.col("text").alias("posts"))
    plan = S.enrich_posts(posts, S.LexiconScorer(fx.lexicon(spark), in_row=True))._jdf.queryExecution().executedPlan()
    main = plan.toString().split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main
    lemmas = E.readme_clean(posts, fx.lemma(spark), fx.spark_stop_words(), "doc_id", "posts", in_row=True)
    assert "Exchange" not in lemmas._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    stops = posts.select(clean_text("posts"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in stops
