"""Shared steps of the model queries on growing tables: cleaning, naive Bayes
sums that shuffle no frequent token, candidates that are scored once."""

from __future__ import annotations

import re

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from moodframe.functions import text as T
from moodframe.operators import joint as J
from moodframe.operators import models as M
from moodframe.operators import scoring as S
from moodframe.plans import catalog as C

ODD = ["see https://x.y/z www.a.b ok", "a@#b c", "@12x y", "#@ab c", "12@ab3 d", "no marks #tag 42 don't", "t\t  u  v\n\nw", "  x", "\x85", "", None,
       "htt p ww w", "www", "http", "@", "café ß", "a b    c "]


def in_four_steps(text):
    if text is None:
        return None
    ws = r"\s"
    for pattern, by in ((r"(?:http|www)[^\s]+", ""), (r"@[^\W]+|#|\d+", ""), (r"[^a-zA-Z" + ws + "]", ""), (ws + "+", " ")):
        text = re.sub(pattern, by, text)
    return text.strip(" ")


def test_cleaning_without_marks_equals_all_steps(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id int, t string")
    got = {r.id: r.c for r in df.select("id", T.clean_text("t").alias("c")).collect()}
    assert got == {i: in_four_steps(t) for i, t in enumerate(ODD)}
    # a text without marks passes no URL or mention rule
    assert "Contains(t" in df.select(T.clean_text("t"))._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(k % 50 if k % 7 else None, f"the w{k % 9}  of Rare{'abcdefghijklmnopqrstuvwxyz'[k % 26]} the" if k % 13 else None, "AB"[k % 2], "xyz"[k % 3] if k % 5 else None)
            for k in range(200)]
    return spark.createDataFrame(rows + [(77, "unseen", None, None), (78, " ", "A", "x")], "id long, t string, type string, mood string")


@pytest.mark.parametrize("ngram", [1, 2])
@pytest.mark.parametrize("held", [1 << 22, 20, 0])
def test_scores_where_the_text_is_equal_joined_ones(spark, posts, monkeypatch, ngram, held):
    monkeypatch.setattr(M, "HELD_WEIGHTS", held)
    monkeypatch.setattr(M, "WORDS_AT_ONCE", 7)
    model = M.train_naive_bayes(posts.where("id < 40"), "id", "t", ["type", "mood"], ngram=ngram)

    def of(**how):
        return {(r.id, r.head, r["class"]): r.score for r in M.naive_bayes_scores(posts, "id", "t", model, **how).collect()}

    got = of()
    for want in (of(counts=M.document_tokens(posts, "id", "t", ngram)), of(dense=False)):
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_frequent_tokens_are_not_shuffled(spark, posts):
    """Where the vocabulary is held, the one exchange is that of the documents."""
    model = M.train_naive_bayes(posts, "id", "t", ["type"])
    plan = M.naive_bayes_scores(posts, "id", "t", model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan and "Generate explode" not in plan


def test_class_counts_with_null_labels_and_texts(spark):
    df = spark.createDataFrame([(1, "a b a", "A"), (2, None, "A"), (3, "", "B"), (4, "c", None)], "id long, t string, type string")
    counts = M.count_naive_bayes(df, "id", "t", ["type"])
    assert sorted(tuple(r) for r in counts.class_counts.collect()) == [("type", "A", 2, 3), ("type", "B", 1, 0)]
    assert counts.v_size == 3 and sorted((r.token, r.n, r.seen) for r in counts.by_token().collect()) == [("a", [2, 0], 2), ("b", [1, 0], 1), ("c", [0, 0], 0)]


def test_logistic_predictions_read_the_text_once(spark, posts):
    train = posts.where("t is not null")
    models = M.train_logistic_heads(train, "t", ["type", "mood"], num_features=64, max_iter=2)
    preds = M.predict_logistic_heads(train, "id", "t", models, num_features=64)
    assert "split(" not in preds._jdf.queryExecution().executedPlan().toString() and preds.count() == 2 * train.count()


def test_logistic_training_has_a_bounded_number_of_tasks(spark):
    """each task of an iteration sends a gradient of the model's size."""
    sc = spark.sparkContext
    most = M.TASKS_A_CORE * sc.defaultParallelism
    rows = spark.range(0, 400, 1, most + 20).select(F.concat_ws(" ", F.lit("a"), F.col("id") % 7).alias("t"), (F.col("id") % 2).cast("string").alias("type"))
    sc.setJobGroup("logistic tasks", "logistic tasks")
    try:
        M.train_logistic_heads(rows, "t", ["type"], num_features=16, max_iter=2)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    stages = [status.getStageInfo(k) for job in status.getJobIdsForGroup("logistic tasks") for k in status.getJobInfo(job).stageIds]
    sums = [s.numTasks for s in stages if s and s.name.startswith("treeAggregate")]
    assert sums and max(sums) <= most


def test_texts_meet_labels_where_they_are(spark):
    """only rows of repeated keys are moved, with the rows of a join."""
    from moodframe.plans import catalog as C
    own = [(k, f"t{k}", "a", "b", "c", "val" if k % 3 else "train") for k in range(40)]
    odd = [(7, "again", "x", None, "c", "val"), (7, "again", "x", None, "c", "val"), (None, "no key", "a", "b", "c", "val"), (41, None, None, "b", "c", "train")]
    ddl = "doc_id long, cleaned_posts string, type string, emotion string, emoji string, split string"
    alone = C._texts_by_key(spark.createDataFrame(own, ddl))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString() and alone.count() == 40
    rows = spark.createDataFrame(own + odd, ddl).repartition(3)
    want = rows.select("doc_id", "cleaned_posts").join(rows.drop("cleaned_posts"), "doc_id")
    got = C._texts_by_key(rows)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 49


@pytest.mark.parametrize("ngram", [1, 2])
@pytest.mark.parametrize("at_once", [1 << 24, 30])
def test_words_are_counted_where_the_text_is(spark, posts, monkeypatch, ngram, at_once):
    """Equal to counting each word as a row, which is no longer done."""
    monkeypatch.setattr(M, "COUNTED_BYTES", at_once)
    rows = posts.select("type", "mood", F.explode(F.concat(F.coalesce(M.feature_tokens("t", ngram), F.array().cast("array<string>")),
                                                           F.array(F.lit(None).cast("string")))).alias("token"))
    want = rows.groupBy("token", "type", "mood").count().collect()
    counts = M._word_counts(posts, "t", ["type", "mood"], ngram)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    base = M.count_naive_bayes(posts, "id", "t", ["type", "mood"], ngram).base
    assert {(r.token, r.type, r.mood): r.n for r in base.collect()} == {(r.token, r.type, r.mood): r["count"] for r in want}
    assert base.count() == len(want)


def test_counts_are_stored_in_columns(spark, posts):
    """a step that needs the tokens alone reads no labels and counts."""
    counts = M.count_naive_bayes(posts, "id", "t", ["type", "mood"])
    assert "ReadSchema: struct<token:string>" in counts.vocab._jdf.queryExecution().executedPlan().toString()


def test_only_words_of_the_lexicon_are_looked_up(spark):
    """In the row, the words are filtered by a set before the look-up."""
    lexicon = spark.createDataFrame([("and", "joy", 1.0), ("is", "anger", 0.3), ("is", "fear", 0.3), ("Der", "love", 9.0), (None, "joy", 1.0)],
                                    "word string, label string, weight double")
    posts = spark.createDataFrame([(1, "And is IS other"), (2, "isis and andand"), (3, "Der der"), (4, ""), (5, None), (6, "is x " * 300)], "doc_id bigint, posts string")
    a, b = (S.enrich_posts(posts, S.LexiconScorer(lexicon, in_row=w)) for w in (True, False))
    got = sorted((r.doc_id, r.emotion) for r in a.collect())
    assert got == sorted((r.doc_id, r.emotion) for r in b.collect())
    assert "filter(split(lower(" in a._jdf.queryExecution().optimizedPlan().toString()


def test_a_token_is_one_row_of_a_task(spark, posts):
    """F8: a token goes on once, with its counts for all labels, not once for each combination of them."""
    labels = {"type": ["B", "A", "never"], "mood": ["x", "y", "z"]}
    got = M._word_counts(posts.coalesce(1), "t", ["type", "mood"], 1, labels).collect()
    assert len({r.token for r in got}) == len(got) and all(len(r.n) == 6 for r in got)


def test_labels_that_are_given_are_not_looked_for(spark, posts, monkeypatch):
    """F8: equal counts; a label that never occurs is no class, one that is not given ends the job."""
    want = M.count_naive_bayes(posts, "id", "t", ["type", "mood"])
    monkeypatch.setattr(M, "_known_labels", None)
    got = M.count_naive_bayes(posts, "id", "t", ["type", "mood"], labels={"type": ["B", "A", "never"], "mood": ["z", "y", "x"]})
    for table in ("class_counts", "token_counts", "vocab", "base"):
        assert sorted(map(str, getattr(got, table).collect())) == sorted(map(str, getattr(want, table).collect()))
    assert sorted(map(str, got.by_token().collect())) == sorted(map(str, want.by_token().collect())) and got.v_size == want.v_size
    with pytest.raises(Exception, match="not among those given"):
        M.count_naive_bayes(posts, "id", "t", ["type", "mood"], labels={"type": ["B"], "mood": ["x", "y", "z"]})


def test_rows_held_out_are_cleaned_once(spark):
    """labels and text of the rows held out are read by two steps, and stored."""
    val, _, preds = C._val_preds(spark, SF_SMALL, truth=True)
    assert "regexp_" not in val._jdf.queryExecution().executedPlan().toString() and preds.count() == 3 * val.count()


def test_codes_need_no_second_pass_over_the_texts(spark, monkeypatch):
    """the labels of all rows are those of training and of the rows held out."""
    want = {h: sorted(tuple(r) for r in t.collect()) for h, t in C._codes(C._heads(spark, SF_SMALL)).items()}
    seen = {}
    monkeypatch.setattr(C, "_heads", None)
    monkeypatch.setattr(C.M, "look_up_codes", lambda preds, codes, *rest, f=M.look_up_codes: seen.update(codes) or f(preds, codes, *rest))
    C.code_lookup_default(spark, SF_SMALL)
    assert {h: sorted(tuple(r) for r in t.collect()) for h, t in seen.items()} == want


def test_joint_training_reads_a_text_once(spark):
    """labels that follow from the text are taken with the words, not in a pass of their own."""
    read = spark.sparkContext.accumulator(0)

    def label(text):
        read.add(1)
        return text[:1]

    rows = spark.range(40).select("id", F.concat(F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")), F.lit(" word")).alias("t"))
    train = rows.withColumn("y", F.udf(label)("t"))
    model = J.train_joint_heads(train, train.where("id < 0"), "id", "t", ["y"], J.JointSettings(buckets=64, rank=2, epochs=1, batches=1))
    assert model.labels == {"y": ["a", "b"]} and read.value == 40


def test_a_training_step_has_no_more_tasks_than_the_cores_need(spark, monkeypatch):
    """each task sends a gradient of the model's size."""
    monkeypatch.setattr(J, "TASKS_A_CORE", 1)
    seen = []
    monkeypatch.setattr(J, "summed_gradient", lambda rows, *rest, f=J.summed_gradient: seen.append(rows.rdd.getNumPartitions()) or f(rows, *rest))
    rows = spark.range(0, 400, 1, 40).select("id", F.lit("a b").alias("t"), F.lit("x").alias("y"))
    J.train_joint_heads(rows, rows.where("id < 9"), "id", "t", ["y"], J.JointSettings(buckets=64, rank=2, epochs=1, batches=1))
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism < 40


def test_gradient_of_repeated_words(monkeypatch):
    """a word that a text repeats is added once with its count; the slope of the loss says the same. Nothing runs over all words for each of the projection's columns."""
    model = J.new_model({"y": ["a", "b", "c"]}, J.JointSettings(buckets=8, rank=3))
    ids, offsets, codes = np.array([1, 1, 5, 1, 5, 5, 5, 2], np.int32), np.array([0, 4, 4, 8]), [np.array([0, -1, 2])]
    monkeypatch.setattr(J.np, "bincount", None)
    _, gradient = J.loss_and_gradient(model, ids, offsets, codes, [0.5])
    flat = model.flat()
    for k in range(len(flat)):
        up, down = (0.5 * J.loss_and_gradient(model.with_flat(flat + step * np.eye(len(flat))[k], 0), ids, offsets, codes, [0.5])[0][0] for step in (1e-6, -1e-6))
        assert gradient[k] == pytest.approx((up - down) / 2e-6, abs=1e-7)
    empty = J.loss_and_gradient(model, ids[:0], np.array([0, 0]), [np.array([1])], [1.0])[1]
    assert not empty[:model.projection.size].any()
