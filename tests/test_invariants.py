"""Invariants of balancing, splitting, encoding, evaluation and conversations
(SURVEY §5.3), plus partition-count independence."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

import moodframe.plans.catalog as C
from conftest import SF_CHECK, SF_SMALL
from moodframe.operators import balance as D
from moodframe.operators import evaluate as G
from moodframe.operators import prep as E
from moodframe.operators import scoring as S
from moodframe.sources import fixtures as fx
from moodframe.session import table


@pytest.fixture(scope="module")
def enr(spark):
    return C._enr(spark, SF_SMALL)


def test_lexicon_labels_all_occur(spark):
    e = C.enriched(spark, SF_CHECK)
    counts = {r["emotion"]: r["n"] for r in e.groupBy("emotion").agg(F.count("*").alias("n"))
              .collect()}
    assert set(counts) == set(S.DEFAULT_PRIORS)
    assert all(n >= 10 for n in counts.values())
    assert sum(counts.values()) == 1000


def test_oversample_sizes_and_membership(spark, enr):
    out = D.oversample(enr, "type", ["doc_id"])
    sizes = {r["type"]: r["n"] for r in D.class_counts(out, "type").collect()}
    biggest = max(r["n"] for r in D.class_counts(enr, "type").collect())
    assert set(sizes.values()) == {biggest}
    assert out.join(enr.select("doc_id", "type"), ["doc_id", "type"], "left_anti").count() == 0


def test_two_pass_shape(spark, enr):
    out = D.balance_two_pass(enr, "emotion", "type", ["doc_id"])
    per_type = {r["type"]: r["n"] for r in D.class_counts(out, "type").collect()}
    max_type = max(r["n"] for r in D.class_counts(enr, "type").collect())
    assert set(per_type.values()) == {max_type}
    assert out.count() == len(per_type) * max_type


def test_undersample_to_smallest(spark, enr):
    out = D.undersample(enr, "type", ["doc_id"])
    smallest = min(r["n"] for r in D.class_counts(enr, "type").collect())
    assert {r["n"] for r in D.class_counts(out, "type").collect()} == {smallest}
    assert out.select("doc_id").distinct().count() == out.count()


def test_split_disjoint_covering(spark):
    lab = C._labelled(spark, SF_SMALL)
    sp = E.train_val_split(lab, ["doc_id"])
    n = lab.count()
    val = sp.where(F.col("split") == "val").count()
    assert val == math.ceil(0.2 * n)
    assert sp.count() == n and sp.select("doc_id").distinct().count() == n


def test_grouped_split_has_no_leakage(spark, enr):
    bal = D.balance_two_pass(enr, "emotion", "type", ["doc_id"])
    sp = E.train_val_split(bal, ["type", "draw2"], group_cols=["text_key"])
    assert E.leaked_rows(sp, "text_key").count() == 0
    naive = E.train_val_split(bal, ["type", "draw2"])
    assert E.leaked_rows(naive, "text_key").count() > 0


def test_decode_inverts_encode(spark):
    lab = C._labelled(spark, SF_SMALL)
    codes = C._codes(lab)
    enc = E.encode_labels(lab, codes)
    back = enc
    for h in C.HEAD_COLS:
        back = E.decode_labels(back.drop(h), f"label_{h}", codes[h], h)
    a = lab.select("doc_id", *C.HEAD_COLS)
    b = back.select("doc_id", *C.HEAD_COLS)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_codes_are_sorted_order(spark):
    df = spark.createDataFrame([("b",), ("B",), ("a",), ("é",), ("a",)], "c string")
    got = [r["value"] for r in E.fit_codes(df, "c").orderBy("code").collect()]
    assert got == sorted({"b", "B", "a", "é"})


def test_report_identities(spark):
    res = C._results_df(spark, SF_SMALL)
    long = C._long(res)
    rep = G.class_report(long)
    n_val = res.count()
    for r in rep.groupBy("head").agg(F.sum("support").alias("s")).collect():
        assert r["s"] == n_val
    avg = {(r["head"], r["avg"]): r for r in G.report_averages(long).collect()}
    for h in C.HEAD_COLS:
        acc = avg.get((h, "accuracy")) or avg.get((h, "micro avg"))
        w = avg[(h, "weighted avg")]
        if (h, "accuracy") in avg:
            assert w["recall"] == pytest.approx(acc["f1"], abs=1e-9)


def test_relation_shares_sum_to_one(spark):
    rel = G.relation(C._results_df(spark, SF_SMALL), "pred_type", "pred_emotion")
    for r in rel.groupBy("pred_type").agg(F.sum("share").alias("s")).collect():
        assert r["s"] == pytest.approx(1.0)


def test_roc_ends_and_auc(spark):
    roc = G.roc_curve(C._roc_input(spark, SF_SMALL), "n_chars", "toxic").collect()
    assert (roc[0]["fpr"], roc[0]["tpr"]) == (0.0, 0.0)
    assert max(r["fpr"] for r in roc) == pytest.approx(1.0)
    assert max(r["tpr"] for r in roc) == pytest.approx(1.0)
    auc = G.roc_auc(C._roc_input(spark, SF_SMALL), "n_chars", "toxic").first()["auc"]
    pts = sorted((r["fpr"], r["tpr"]) for r in roc)
    trap = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(pts, pts[1:]))
    assert auc == pytest.approx(trap, abs=1e-9)


def test_running_totals_match_plain_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).select((F.col("id") % 977).cast("double").alias("s"),
                                     (F.col("id") % 3).alias("v")).groupBy("s").agg(
        F.sum("v").alias("v"))
    got = G.running_totals_desc(df, "s", ["v"], buckets=16)
    w = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("s", F.sum("v").over(w).alias("cum_v"))
    a = {r["s"]: r["cum_v"] for r in got.collect()}
    b = {r["s"]: r["cum_v"] for r in ref.collect()}
    assert a == b


def test_stream_equals_batch_for_ended(spark):
    s = {r["conv_id"]: r for r in C.stream_conversation_summary(spark, SF_SMALL).collect()}
    b = {r["conv_id"]: r for r in C.conversation_text(spark, SF_SMALL).collect()}
    ended = [k for k, r in s.items() if r["ended"]]
    assert ended
    for k in b:
        assert s[k]["text"] == b[k]["text"]
    # conversations that open with an exit word keep no turn: no batch row
    assert all(s[k]["n_kept"] == 0 for k in set(s) - set(b))


def test_partition_count_does_not_change_results(spark):
    one = C.enriched(spark, SF_SMALL).select("doc_id", "emotion")
    many = S.enrich_posts(fx.posts_v(spark, SF_SMALL).repartition(7),
                          S.LexiconScorer(fx.lexicon(spark))).select("doc_id", "emotion")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    a = D.oversample(C._enr(spark, SF_SMALL).coalesce(1), "type", ["doc_id"]).select(
        "type", "draw", "doc_id")
    b = D.oversample(C._enr(spark, SF_SMALL).repartition(7), "type", ["doc_id"]).select(
        "type", "draw", "doc_id")
    assert a.exceptAll(b).count() == 0


def test_smote_vectors_interpolate(spark):
    emb = table(spark, SF_SMALL, "embeddings")
    s = D.synthetic_oversample(emb, "label", ["vec_id"], "embedding")
    sizes = {r["label"]: r["n"] for r in emb.groupBy("label").agg(F.count("*").alias("n"))
             .collect()}
    got = {r["label"]: r["n"] for r in s.groupBy("label").agg(F.count("*").alias("n")).collect()}
    top = max(sizes.values())
    for lab, n in sizes.items():
        assert got.get(lab, 0) == top - n
    bad = s.join(emb.select(F.col("vec_id").alias("base_vec_id"), F.col("label").alias("bl")),
                 "base_vec_id").where(F.col("bl") != F.col("label")).count()
    assert bad == 0


def test_in_row_and_join_scoring_agree(spark):
    posts = fx.posts_v(spark, SF_SMALL)
    a = S.enrich_posts(posts, S.LexiconScorer(fx.lexicon(spark), in_row=True))
    b = S.enrich_posts(posts, S.LexiconScorer(fx.lexicon(spark)))
    assert a.columns == b.columns
    assert "Generate" not in a._jdf.queryExecution().executedPlan().toString()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_running_totals_with_crowded_scores(spark):
    from pyspark.sql import Window
    crowded = spark.range(0, 3000).select((F.lit(1.0) - F.col("id") * F.lit(1e-9)).alias("s"),
                                          (F.col("id") % 5).alias("v"))
    far = spark.range(0, 3).select((F.col("id") * -100.0).alias("s"), F.lit(7).cast("bigint").alias("v"))
    df = crowded.unionByName(far)
    got = G.running_totals_desc(df, "s", ["v"], buckets=32)
    w = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("s", F.sum("v").over(w).alias("cum_v"))
    assert {r["s"]: r["cum_v"] for r in got.collect()} == {r["s"]: r["cum_v"] for r in ref.collect()}
