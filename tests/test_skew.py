"""Joins by frequent keys, ids without wide windows, and plans that shuffle no
text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from moodframe.operators import balance as D
from moodframe.operators import keyed as K
from moodframe.operators import models as M
from moodframe.operators import prep as P


def rows_of(df):
    return sorted(map(str, df.collect()))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_frequent_equals_a_left_join(spark):
    rows = spark.range(3000).select("id", F.expr("case when id % 3 = 0 then 'the' when id % 50 = 1 then null else concat('w', id % 700) end").alias("token"))
    table = rows.where("token is not null and id % 2 = 0").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = K.join_frequent(rows, table, "token", "n", "id")
    assert rows_of(got) == rows_of(rows.join(table.drop("n"), "token", "left").select("id", "token", "top"))
    empty = table.where("n < 0")
    assert K.join_frequent(rows, empty, "token", "n", "id").where("top is not null").count() == 0


def test_a_token_in_every_document_is_dealt_evenly(spark):
    """Rows of a token that training saw often go on under salted keys."""
    rows = spark.range(40_000).select("id", F.expr("if(id % 4 > 0, 'the', concat('w', id))").alias("token"))
    table = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    often = table.where("n > 20").select("token", F.lit(1).alias("_often"))
    joined = K.join_frequent(rows, table.withColumn("w", F.lit(1.0)), "token", "n", "id")
    assert joined.where("w is null").count() == 0 and often.count() == 1
    # the keys that the shuffle deals by
    salt = F.pmod(F.xxhash64("id"), F.lit(K.SPREAD))
    sizes = [r["count"] for r in rows.where("token = 'the'").groupBy(F.pmod(F.xxhash64(salt), F.lit(8))).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_global_index(spark):
    df = spark.range(5000).select(F.expr("id % 7").alias("n"), F.concat(F.lit("t"), F.col("id")).alias("token")).repartition(9)
    got = K.global_index(df, [F.desc("n"), F.asc("token")])
    want = sorted(((r.n, r.token) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert [(r.n, r.token) for r in got.orderBy("idx").collect()] == want
    assert [r.idx for r in got.orderBy("idx").collect()] == list(range(5000))
    assert K.global_index(df.where("n > 9"), [F.desc("n")]).count() == 0


def test_vocabulary_has_no_window(spark):
    posts = spark.createDataFrame([("b a a",), ("c a b",), (None,)], "t string")
    vocab = P.build_vocabulary(posts, "t")
    assert [(r.token, r.token_id, r.n) for r in vocab.orderBy("token_id").collect()][4:] == [("a", 4, 3), ("b", 5, 2), ("c", 6, 1)]
    assert "Window" not in plan(vocab)


def test_leakage_by_digest(spark):
    rows = [(k, t, s) for k, (t, s) in enumerate([("a", "train"), ("a", "train"), ("a", "val"), ("b", "val"), (None, "train"), (None, "val"), ("", "train"), ("", "val")]
                                                 + [("hot", "val")] * 5000 + [("hot", "train")] * 3)]
    df = spark.createDataFrame(rows, "id long, t string, split string")
    r = P.split_leakage(df, "t").first()
    assert (r.n_val, r.n_leaked) == (5004, 5002)
    assert sorted(x.id for x in P.leaked_rows(df, "t").where("t <> 'hot'").collect()) == [2, 7]
    assert P.leaked_rows(df, "t").count() == 5002
    source = df.write.mode("overwrite")
    assert source is not None and "hashpartitioning(t" not in plan(P.split_leakage(df, "t"))


@pytest.mark.parametrize("name", ["strip_urls", "clean_text", "tokenize_words", "enrich_posts"])
def test_no_exchange_above_a_text_scan(spark, name):
    main = plan(E.queries()[name](spark, SF_SMALL)).split("Subquery")[0]
    assert "Exchange" not in main


def test_a_row_that_is_drawn_very_often(spark, monkeypatch):
    """One row of a class grows to the largest class; its draws are dealt over
    copies of it when the other columns join."""
    monkeypatch.setattr(D, "SALT_TARGET", 50)
    df = spark.range(901).select("id", F.expr("if(id = 0, 'rare', 'common')").alias("a"), F.expr("if(id % 2 = 0, 'x', 'y')").alias("b"),
                                 F.expr("concat('text ', id)").alias("t"))
    out = D.balance_two_pass(df, "a", "b", ["id"])
    rows = out.collect()
    assert all(r.t == f"text {r.id}" for r in rows) and sum(r.a == "rare" for r in rows) > 200
    assert {r["b"]: r["count"] for r in out.groupBy("b").count().collect()} == {"x": 451, "y": 451}


def test_model_versions(spark, tmp_path):
    train = spark.createDataFrame([(1, "and la", "INTJ"), (2, "der is", "ENFP")], "doc_id bigint, t string, type string")
    codes = {"type": P.fit_codes(train, "type")}
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        M.NaiveBayesModel.load(spark, path)
    first = M.train_naive_bayes(train, "doc_id", "t", ["type"])
    first.save(path, codes)

    class Broken:
        """A table whose write fails when others are written already."""
        def __getattr__(self, name):
            raise RuntimeError("lost")

    second = M.train_naive_bayes(train.where("doc_id = 1"), "doc_id", "t", ["type"], alpha=0.5)
    with pytest.raises(RuntimeError):
        M.NaiveBayesModel(second.class_params, second.token_params, Broken(), 0.5, 1).save(path, codes)
    loaded = M.NaiveBayesModel.load(spark, path)
    assert loaded.alpha == 1.0 and rows_of(loaded.class_params) == rows_of(first.class_params)
    assert rows_of(M.load_codes(spark, path)["type"]) == rows_of(codes["type"])
    second.save(path)
    assert M.saved_versions(spark, path) == [1, 2] and M.NaiveBayesModel.load(spark, path).alpha == 0.5
    assert M.NaiveBayesModel.load(spark, path, 1).alpha == 1.0
    # a table that changed after the save is found
    first.vocab.limit(1).write.mode("overwrite").parquet(f"{path}/versions/v000002/vocab")
    with pytest.raises(ValueError):
        M.NaiveBayesModel.load(spark, path)
