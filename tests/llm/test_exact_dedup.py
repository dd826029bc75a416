from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from harness import compare, duck
from moodframe.llm.exact_dedup import DigestIndex, exact_dedup
from moodframe.session import scratch_dir

SCHEMA = "doc_id bigint, text string, keep_id string, digest string"


def fresh_index(spark):
    return DigestIndex(spark, scratch_dir(spark, "digest-index-test"))


def test_edge_rows(spark):
    rows = [(1, "Ab", "x", "y"), (2, "aB", "x", "y"), (3, "", "x", None), (4, None, None, None),
            (None, "ab", "x", "y"), (5, "É", "x", "y"), (6, "é", "x", "y"), (7, "same", "x", "y"),
            (7, "same", "x", "y"), (None, "lone", "x", "y"), (8, "l" * 300_000, "x", "y")]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), fresh_index(spark)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append((r.doc_id, r.keep_id, r.group_size, r.kept))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(by[sha("ab")], key=str) == [(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False)]
    assert sorted(by[sha("")]) == [(3, 4, 2, False), (4, 4, 2, True)]
    assert by[sha("É")] == [(5, 5, 1, True)] and by[sha("é")] == [(6, 6, 1, True)]
    assert sorted(by[sha("same")]) == [(7, 7, 2, False), (7, 7, 2, True)]
    assert by[sha("lone")] == [(None, None, 1, True)]


def test_later_batches_lose_to_the_index(spark):
    index = fresh_index(spark)
    docs = spark.createDataFrame([(5, "a"), (3, "b")], "doc_id bigint, text string")
    exact_dedup(docs, index).collect()
    again = DigestIndex(spark, index.location.rpartition("/")[0])
    assert again.buckets == index.buckets and again.rows().count() == 2
    docs = spark.createDataFrame([(9, "A"), (8, "c"), (7, "C")], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, again).collect()}
    assert got == {9: (5, 1, False), 8: (8, 2, True), 7: (8, 2, False)}
    assert again.rows().count() == 3


def decisions(rows):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows.collect()), key=str)


def test_a_batch_that_runs_again_keeps_what_it_kept(spark):
    docs = spark.createDataFrame([(5, "a"), (3, "A"), (4, "b"), (None, "c")], "doc_id bigint, text string")
    for name in (None, "monday"):
        index = fresh_index(spark)
        exact_dedup(spark.createDataFrame([(1, "b")], "doc_id bigint, text string"), index).collect()
        once = decisions(exact_dedup(docs, index, batch=name))
        assert decisions(exact_dedup(docs, index, batch=name)) == once
        assert (5, 5, 2, True) in once and (4, 1, 1, False) in once and index.rows().count() == 3


def test_a_run_that_fails_around_the_append(spark, monkeypatch):
    docs = spark.createDataFrame([(5, "a"), (3, "A"), (4, "b")], "doc_id bigint, text string")
    want = decisions(exact_dedup(docs, fresh_index(spark)))
    append = DigestIndex.append
    for partial in (False, True):
        def failing(self, fresh):
            append(self, fresh.where("keep_id = 5") if partial else fresh)
            raise RuntimeError("lost")
        index = fresh_index(spark)
        monkeypatch.setattr(DigestIndex, "append", failing)
        try:
            exact_dedup(docs, index)
        except RuntimeError:
            pass
        monkeypatch.setattr(DigestIndex, "append", append)
        assert decisions(exact_dedup(docs, DigestIndex(spark, index.path))) == want


def test_an_index_grows_into_more_buckets(spark):
    index = fresh_index(spark)
    docs = spark.range(500).selectExpr("id as doc_id", "cast(id as string) as text")
    exact_dedup(docs, index).collect()
    buckets, held = index.buckets, sorted(r.keep_id for r in index.rows().collect())
    index.grow()
    assert index.buckets == buckets
    index.grow(rows_per_bucket=10)
    assert index.buckets == 50 and sorted(r.keep_id for r in index.rows().collect()) == held
    again = DigestIndex(spark, index.path)
    assert again.buckets == 50
    assert exact_dedup(docs.selectExpr("doc_id + 1000 as doc_id", "text"), again).where("kept").count() == 0
    again.close()


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA), fresh_index(spark)).count() == 0


def test_a_hot_text_and_the_index_layout(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                    .otherwise(F.col("id").cast("string")).alias("text"))
    index = fresh_index(spark)
    got = exact_dedup(docs, index)
    assert got.where("kept").count() == 4000 - 1334 + 1 == index.rows().count()
    plan = index.unseen(docs.selectExpr("cast(text as binary) as digest"))._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_query_matches_its_twin(spark):
    sf = "/root/testdata/sf0.01"
    r = compare(spark, "op6_exact_dedup", sf, duck(sf))
    assert r["cols_match"] and r["hash_match"], r
