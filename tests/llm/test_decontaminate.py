from __future__ import annotations

from harness import compare, duck
from moodframe.llm.decontaminate import contaminated, item_signatures

WORDS = [f"w{i}" for i in range(400)]


def text(a: int, b: int) -> str:
    return " ".join(WORDS[a:b])


def test_pairs_and_edge_rows(spark):
    items = spark.createDataFrame(
        [(1, text(0, 20), "x"), (2, text(50, 60), "x"), (3, "too short", "x"), (4, None, "x"), (None, text(80, 95), "x"),
         (5, text(0, 20), "x")], "item_id bigint, text string, hash string")
    docs = spark.createDataFrame(
        [(1, text(300, 320) + ". " + text(0, 20).upper() + ", " + text(320, 330), "x", 0),
         (2, text(0, 17), "x", 0),  # 13 of 16 shingles
         (3, text(0, 16), "x", 0),  # 12 of 16
         (4, None, None, 0), (5, "", "", 0), (None, "a " + text(50, 60), "x", 0), (None, "a " + text(50, 60), "x", 0),
         (6, text(100, 300) * 30 + " " + text(80, 95), "x", 0), (7, "w1 w2", "x", 0)],
        "doc_id bigint, text string, words string, item_no int")
    got = sorted(((r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in contaminated(docs, items).collect()),
                 key=str)
    assert got == sorted([(1, 1, 16, 16), (1, 5, 16, 16), (2, 1, 16, 13), (2, 5, 16, 13), (None, 2, 6, 6),
                          (6, None, 11, 11)], key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, text(0, 9))], "item_id bigint, text string")
    assert contaminated(none, items).count() == 0
    assert contaminated(spark.createDataFrame([(1, text(0, 9))], "doc_id bigint, text string"),
                        items.where("item_id > 1")).count() == 0


def test_signatures_outnumber_what_a_match_may_lack(spark):
    rows = [(n, [f"v{i}" for i in range(n + 4)]) for n in range(1, 70)]
    sig = item_signatures(spark.createDataFrame(rows, "item_no bigint, words array<string>"), 0.8, 5)
    size = {r.item_no: r["count"] for r in sig.groupBy("item_no").count().collect()}
    for n in range(1, 70):
        may_lack = max(k for k in range(n + 1) if (n - k) / n >= 0.8)
        assert min(n, may_lack + 1) <= size[n] <= n


def test_query_matches_its_twin(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        r = compare(spark, "op7_benchmark_decontamination", sf, duck(sf))
        assert r["cols_match"] and r["hash_match"] and r["spark_rows"] > 0, r


def test_items_of_fewer_words_than_a_shingle(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "Gamma"), (3, "one two three four five six"), (4, "one two three four"), (5, "...")],
                                  "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x alpha, BETA y"), (2, "beta alpha"), (3, "the gamma"), (4, "gammas one two three"),
                                  (5, "zero one two three four five six seven"), (6, "alpha"), (7, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in contaminated(docs, items).collect())
    assert got == [(1, 1, 1, 1), (3, 2, 1, 1), (5, 3, 2, 2), (5, 4, 1, 1)]


def test_short_items_match_the_twin(spark, tmp_path):
    import duckdb
    from moodframe.llm.decontaminate import ORACLE_SQL, query
    spark.createDataFrame([(1, "alpha beta"), (2, "one two three four five six")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "x alpha, BETA y"), (2, "one two three four five six"), (3, "alpha")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(con.sql(ORACLE_SQL).fetchall())
