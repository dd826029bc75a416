"""A1 with rows that do not fit, and H6 with a longer history."""

from __future__ import annotations

import pytest

from harness import compare, duck
from moodframe.operators import conversation as H
from moodframe.sources import io as IO


def test_broken_rows_go_to_quarantine(spark, tmp_path):
    path, aside = str(tmp_path / "csv"), str(tmp_path / "aside")
    rows = [(k, "INTJ", "en", f'text, "{k}"\nmore', k) for k in range(20)] + [(None, None, None, None, None), (7, "", "", "", 0)]
    df = spark.createDataFrame(rows, IO.POSTS_SCHEMA)
    IO.write_csv(df, path)
    (tmp_path / "csv" / "zz.csv").write_text('doc_id,type,lang,posts,n_chars\n"x1","INTJ","en","broken id","3"\n'
                                             '"5","INTJ"\n"6","INTJ","en","fine","4"\n"8","INTJ","en","many","4","5","6"\n')
    good = IO.read_posts_csv(spark, path, quarantine=aside)
    key = lambda r: str(r)
    assert sorted(map(tuple, good.collect()), key=key) == sorted([*rows, (6, "INTJ", "en", "fine", 4)], key=key)
    bad = spark.read.parquet(aside).collect()
    assert sorted(r[IO.BAD_ROW].split(",")[0] for r in bad) == ['"5"', '"8"', '"x1"'] and all(r._file.endswith("zz.csv") for r in bad)
    with pytest.raises(Exception):
        IO.read_posts_csv(spark, path).collect()


def test_no_broken_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "INTJ", "en", "a", 1)], IO.POSTS_SCHEMA)
    IO.write_csv(df, str(tmp_path / "csv"))
    assert IO.read_posts_csv(spark, str(tmp_path / "csv"), quarantine=str(tmp_path / "aside")).count() == 1
    assert spark.read.parquet(str(tmp_path / "aside")).count() == 0


def test_last_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 4, "user", "d"), (1, 6, "user", "e"),
            (2, 0, "user", None), (2, 1, "user", "x"), (3, 0, "assistant", "y"), (None, 0, "user", "z"), (4, 1, "user", "p"), (4, 1, "user", "q"),
            (4, None, "user", "r")]
    kept = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.n_turns, r.prompt) for r in H.last_turns(kept, 3).collect()}
    assert got == {1: (3, "c\nd\ne"), 2: (2, "x"), None: (1, "z"), 4: (2, "p\nq")}
    plan = H.last_turns(kept, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle


def test_last_turns_match_the_twin(spark):
    sf = "/root/testdata/sf0.01"
    r = compare(spark, "last_three_turns_prompt", sf, duck(sf))
    assert r["cols_match"] and r["hash_match"], r
