"""G16 over many columns and D9 by thresholds."""

from __future__ import annotations

import math

import numpy as np
import pytest

from harness import compare, duck
from moodframe.functions.hashing import md5int_py
from moodframe.operators import balance as D
from moodframe.operators import evaluate as G


def test_correlations_of_pairwise_complete_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    x[:, 1] = 3 * x[:, 0] + 0.1 * x[:, 1] + 1e6
    x[:, 4] = 5.0
    rows = [[float(v) if rng.random() > 0.2 else None for v in r] for r in x]
    rows = [[*r, None, 1.0 if k == 3 else None] for k, r in enumerate(rows)]
    cols = [f"col {k}" for k in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(5)
    got = {(r.a, r.b): r.corr for r in G.correlation_matrix(df, cols).collect()}
    assert len(got) == 36
    table = np.array([[math.nan if v is None else v for v in r] for r in rows])
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[i:], start=i):
            both = table[~np.isnan(table[:, i]) & ~np.isnan(table[:, j])][:, [i, j]]
            if len(both) < 2:
                assert got[a, b] is None
            elif both.std(axis=0).min() == 0:
                assert math.isnan(got[a, b])
            else:
                assert got[a, b] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)


def test_three_hundred_columns_in_one_job(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 300))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{k} double" for k in range(300)))
    got = {(r.a, r.b): r.corr for r in G.correlation_matrix(df, df.columns).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 300 * 301 // 2
    assert max(abs(v - want[int(a[1:]), int(b[1:])]) for (a, b), v in got.items()) < 1e-9


def test_undersample_keeps_the_smallest_hashes_and_moves_no_row(spark):
    rows = [(k, "abc"[(k % 10 > 0) + (k % 10 > 7)] if k % 13 else None, f"text {k}") for k in range(600)]
    df = spark.createDataFrame(rows, "id long, c string, t string")
    out = D.undersample(df, "c", ["id"])
    groups = {}
    for k, c, t in rows:
        if c is not None:
            groups.setdefault(c, []).append((md5int_py("under", k), k))
    n = min(map(len, groups.values()))
    assert sorted(r.id for r in out.collect()) == sorted(k for g in groups.values() for _, k in sorted(g)[:n])
    assert out.columns == df.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_undersample_edges(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, c string")
    assert D.undersample(df, "c", ["id"]).count() == 2
    assert D.undersample(df.where("id > 9"), "c", ["id"]).count() == 0


def test_twins(spark):
    sf = "/root/testdata/sf0.01"
    con = duck(sf)
    for name in ("correlation_matrix", "undersample"):
        r = compare(spark, name, sf, con)
        assert r["cols_match"] and r["hash_match"], r
