"""Neighbours inside a class, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from harness import compare, duck
from moodframe.operators import balance as D
from moodframe.operators.neighbours import nearest_in_class


def table(spark, groups):
    """Rows of (label, idx, vec) from {label: matrix}."""
    rows = [(label, i, [float(x) for x in v]) for label, m in groups.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "label int, idx long, vec array<float>").repartition(6)


def brute(groups, k):
    out = {}
    for label, m in groups.items():
        m = np.asarray(m, dtype=np.float32).astype(float)
        d = np.round(((m[:, None, :] - m[None, :, :]) ** 2).sum(-1), 9)
        np.fill_diagonal(d, np.inf)
        for i in range(len(m)):
            out[label, i] = [int(j) for j in np.argsort(d[i], kind="stable")[:min(k, len(m) - 1)]]
    return {key: v for key, v in out.items() if v}


def found(result):
    return {(r.label, r.idx): list(r.neighbours) for r in result.found.collect()}


def test_one_cell_is_exact(spark):
    rng = np.random.default_rng(1)
    groups = {0: rng.normal(size=(120, 8)), 1: rng.integers(0, 2, size=(60, 3)), 2: rng.normal(size=(3, 8)), 3: [[1.0, 2.0]]}
    got = nearest_in_class(table(spark, groups), "label")
    assert found(got) == brute(groups, 5) and got.recall == 1.0


def test_all_cells_are_exact_and_chunks_change_nothing(spark):
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=(300, 5)), 1: rng.normal(size=(40, 5))}
    got = nearest_in_class(table(spark, groups), "label", cell_rows=50, chunk=7, min_recall=1.0, probes=1)
    assert found(got) == brute(groups, 5) and got.recall == 1.0


@pytest.mark.parametrize("spread", [0.15, 3.0])
def test_hot_class_of_many_cells_reaches_the_recall(spark, spread):
    """A class with most rows, in clusters and without any: the measured
    recall holds for all rows."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 16))
    groups = {7: centres[rng.integers(0, 25, 3000)] + spread * rng.normal(size=(3000, 16)), 8: rng.normal(size=(100, 16))}
    got = nearest_in_class(table(spark, groups), "label", cell_rows=100, chunk=64)
    have, want = found(got), brute(groups, 5)
    hit = sum(len(set(have.get(key, [])) & set(w)) for key, w in want.items())
    assert got.recall >= 0.9 and hit / sum(map(len, want.values())) >= 0.9
    if spread < 1:
        assert got.probes < 30  # clusters need few of the cells


def test_only_queries_are_answered(spark):
    rng = np.random.default_rng(4)
    groups = {0: rng.normal(size=(80, 4))}
    asked = spark.createDataFrame([(0, 3), (0, 70), (0, 3)], "label int, idx long")
    got = found(nearest_in_class(table(spark, groups), "label", asked, cell_rows=20, min_recall=1.0))
    want = brute(groups, 5)
    assert got == {key: want[key] for key in [(0, 3), (0, 70)]}


def test_smote_partners_are_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i >= 90), [float(x) for x in rng.normal(size=6)]) for i in range(100)] + [(200, 2, [1.0] * 6), (201, None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    got = D.synthetic_oversample(df, "label", ["vec_id"], "v").collect()
    assert sorted(r.label for r in got) == [1] * 80 + [2] * 89
    vectors = {r[0]: np.array(r[2]) for r in rows}
    small = [r for r in rows if r[1] == 1]
    for r in got:
        x, y = vectors[r.base_vec_id], vectors[r.partner_vec_id]
        assert np.allclose(r.v, x + r.u * (y - x))
        if r.label == 1:
            nearer = sum(((vectors[s[0]] - x) ** 2).sum() < ((y - x) ** 2).sum() for s in small if s[0] != r.base_vec_id)
            assert r.base_vec_id != r.partner_vec_id and nearer < 5
        else:
            assert r.base_vec_id == r.partner_vec_id == 200


def test_smote_matches_its_twin(spark):
    sf = "/root/testdata/sf0.01"
    r = compare(spark, "smote", sf, duck(sf))
    assert r["cols_match"] and r["hash_match"], r
