"""Hard negatives against all pairs in plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from moodframe.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows):
    """The query over (vec_id, embedding, label) rows without repeated ids."""
    used = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        used[vec_id] = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector])
    for anchor, (label, vector) in used.items():
        if anchor % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(vector, v)), i, other) for i, (other, v) in used.items() if i != anchor))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(s, i) for s, i, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p]
            yield from ((anchor, positive, rank + 1, i, -p, -s) for rank, (s, i) in enumerate(fit[:10]))


def run(spark, rows, extra=None):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", *extra)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hn.hard_negatives(df, F.col("id") % 100 == 0, label=label).select(*COLUMNS).collect()))


def vectors(seed, n, width=6, values=None, labels=10):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(values)) if values else (lambda: rng.uniform(-1, 1))
    rows = [(i * 5, [float(draw()) for _ in range(width)], rng.randrange(labels)) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [
    vectors(1, 400),
    vectors(2, 400, values=[0, 0.004, 0.25, -0.25], labels=3),  # ties, scores of 0, empty windows
    vectors(3, 300, width=2, labels=1),  # no negatives but where ids are divisible by 7
])
def test_equals_all_pairs(spark, rows):
    got = run(spark, rows, ["'x' as anchor", "1 as slot"])
    assert got == sorted(plain(rows)) and got


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(hn, "SCORES_AT_ONCE", 40)
    rows = vectors(4, 200)
    assert run(spark, rows) == sorted(plain(rows))


def test_broken_rows_take_no_part(spark):
    rows = vectors(5, 200) + [(2000, None, 1), (2001, [1.0] * 6, None), (None, [1.0] * 6, 1), (2100, [float("nan")] * 6, 1),
                              (2102, [float("inf")] + [1.0] * 5, 1), (2103, [None] + [1.0] * 5, 1)]
    assert run(spark, rows) == sorted(plain(rows))


def test_short_vectors_and_repeated_ids(spark):
    rows = [(100, [1.0, 1.0], 1), (1, [1.0], 1), (2, [0.5, 0.0, 3.0], 2), (3, [], 2), (2, [0.5, 0.0, 3.0], 2), (100, [9.0], 5)]
    got = run(spark, rows)
    # the anchor is the row of label 1; its other row is no partner, the repeated negative counts twice
    assert got == [(100, 1, 1, 2, 65536, 32768), (100, 1, 2, 2, 65536, 32768)]


def test_large_components_stay_exact(spark):
    big = float(2 ** 20 + 2)
    rows = [(100, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big / 2, 1.0], 2), (3, [big * 0.75, 5.0], 2)]
    assert run(spark, rows) == sorted(plain(rows))


def test_empty_and_without_anchors(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
