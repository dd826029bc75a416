"""Language identification, quality and toxicity: held-out accuracy, the
methods' parts against brute force, and defined results for edge rows."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodframe.llm import language_id, quality, toxicity
from moodframe.llm.common import documents, labels

SF = "/root/testdata/sf0.01"
EDGE = "doc_id bigint, text string, score string, label int, lang string"
ROWS = [(1, None, "s", 1, None), (2, "", "s", 1, "en"), (None, "1234 !!", "s", 0, "en"), (4, "word", "s", 1, "en"),
        (4, "word", "s", 1, "en"), (5, "é\x00 日本 ß\n" * 20_000, None, None, "fr")]


def edge(spark):
    return spark.createDataFrame(ROWS, EDGE)


# language identification

def test_trigrams_and_vectors_by_hand():
    letters = language_id.LetterVectors(64, 1)
    grams, counts = letters.trigrams("Ab, ab1b")
    spelt = ["".join(chr(int(g) >> s & 0x1FFFFF) if int(g) >> s & 0x1FFFFF else " " for s in (42, 21, 0)) for g in grams]
    assert dict(zip(spelt, counts.tolist())) == {" ab": 2, "ab ": 2, "b a": 1, "b b": 1, " b ": 1}
    vector = {c: letters._vector(ord(c) if c != " " else 0).astype(int) for c in " ab"}
    want = sum(n * np.roll(vector[g[0]], 2) * np.roll(vector[g[1]], 1) * vector[g[2]] for g, n in zip(spelt, counts))
    got = language_id.directions(["Ab, ab1b", None, "77"], letters)
    assert np.allclose(got[0], want / np.linalg.norm(want), atol=1e-5) and not got[1:].any()


def test_languages_held_out(spark):
    rows = language_id.query(spark, SF).join(documents(spark, SF).select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert len(held) > 150 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_rows(spark):
    learned = spark.createDataFrame([("the cat", "en"), ("le chat été", "fr"), (None, "de"), ("x", None)], "text string, lang string")
    model = language_id.learn(learned)
    assert model[0] == ["de", "en", "fr"]
    got = language_id.identify(edge(spark), model, carry=("doc_id", "lang", "label")).collect()
    assert len(got) == 6 and {r.lang_pred for r in got if r.doc_id in (1, 2, None)} == {"und"}
    nothing = language_id.learn(learned.where("lang = 'xx'"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(edge(spark), nothing).collect()} == {("und", 0.0)}
    assert language_id.identify(edge(spark).where("doc_id > 9"), model).count() == 0


# quality

def test_isotonic_is_the_nearest_monotone_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        y, n = rng.integers(0, 3, 5) / 2, rng.integers(1, 4, 5)
        _, got = quality.isotonic(np.arange(5.0), y, n)
        grid = itertools.combinations_with_replacement(np.linspace(0, 1, 13), 5)
        best = min((n * (np.array(g) - y) ** 2).sum() for g in grid)
        assert (np.diff(got) >= 0).all() and (n * (got - y) ** 2).sum() <= best + 1e-12


def test_partition_sums_equal_the_whole_fit(spark):
    docs, truth = documents(spark, SF), labels(spark, SF)
    model = quality.train(docs, truth)
    rows = docs.join(truth, "doc_id").groupBy("text").agg(F.max("quality").alias("y")).collect()
    z = model.features(np.stack([quality.statistics(r.text) for r in rows]))
    penalty = np.eye(z.shape[1])
    penalty[-1, -1] = 0
    weights = np.linalg.solve(z.T @ z + penalty + 1e-9 * np.eye(len(penalty)), z.T @ np.array([r.y for r in rows], dtype=float))
    assert np.allclose(z @ weights, z @ model.weights, atol=1e-6)


def test_quality_held_out(spark):
    rows = quality.query(spark, SF).join(labels(spark, SF), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_edge_rows(spark):
    model = quality.train(edge(spark), edge(spark), label="label")
    got = quality.score(edge(spark), model, carry=("doc_id", "lang")).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    empty = quality.train(edge(spark), edge(spark).where("doc_id > 9"), label="label")
    assert {r.score for r in quality.score(edge(spark), empty).collect()} == {0.5}
    assert quality.score(edge(spark).where("doc_id > 9"), empty).count() == 0
    assert len(quality.statistics("a")) == len(quality.STATISTICS)


# toxicity

def test_noisy_or_and_places():
    model = toxicity.ToxicityModel({"bad": 0, "evil*": 1}, np.array([9.0, 8.0]), -6.0)
    text = "İ fine. So BAD!\nevil evils. ok"
    plain, scored = model.sentence_scores(text)
    assert plain == 2 and [text[a:b] for a, b, _ in scored] == [" So BAD", "evil evils"]
    p = [1 / (1 + np.exp(6)), 1 / (1 + np.exp(-3)), 1 / (1 + np.exp(-2))]
    assert model.score(plain, scored) == pytest.approx(1 - (1 - p[0]) ** 2 * (1 - p[1]) * (1 - p[2]))
    assert model.score(0, []) == 0


def test_gradient_steps_climb_the_likelihood():
    from collections import namedtuple
    Bag = namedtuple("Bag", "label plain hits")
    rng = np.random.default_rng(1)
    bags = [Bag(1, int(rng.integers(1, 30)), [[0]]) for _ in range(40)] + [Bag(0, int(rng.integers(1, 30)), [[1]]) for _ in range(300)]
    bags += [Bag(1, 10, []) for _ in range(10)]  # labels that no sentence explains
    weights, bias = toxicity.fit_bags(bags, 2)
    assert weights[0] + bias > 1 and weights[1] + bias < -3 and 30 / (1 + np.exp(-bias)) < 0.3


def test_toxicity_held_out(spark):
    rows = toxicity.query(spark, "/root/testdata/sf0.1").join(labels(spark, "/root/testdata/sf0.1"), "doc_id").where("held_out").collect()
    clean = [r for r in rows if not r.toxic]
    toxic = [r for r in rows if r.toxic]
    assert np.mean([r.predicted for r in clean]) < 0.01 and np.mean([r.predicted for r in toxic]) > 0.8


def test_rare_toxic_documents_are_learnt_from(spark):
    rng = np.random.default_rng(2)
    common = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(30)]

    def table(n: int, toxic: int):
        rows = [(k, " ".join(rng.choice(common, 12)) + f". day {k}. " + ("You vileword here. " if k < toxic else "") + "End.", int(k < toxic))
                for k in range(n)]
        return spark.createDataFrame(rows, "doc_id long, text string, toxic int")

    for docs, rows, toxic in ((table(8_000, 6), 400, 6), (table(400, 3), 20_000, 3)):  # few of many, and a small table
        sample = toxicity.sample_by_label(docs, docs, "doc_id", "text", "toxic", rows).collect()
        assert sum(r.label for r in sample) == toxic and len(sample) < 1.3 * rows
        assert sum(r.weight for r in sample) == pytest.approx(docs.count(), rel=0.2)
        model = toxicity.train(docs, docs, rows=rows)
        got = toxicity.score(docs, model, carry=("doc_id", "toxic")).collect()
        assert "vileword" in model.words and all(r.predicted == r.toxic for r in got)
    for label in (0, 1):  # one label alone teaches nothing
        assert toxicity.train(docs, docs.where(f"toxic = {label}")).words == {}
    assert toxicity.train(docs, docs.where("doc_id < 0")).words == {}


def test_toxicity_edge_rows(spark):
    model = toxicity.train(edge(spark), edge(spark), label="label")
    got = toxicity.score(edge(spark), model, carry=("doc_id", "lang")).collect()
    assert len(got) == 6 and {r.score for r in got if r.doc_id in (1, 2)} == {0.0}
    assert toxicity.score(edge(spark).where("doc_id > 9"), model).count() == 0
