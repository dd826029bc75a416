"""Ids around 2**53 beside a null id in the same batch, for every operator
that runs in Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from moodframe.llm import fingerprints, language_id, lm_score, pii, quality, toxicity

IDS = [2 ** 53 - 1, 2 ** 53, 2 ** 53 + 1, 2 ** 62 + 1, -(2 ** 53) - 1, None, None, 0]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some words number {k} of a small text. another sentence here", "en" if k % 2 else "de", k % 2) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, label int").coalesce(1)


def key(i):
    return (i is not None, i or 0)


def rated(name, docs):
    held = docs.withColumn("held_out", F.lit(False))
    truth = docs.select("doc_id", F.col("label").alias("quality"), F.col("label").alias("toxic"))
    if name == "pii":
        return pii.find_pii(docs)
    if name == "lm_score":
        return lm_score.lm_scores(held)
    if name == "language_id":
        return language_id.identify(docs, language_id.learn(docs))
    if name == "quality":
        return quality.score(docs, quality.train(docs, truth))
    if name == "toxicity":
        return toxicity.score(docs, toxicity.train(docs, truth))
    return fingerprints.fingerprint_edits(docs)


@pytest.mark.parametrize("name", ["pii", "lm_score", "language_id", "quality", "toxicity", "fingerprints"])
def test_ids_come_back_as_they_are(docs, name):
    got = [r.doc_id for r in rated(name, docs).select("doc_id").collect()]
    assert sorted(got, key=key) == sorted(IDS, key=key)
