"""Toxicity by multiple-instance learning.

A label belongs to a document, but a few sentences cause it. A sentence has a
logistic score over the listed words and word beginnings in it, and a
document's score is their noisy-or: the chance that at least one of its sentences offends. Only document
labels are needed to train, and the sentence scores then say where the offence
is. While training, a leak term explains labels that no sentence accounts for.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.llm.common import discard, documents, held_out, labels, materialise, rate_texts, worker_cache

# Bound of the model: labelled rows that it is fitted on.
SAMPLE_ROWS = 20_000
# A word, or a beginning that longer words share (written with a trailing *),
# is listed if toxic documents hold it more often than chance explains, by so
# many deviations. The normal ones need some toxic documents to mean anything;
# with fewer, the root of the deviance decides.
BEGINNINGS = (4, 5, 6, 7)
NORMAL_TOXIC_DOCS = 5
MIN_DEVIATIONS = 4.5
CUT = 0.5

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
JAVA_NO_LETTERS = r"[^\p{L}]+"


def lowered(text: str) -> str:
    """Lower case that keeps every code point's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def sentences_with(text: str, listed: dict[str, int]) -> tuple[int, list[tuple[int, int, list[int]]]]:
    """The number of sentences without a listed word, and ``(start, end, the
    numbers of its listed words)`` of the others."""
    low, features = lowered(text), {}
    for word in set(WORD.findall(low)):
        own = {listed[word]} if word in listed else set()
        own |= {listed[b] for n in BEGINNINGS if len(word) > n and (b := word[:n] + "*") in listed}
        if own:
            features[word] = own
    if not features:
        return sum(1 for _ in SENTENCE.finditer(low)), []
    plain, others = 0, []
    for m in SENTENCE.finditer(low):
        found = set().union(*(features[w] for w in WORD.findall(m.group()) if w in features))
        if found:
            others.append((m.start(), m.end(), sorted(found)))
        else:
            plain += 1
    return plain, others


@dataclass(frozen=True)
class ToxicityModel:
    words: dict[str, int]
    weights: np.ndarray
    bias: float

    def sentence_scores(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of sentences without a listed word, and ``(start, end,
        score)`` of the others."""
        plain, others = sentences_with(text, self.words)
        return plain, [(a, b, float(_sigmoid(self.bias + self.weights[found].sum()))) for a, b, found in others]

    def score(self, plain: int, scored: list[tuple[int, int, float]]) -> float:
        log_none = plain * np.log1p(-_sigmoid(self.bias)) + sum(np.log1p(-min(p, 1 - 1e-12)) for *_, p in scored)
        return float(-np.expm1(log_none))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _beginnings(words: str, n: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def listed_words(sample: DataFrame) -> list[str]:
    """Words and beginnings that more toxic documents hold than their
    frequency explains; all of them, from a sample of a bounded number of rows."""
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    if not total.toxic or total.toxic == total.n:
        return []
    rate = total.toxic / total.n
    # fewer toxic documents are no evidence at this rate, even if no other document has the word
    least = min(NORMAL_TOXIC_DOCS, math.ceil(MIN_DEVIATIONS ** 2 / 2 / -math.log(rate)))
    own = sample.select("label", F.array_distinct(F.split(F.lower("text"), JAVA_NO_LETTERS)).alias("words"))
    starts = [_beginnings("words", n) for n in BEGINNINGS]
    held = own.select("label", F.explode(F.array_distinct(F.concat("words", *starts))).alias("word"))
    # only what enough toxic documents hold is counted over all of them
    common = held.where("label = 1").groupBy("word").count().where(F.col("count") >= least)
    held = held.join(common.select("word"), "word", "left_semi")
    counts = held.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
    n, toxic, clean = F.col("n"), F.col("toxic"), F.col("n") - F.col("toxic")
    z = (toxic - n * rate) / F.sqrt(n * rate * (1 - rate))
    deviance = 2 * (toxic * F.log(toxic / (n * rate)) + F.when(clean > 0, clean * F.log(clean / (n * (1 - rate)))).otherwise(0.0))
    enough = (toxic >= NORMAL_TOXIC_DOCS) | (F.sqrt(F.greatest(deviance, F.lit(0.0))) >= MIN_DEVIATIONS)
    best = counts.withColumn("z", z).where((F.col("z") >= MIN_DEVIATIONS) & enough)
    return sorted(r.word for r in best.select("word").collect())


def sample_by_label(docs: DataFrame, truth: DataFrame, doc_id: str, text: str, label: str, rows: int) -> DataFrame:
    """(text, label, weight) of at most about ``rows`` labelled documents, each
    distinct text once. Toxic ones get up to half of the rows, or all that
    clean ones leave; both are drawn by a hash of the id, and a weight is the
    number of labelled documents that one drawn stands for."""
    given = truth.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    given = given.groupBy(F.col(doc_id).alias("drawn_id")).agg(F.max(label).cast("int").alias("label"))
    count = {r.label: r.n for r in given.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = count.get(1, 0), sum(n for k, n in count.items() if k != 1)
    toxic_rows = min(toxic, max(rows // 2, rows - clean))
    shares = [min(1.0, (rows - toxic_rows) / max(1, clean)), toxic_rows / max(1, toxic)]
    share, weight = (F.when(F.col("label") == 1, of[1]).otherwise(of[0]) for of in (shares, [1 / s if s else 0.0 for s in shares]))
    drawn = given.where(F.pmod(F.xxhash64("drawn_id"), F.lit(1 << 30)) < share * (1 << 30)).withColumn("weight", weight)
    found = docs.select(F.col(doc_id).alias("drawn_id"), F.coalesce(text, F.lit("")).alias("text"))
    # few enough to be sent to every task, so no text is shuffled to find them
    return (found.join(F.broadcast(drawn), "drawn_id").groupBy("text").agg(F.max(F.struct("label", "weight")).alias("top"))
            .select("text", "top.label", "top.weight"))


def to_bags(sample: DataFrame, words: list[str]) -> DataFrame:
    """(label, weight, plain, hits): per document the number of sentences without a
    listed word, and the places of the listed words in each other sentence."""
    listed = {w: k for k, w in enumerate(words)}

    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, label, weight in zip(frame["text"], frame["label"], frame["weight"]):
                plain, others = sentences_with(text, listed)
                rows.append((label, weight, plain, [found for _, _, found in others]))
            if rows:
                yield pd.DataFrame(rows, columns=["label", "weight", "plain", "hits"])
    return sample.mapInPandas(bags, "label int, weight double, plain long, hits array<array<int>>")


def fit_bags(bags: list, n_words: int, steps: int = 300, rate: float = 0.1,
             penalty: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of the document labels
    under the noisy-or with a leak, by gradient steps over the sampled bags.
    Each bag counts by its ``weight``, if it has one."""
    if not bags:
        return np.zeros(n_words), -20.0
    y = np.array([b.label for b in bags], dtype=float)
    counts = np.array([getattr(b, "weight", 1.0) for b in bags])
    # where few bags are toxic, their words must not be outweighed by the number of the others
    penalty *= min(len(y) / 1000, (y > 0).sum() / 10)
    plain = np.array([b.plain for b in bags], dtype=float)
    sentences = [(d, h) for d, b in enumerate(bags) for h in b.hits]
    doc = np.array([d for d, _ in sentences], dtype=np.int64)
    of = np.repeat(np.arange(len(sentences)), [len(h) for _, h in sentences]).astype(np.int64)
    word = np.array([w for _, h in sentences for w in h], dtype=np.int64)
    params = np.zeros(n_words + 2)
    params[-2:] = -6.0, -3.0  # bias, leak
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        weights, bias, leak = params[:-2], params[-2], params[-1]
        z = bias + np.bincount(of, weights[word], minlength=len(sentences))
        p, p0, eps = _sigmoid(z), _sigmoid(bias), _sigmoid(leak)
        log_none = plain * np.log1p(-p0) + np.log1p(-eps)
        log_none += np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        none = np.exp(log_none)
        # d log-likelihood / d log_none; d log(1 - p) / dz is -p
        up = counts * np.where(y > 0, -none / np.maximum(1 - none, 1e-12), 1.0)
        dz = -p * up[doc]
        grad = np.zeros_like(params)
        grad[:-2] = np.bincount(word, dz[of], minlength=n_words) - penalty * weights
        grad[-2] = dz.sum() - (p0 * plain * up).sum()
        grad[-1] = -(eps * up).sum()
        grad /= len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return params[:-2], float(params[-2])


def train(docs: DataFrame, truth: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on a bounded sample of the labelled documents (``rows``). Only the
    sample's bags, a few numbers for each document, come to the driver."""
    sample, sample_at = materialise(sample_by_label(docs, truth, doc_id, text, label, rows), "toxicity-sample")
    words = listed_words(sample)
    weights, bias = fit_bags(to_bags(sample, words).collect() if words else [], len(words))
    discard(docs.sparkSession, sample_at)
    return ToxicityModel({w: k for k, w in enumerate(words)}, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",),
          cut: float = CUT) -> DataFrame:
    """The ``carry`` columns of every row with ``score`` (0 to 1), ``predicted``
    (1 from ``cut`` on) and ``offending``, the ``(start, end, score)`` in code
    points of the sentences that score at least ``cut``.

    Cases: a null or empty text has no sentence and scores 0; without labelled
    toxic documents nothing is toxic. Repeated rows are scored each for itself,
    an empty table gives an empty result, and columns other than ``text`` and
    ``carry`` are not looked at.
    """
    def rate(texts: pd.Series) -> dict:
        scores, places = np.zeros(len(texts)), []
        for k, value in enumerate(texts):
            plain, scored = model.sentence_scores(value or "")
            scores[k] = model.score(plain, scored)
            places.append([{"start": a, "end": b, "score": p} for a, b, p in scored if p >= cut])
        return {"score": scores, "predicted": (scores >= cut).astype("int32"), "offending": places}

    def make():
        worker_cache("no cache", dict)
        return rate

    return rate_texts(docs, text, carry, make, "score double, predicted int, "
                      "offending array<struct<start: int, end: int, score: double>>")


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """The model of the labels whose id's crc32 leaves a remainder other than
    0 modulo 5."""
    return train(docs, labels(spark, sf_dir).where(~held_out("doc_id", 5, 0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out("doc_id", 5, 0))
    rated = score(docs, trained(spark, docs, sf_dir), carry=("doc_id", "held_out"))
    first = F.get("offending", F.lit(0))
    return rated.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"),
                        first["start"].alias("first_start"), first["end"].alias("first_end"))
