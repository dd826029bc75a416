"""Quality scores from random Fourier features over document statistics.

Statistics of a text's characters, words and lines are standardised and mapped
to random cosines, whose products approximate a Gaussian kernel. Ridge weights
solve the normal equations, which every partition sums for its own rows, and
isotonic regression turns the fitted values into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.llm.common import discard, documents, held_out, labels, materialise, rate_texts, sample_labelled

# Bounds of the model: labelled rows that it is fitted on, and features.
SAMPLE_ROWS = 20_000
COMPONENTS = 256
SEED = 9
RIDGE = 1.0
CUT = 0.3
# Fitted values are calibrated in steps of this size between -1 and 2.
STEP = 1e-3

_CLASS = np.full(256, 5)  # other bytes: control characters
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[list(range(97, 123))] = 1
_CLASS[list(range(65, 91))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
_CLASS[list(b".,;:?!'\"()-")] = 6
_CLASS[128:] = 7


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one text; an empty one has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(len(STATISTICS))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    share = np.bincount(_CLASS, counts, minlength=8) / len(data)
    used = counts[counts > 0] / len(data)
    words = data.split()
    n_words = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=float, count=len(words)) if words else np.zeros(1)
    lines = data.split(b"\n")
    distinct_lines = set(lines)
    n_distinct = len(set(words))
    starts = np.array([_CLASS[w[0]] for w in words] or [0])
    ends = np.array([_CLASS[w[-1]] for w in words] or [0])
    single = (sizes == 1).mean()
    return np.array([
        np.log1p(len(data)), *np.sqrt(share[[0, 2, 3, 4, 5, 6, 7]]), share[2] / max(share[1] + share[2], 1e-9),
        -(used * np.log2(used)).sum(), sizes.mean(), sizes.std(), np.log1p(sizes.max()), single,
        np.log(max(n_distinct, 1)) / max(np.log(n_words + 1), 1e-9), np.log1p(len(lines)), np.log1p(n_words / len(lines)),
        1 - len(distinct_lines) / len(lines), (ends == 4).mean(), (ends == 6).mean(), (starts == 2).mean(), (starts == 4).mean(),
        counts[ord("!")] / n_words, counts[ord("|")] / n_words, counts[ord(".")] / n_words,
        sum(map(bytes.__eq__, words, words[1:])) / n_words])


STATISTICS = (
    "log_bytes", "space", "upper", "digit", "symbol", "control", "punctuation", "non_ascii", "upper_of_letters",
    "byte_entropy", "word_mean", "word_deviation", "log_longest_word", "single_byte_words", "distinct_words", "log_lines",
    "log_words_a_line", "repeated_lines", "ends_in_symbol", "ends_in_punctuation", "starts_upper", "starts_with_symbol",
    "exclamations", "bars", "full_stops", "repeats_word_before")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random cosines of the standardised statistics, and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -4, 4)
        cosines = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([cosines, np.ones((len(stats), 1))])

    def fitted(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, -1, 2)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.fitted(stats), self.steps, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step values nearest to the means ``y`` with counts
    ``n`` at increasing ``x``: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for k in range(len(x)):
        blocks.append([y[k] * n[k], n[k], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, count, size = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + count, blocks[-1][2] + size]
    levels = np.concatenate([np.full(int(size), total / count) for total, count, size in blocks])
    return x, np.clip(levels, 0.0, 1.0)


def to_statistics(rows: DataFrame) -> DataFrame:
    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"label": frame["label"], "stats": [statistics(t) for t in frame["text"]]})
    return rows.mapInPandas(measure, "label int, stats array<double>")


def train(docs: DataFrame, truth: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = SAMPLE_ROWS, components: int = COMPONENTS, seed: int = SEED, ridge: float = RIDGE) -> QualityModel:
    """Fit on a bounded sample of the labelled documents, drawn by a hash of
    the id (each distinct text once). What the partitions sum, matrices of the
    features' size, is all that comes to the driver."""
    spark = docs.sparkSession
    sample = sample_labelled(docs, truth, doc_id, text, label, rows)
    # the sample is bounded, and so are the partitions that sum
    stats, stats_at = materialise(to_statistics(sample).coalesce(32), "quality-statistics")
    d = len(STATISTICS)
    moments = stats.select(F.count(F.lit(1)).alias("n"), *[
        f(F.get("stats", F.lit(k))).alias(f"{name}{k}") for k in range(d) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments.n:
        discard(spark, stats_at)
        return QualityModel(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(2), np.zeros(1), np.full(1, 0.5))
    mean = np.array([moments[f"m{k}"] for k in range(d)])
    scale = np.maximum([moments[f"s{k}"] for k in range(d)], 1e-6)
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, components)),
                         rng.uniform(0, 2 * np.pi, components), np.zeros(components + 1), np.zeros(1), np.zeros(1))

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((components + 1, components + 2))
        for frame in frames:
            z = model.features(np.stack(frame["stats"])) if len(frame) else np.zeros((0, components + 1))
            gram += z.T @ np.column_stack([z, frame["label"].to_numpy(dtype=float)])
        yield pd.DataFrame({"row": np.arange(components + 1), "sums": list(gram)})

    summed = (stats.mapInPandas(equations, "row int, sums array<double>")
              .select("row", F.posexplode("sums").alias("col", "value"))
              .groupBy("row", "col").agg(F.sum("value").alias("value")).collect())
    gram = np.zeros((components + 1, components + 2))
    for r in summed:
        gram[r.row, r.col] = r.value
    penalty = ridge * np.eye(components + 1)
    penalty[-1, -1] = 0
    weights = np.linalg.solve(gram[:, :-1] + penalty + 1e-9 * np.eye(components + 1), gram[:, -1])
    model = QualityModel(mean, scale, model.directions, model.phases, weights, model.steps, model.levels)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                at = np.rint(model.fitted(np.stack(frame["stats"])) / STEP).astype(np.int64)
                yield pd.DataFrame({"at": at, "label": frame["label"]})

    # at most 3 / STEP rows, however many documents there are
    pairs = (stats.mapInPandas(fit, "at long, label int").groupBy("at")
             .agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("at").collect())
    discard(spark, stats_at)
    steps, levels = isotonic(np.array([p["at"] for p in pairs]) * STEP, np.array([p.y for p in pairs]), np.array([p.n for p in pairs]))
    return QualityModel(mean, scale, model.directions, model.phases, weights, steps, levels)


def score(docs: DataFrame, model: QualityModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",),
          cut: float = CUT) -> DataFrame:
    """The ``carry`` columns of every row with ``score`` (0 to 1) and
    ``predicted`` (1 from ``cut`` on).

    Cases: a null or empty text is scored by its statistics, zeros; without
    labelled documents every score is 0.5. Repeated rows are scored each for
    itself, an empty table gives an empty result, and columns other than
    ``text`` and ``carry`` are not looked at.
    """
    def rate(texts: pd.Series) -> dict:
        scores = model.score(np.stack([statistics(t) for t in texts])) if len(texts) else np.zeros(0)
        return {"score": scores, "predicted": (scores >= cut).astype("int32")}

    return rate_texts(docs, text, carry, lambda: rate, "score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out("doc_id", 5, 0))
    model = train(docs, labels(spark, sf_dir).where(~held_out("doc_id", 5, 0)))
    return score(docs, model, carry=("doc_id", "held_out"))
