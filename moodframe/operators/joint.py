"""Joint training of all heads on a shared representation (F1), one candidate an
epoch and the best of them (F3).

Words are hashed to ``buckets`` ids; a text is the mean of its words' rows of a
shared projection (``buckets`` x ``rank``), and each head is a softmax layer on
it. The loss is the sum of the heads' mean cross-entropies, so every head moves
the shared rows. A step takes one of the epoch's batches, which a seeded hash of
epoch and key deals: tasks add up the gradients of their rows, Spark adds those
of the tasks in blocks of the parameter vector, and only the sum, whose size is
the model's, reaches the driver for the update (Adam).

After each epoch the parameters are written as a candidate and the validation
loss is summed. Training ends when the loss has not fallen for ``patience``
epochs; the epoch with the lowest loss (ties: the earliest) is the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodframe.functions.hashing import DEFAULT_SEED, md5int
from moodframe.operators.models import LOSS_FLOOR, select_best_candidate
from moodframe.operators.prep import word_tokens
from moodframe.session import cut_lineage, publish_folder, scratch_dir

# Numbers of a gradient that are added as one row, and words that a task takes
# at once.
BLOCK = 1 << 14
WORDS_AT_ONCE = 200_000
# Tasks of a training step for each core.
TASKS_A_CORE = 3


@dataclass(frozen=True)
class JointSettings:
    buckets: int = 1 << 14
    rank: int = 24
    epochs: int = 6
    batches: int = 4
    patience: int = 2
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = DEFAULT_SEED


@dataclass
class JointModel:
    """Parameters: the projection, and weights and bias of each head."""

    labels: dict[str, list[str]]
    projection: np.ndarray
    weights: list[np.ndarray]
    bias: list[np.ndarray]
    buckets: int
    epoch: int = 0
    losses: DataFrame | None = field(default=None, repr=False, compare=False)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in [self.projection, *self.weights, *self.bias]])

    def with_flat(self, flat: np.ndarray, epoch: int) -> "JointModel":
        parts, at = [], 0
        for x in [self.projection, *self.weights, *self.bias]:
            parts.append(flat[at:at + x.size].reshape(x.shape))
            at += x.size
        n = len(self.labels)
        return JointModel(self.labels, parts[0], parts[1:n + 1], parts[n + 1:], self.buckets, epoch)


def new_model(labels: dict[str, list[str]], settings: JointSettings) -> JointModel:
    rng = np.random.RandomState(settings.seed % (1 << 32))
    return JointModel(labels, rng.normal(scale=0.1, size=(settings.buckets, settings.rank)),
                      [rng.normal(scale=0.1, size=(settings.rank, len(v))) for v in labels.values()],
                      [np.zeros(len(v)) for v in labels.values()], settings.buckets)


def hashed_words(text_col: str, buckets: int) -> Column:
    """The ids of a text's words, none for a null text."""
    return F.coalesce(F.transform(word_tokens(text_col), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")),
                      F.array().cast("array<int>"))


def label_codes(df: DataFrame, cols: list[str], labels: dict[str, list[str]]) -> list[Column]:
    """A code column ``y<i>`` for each head, whose labels ``cols`` hold: -1 where
    the label is null or unknown, or ``df`` has no such column."""
    return [(F.coalesce(F.array_position(F.array(*[F.lit(x) for x in v]), F.col(c).cast("string")), F.lit(0)) - 1).cast("int")
            .alias(f"y{i}") if c in df.columns and v else F.lit(-1).alias(f"y{i}") for i, (c, v) in enumerate(zip(cols, labels.values()))]


def hashed_rows(df: DataFrame, key_col: str, text_col: str, labels: dict[str, list[str]], buckets: int) -> DataFrame:
    """``key, words`` (ids) and a code column ``y<i>`` for each head."""
    return df.select(key_col, hashed_words(text_col, buckets).alias("words"), *label_codes(df, list(labels), labels))


def forward(model: JointModel, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean projection of each text, and each head's class probabilities."""
    lengths = np.diff(offsets)
    hidden = np.zeros((len(lengths), model.projection.shape[1]))
    full = lengths > 0
    if len(ids):
        hidden[full] = np.add.reduceat(model.projection[ids], offsets[:-1][full]) / lengths[full, None]
    out = []
    for w, b in zip(model.weights, model.bias):
        z = hidden @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf)) if len(b) else z
        out.append(e / e.sum(axis=1, keepdims=True) if len(b) else e)
    return hidden, out


def loss_and_gradient(model: JointModel, ids: np.ndarray, offsets: np.ndarray, codes: list[np.ndarray],
                      scale: list[float]) -> tuple[list[float], np.ndarray]:
    """Each head's summed cross-entropy, and the gradient of the sum of
    ``scale`` times it over the heads. Rows without a label of a head count
    nothing there."""
    lengths = np.diff(offsets)
    hidden, probabilities = forward(model, ids, offsets)
    to_hidden, to_weights, to_bias, losses = np.zeros_like(hidden), [], [], []
    for w, p, y, s in zip(model.weights, probabilities, codes, scale):
        known = np.flatnonzero(y >= 0)
        losses.append(float(-np.log(np.maximum(p[known, y[known]], LOSS_FLOOR)).sum()))
        d = np.zeros_like(p)
        d[known] = p[known]
        d[known, y[known]] -= 1.0
        d *= s
        to_weights.append(hidden.T @ d)
        to_bias.append(d.sum(axis=0))
        to_hidden += d @ w.T
    # a word that a text repeats is one row, added as often as it is there
    texts = max(1, len(lengths))
    pairs, n = np.unique(ids.astype(np.int64) * texts + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    word, of = pairs // texts, pairs % texts
    to_projection = np.zeros_like(model.projection)
    if len(pairs):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        share = to_hidden[of] * (n / np.maximum(lengths, 1)[of])[:, None]
        to_projection[word[first]] = np.add.reduceat(share, first, axis=0)
    return losses, np.concatenate([x.ravel() for x in [to_projection, *to_weights, *to_bias]])


def _parts(batch: pa.RecordBatch, heads: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], slice]]:
    """A batch in parts of a bounded number of words: ids, offsets and codes."""
    words = batch.column("words")
    offsets = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    ids = words.flatten().to_numpy(zero_copy_only=False)
    codes = [batch.column(f"y{i}").to_numpy(zero_copy_only=False) for i in range(heads)]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + WORDS_AT_ONCE, side="right")) - 1)
        yield ids[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], [c[a:b] for c in codes], slice(a, b)
        a = b


def summed_gradient(rows: DataFrame, model: JointModel, scale: list[float]) -> np.ndarray:
    """The gradient summed over all ``rows`` (:func:`hashed_rows`). Every task
    makes one vector of the model's size, in blocks; blocks are added before and
    after the shuffle, and the driver gets one row for each."""
    shared, heads = rows.sparkSession.sparkContext.broadcast((replace(model, losses=None), scale)), len(model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scale = shared.value
        total = None
        for batch in batches:
            for ids, offsets, codes, _ in _parts(batch, heads):
                _, gradient = loss_and_gradient(model, ids, offsets, codes, scale)
                total = gradient if total is None else total + gradient
        if total is not None:
            total = np.concatenate([total, np.zeros(-len(total) % BLOCK)]).reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["block", "part"])

    parts = rows.drop(rows.columns[0]).mapInArrow(run, "block int, part array<double>")
    added = parts.groupBy("block").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("total")).collect()
    out = np.zeros(-(-model.flat().size // BLOCK) * BLOCK)
    for r in added:
        out[r.block * BLOCK:(r.block + 1) * BLOCK] = r.total
    shared.unpersist()
    return out[:model.flat().size]


def mean_losses(rows: DataFrame, model: JointModel) -> DataFrame:
    """F2 of the model over ``rows``: ``head, loss``, the mean cross-entropy of
    the rows with a label, and their sum (``head = 'sum'``)."""
    shared, heads = rows.sparkSession.sparkContext.broadcast(replace(model, losses=None)), list(model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums, counts = shared.value, np.zeros(len(heads)), np.zeros(len(heads), dtype=np.int64)
        for batch in batches:
            for ids, offsets, codes, _ in _parts(batch, len(heads)):
                for i, (p, y) in enumerate(zip(forward(model, ids, offsets)[1], codes)):
                    known = np.flatnonzero(y >= 0)
                    sums[i] -= np.log(np.maximum(p[known, y[known]], LOSS_FLOOR)).sum()
                    counts[i] += len(known)
        yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(sums), pa.array(counts)], ["head", "loss", "n"])

    per_head = (rows.drop(rows.columns[0]).mapInArrow(run, "head string, loss double, n bigint")
                .groupBy("head").agg(F.try_divide(F.sum("loss"), F.sum("n")).alias("loss")))
    return per_head.unionByName(per_head.agg(F.sum("loss").alias("loss")).select(F.lit("sum").alias("head"), "loss"))


def predict_joint(df: DataFrame, key_col: str, text_col: str, model: JointModel) -> DataFrame:
    """``key, head, pred`` as the other models give it; a text without words has
    the class that the biases prefer."""
    rows = hashed_rows(df, key_col, text_col, model.labels, model.buckets)
    shared, heads = rows.sparkSession.sparkContext.broadcast(replace(model, losses=None)), list(model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, offsets, _, part in _parts(batch, len(heads)):
                keys = batch.column(0)[part]
                for h, p in zip(heads, forward(shared.value, ids, offsets)[1]):
                    labels = shared.value.labels[h]
                    best = [labels[k] for k in p.argmax(axis=1)] if labels else [None] * len(keys)
                    yield pa.RecordBatch.from_arrays([keys, pa.repeat(h, len(keys)), pa.array(best, pa.string())], [key_col, "head", "pred"])

    return rows.mapInArrow(run, f"`{key_col}` {rows.schema[key_col].dataType.simpleString()}, head string, pred string")


def save_candidate(model: JointModel, spark, path: str) -> None:
    """One candidate, published whole by a rename."""
    flat = model.flat()
    blocks = [(k // BLOCK, flat[k:k + BLOCK].tolist()) for k in range(0, len(flat), BLOCK)]
    table = spark.createDataFrame(blocks, "block int, part array<double>")
    publish_folder(spark, f"{path}/candidates/epoch={model.epoch}", lambda at: table.write.parquet(at))


def load_candidate(like: JointModel, spark, path: str, epoch: int) -> JointModel:
    rows = spark.read.parquet(f"{path}/candidates/epoch={epoch}").orderBy("block").collect()
    return like.with_flat(np.concatenate([r.part for r in rows]), epoch)


def train_joint_heads(train: DataFrame, validation: DataFrame, key_col: str, text_col: str, head_cols: list[str],
                      settings: JointSettings = JointSettings(), path: str | None = None) -> JointModel:
    """The best epoch's model. Its ``losses`` has a row for each epoch and head
    (``epoch, head, train_loss, loss, is_best``; ``loss`` is the validation's,
    epoch 0 is the start), and every epoch is a candidate below ``path``.

    Cases: null labels count nothing; a class that only the validation has is
    left out there; a text without words has a zero representation; without
    training rows the start is returned.
    """
    spark = train.sparkSession
    path = path or scratch_dir(spark, "joint-heads")
    own = {h: f"_y{i}" for i, h in enumerate(head_cols)}

    def hashed(df: DataFrame) -> DataFrame:
        # a text is read once: its words' ids and the labels as they are
        kept = cut_lineage(df.select(key_col, hashed_words(text_col, settings.buckets).alias("words"),
                                     *[F.col(h).cast("string").alias(c) for h, c in own.items() if h in df.columns]))
        # a task's gradient has the model's size: no more tasks than keep the cores busy
        tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
        return kept.coalesce(tasks) if kept.rdd.getNumPartitions() > tasks else kept

    texts, held = hashed(train), hashed(validation)
    seen = texts.agg(*[F.array_sort(F.collect_set(c)).alias(h) for h, c in own.items()]).first()
    labels = {h: list(seen[h]) for h in head_cols}
    rows, held = (df.select(key_col, "words", *label_codes(df, list(own.values()), labels)) for df in (texts, held))
    counts = rows.agg(*[F.sum((F.col(f"y{i}") >= 0).cast("long")).alias(f"y{i}") for i in range(len(labels))]).first()
    model = new_model(labels, settings)
    params, m, v, step = model.flat(), 0.0, 0.0, 0
    history: list[tuple] = []

    def note(at: JointModel) -> float:
        own = {r.head: r.loss for r in mean_losses(rows, at).collect()}
        for r in mean_losses(held, at).collect():
            history.append((at.epoch, r.head, own[r.head], r.loss))
        save_candidate(at, spark, path)
        return next((loss for epoch, head, _, loss in history[::-1] if head == "sum"), None) or 0.0

    best, since = note(model), 0
    for epoch in range(1, settings.epochs + 1):
        if not any(counts):
            break
        dealt = rows.withColumn("_b", F.pmod(md5int(F.lit(epoch), F.col(key_col), seed=settings.seed), F.lit(settings.batches)))
        for b in range(settings.batches):
            # each head's mean loss over a batch, with the batch's expected number of labels
            scale = [settings.batches / max(1, n) for n in counts]
            gradient = summed_gradient(dealt.where(F.col("_b") == b).drop("_b"), model.with_flat(params, epoch), scale)
            gradient += settings.decay * params
            step += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient * gradient
            params = params - settings.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        loss = note(model.with_flat(params, epoch))
        best, since = (loss, 0) if loss < best else (best, since + 1)
        if since >= settings.patience:
            break
    table = spark.createDataFrame(history, "epoch int, head string, train_loss double, loss double")
    flags = select_best_candidate(table.where("head = 'sum'"), "epoch").where("is_best").select(F.col("epoch").alias("best"))
    chosen = flags.first()
    out = load_candidate(model, spark, path, chosen.best if chosen else 0)
    out.losses = table.withColumn("is_best", F.col("epoch") == F.lit(out.epoch))
    return out
