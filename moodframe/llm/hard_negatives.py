"""Hard negatives from embeddings: for every anchor and each of its positives
the best rows of another label whose score lies in a window below the
positive's score.

The windows of one anchor overlap. The upper limits of its positives split the
scores into disjoint slots, a row falls into one slot only, and the k best rows
of each slot are all that any window can need: the window of the i-th positive
is the slots from the i-th on, in descending order, up to k rows and down to
its lower limit.

Anchors are taken in blocks of a bounded size. For a block every task reads
its rows in small batches, scores them in one matrix product and keeps the k
best for each anchor and slot; only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodframe.llm.common import discard, materialise, numbered
from moodframe.session import scratch_dir, table

# A block's anchors are collected and sent to every task: at most so many, and
# at most so many numbers in their vectors.
BLOCK_ANCHORS = 4096
BLOCK_NUMBERS = 1 << 20
# Scores that a task holds at once.
SCORES_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Rule:
    """How many positives and negatives, and the window: a negative's score in
    hundredths lies between ``low`` and ``high`` times the positive's, where
    0 <= low <= high."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def usable(vectors: DataFrame, vec_id: str, label: Column, vector: str) -> DataFrame:
    """``id, label, vector`` of the rows that take part, components as
    ``floor(256 * x)``."""
    def broken(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vectors.select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("vector")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", broken)).withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * 256)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices, the narrower one
    filled up with zeros. In floating point where that is exact; products beyond
    64 bits wrap."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * width < 2.0 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors as rows, short ones filled up with zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


@dataclass
class Block:
    """Anchors of a block. ``upper`` has their slots' upper limits in
    descending order and ``lower`` the least score that any window of a slot
    takes; both are None while positives are looked for, which are one slot."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    upper: np.ndarray | None = None
    lower: np.ndarray | None = None

    @property
    def slots(self) -> int:
        return 1 if self.upper is None else self.upper.shape[1]


class Best:
    """The ``k`` best rows so far for each anchor and slot: higher scores
    first, ties by smaller id."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.found = np.empty((4, 0), dtype=np.int64)  # anchor, slot, score, id
        least = np.iinfo(np.int64).min
        self.least = np.full((len(block.ids), block.slots), least) if block.lower is None else block.lower.copy()

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        block = self.block
        scores = product(block.vectors, vectors)
        fits = block.labels[:, None] == labels
        if block.upper is not None:
            fits = ~fits & (scores <= block.upper[:, :1])
        fits &= (scores >= self.least.min(axis=1)[:, None]) & (block.ids[:, None] != ids)
        anchor, row = np.nonzero(fits)
        score = scores[anchor, row]
        slot = np.zeros_like(anchor)
        if block.upper is not None:
            slot = (score[:, None] <= block.upper[anchor]).sum(axis=1) - 1
        good = score >= self.least[anchor, slot]
        new = np.stack([anchor[good], slot[good], score[good], ids[row[good]]])
        if not new.size:
            return
        every = np.concatenate([self.found, new], axis=1)
        every = every[:, np.lexsort((every[3], -every[2], every[1], every[0]))]
        key = every[0] * block.slots + every[1]
        first = np.searchsorted(key, key)
        place = np.arange(len(key)) - first
        self.found = every[:, place < self.k]
        full = place == self.k - 1
        self.least[every[0][full], every[1][full]] = every[2][full]

    def add_all(self, batch: pa.RecordBatch) -> None:
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        at_once = max(1, SCORES_AT_ONCE // max(1, len(self.block.ids)))
        for k in range(0, len(ids), at_once):
            self.add(ids[k:k + at_once], labels[k:k + at_once], matrix(batch.column("vector").slice(k, at_once)))


def best_rows(rows: DataFrame, block: Block, k: int) -> DataFrame:
    """``anchor, slot, score, id`` of the ``k`` best rows for each anchor and
    slot. Tasks keep their own ``k`` best; a window over those finds the best
    of all."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value, k)
        for batch in batches:
            best.add_all(batch)
        anchor, slot, score, row = best.found
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shared.value.ids[anchor], slot, score, row)],
                                         ["anchor", "slot", "score", "id"])

    own = rows.mapInArrow(run, "anchor bigint, slot bigint, score bigint, id bigint")
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return own.withColumn("place", place).where(F.col("place") <= k)


def with_windows(block: Block, positives: list, rule: Rule) -> Block:
    """The block with the slots that its positives (place, anchor, score) make.
    Positives that an anchor lacks, or whose score is negative (their window is
    empty), make none."""
    none = np.iinfo(np.int64).min + 1
    upper = np.full((len(block.ids), rule.positives), none)
    lower = np.full((len(block.ids), rule.positives), np.iinfo(np.int64).max)
    at = {a: k for k, a in enumerate(block.ids.tolist())}
    for p in positives:
        if p.score >= 0:
            upper[at[p.anchor], p.place - 1] = high_of(p.score, rule)
            lower[at[p.anchor], p.place - 1] = low_of(p.score, rule)
    return Block(block.ids, block.labels, block.vectors, upper, lower)


def high_of(score: int, rule: Rule) -> int:
    return rule.high * score // 100


def low_of(score: int, rule: Rule) -> int:
    return -(-rule.low * score // 100)


def windows_of(slots: DataFrame, positives: DataFrame, rule: Rule) -> DataFrame:
    """The windows' rows: of each anchor's slots, in descending order, those
    from the positive's on, up to the rule's number and down to the window's
    lower limit. An anchor has ``positives * negatives`` slot rows at most."""
    in_order = F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "id")))
    merged = positives.join(slots.groupBy("anchor").agg(in_order.alias("rows")), "anchor")
    taken = F.slice(F.filter("rows", lambda r: (r["slot"] >= F.col("place") - 1)
                             & (rule.low * F.col("score") <= -100 * r["down"])
                             & (-100 * r["down"] <= rule.high * F.col("score"))), 1, rule.negatives)
    return merged.select("anchor", F.col("id").alias("positive"), "score", F.posexplode(taken).alias("k", "row")).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"),
        (F.col("k") + 1).cast("int").alias("rank"), F.col("row.id").alias("negative_id"),
        F.col("score").alias("positive_score"), (-F.col("row.down")).alias("negative_score"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, rule: Rule = Rule(), vec_id: str = "vec_id",
                   label: Column | str = "label", vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` for every anchor, each of its positives (the best rows of
    its label) and that positive's negatives.

    ``is_anchor`` is a condition on the column ``id``. Scores are inner products
    of the components' ``floor(256 * x)``, ties go to the smaller id.

    Cases: rows with a null id, label, vector or component, or a component that
    is not finite, take no part. Vectors of other lengths are filled up with
    zeros (an empty one scores 0). Of rows that repeat an anchor's id the one
    with the smallest label, then vector, is the anchor, and none is a partner
    of it; rows that repeat another id take part each. An anchor without
    positives, or without rows in a window, has no result row there. Other
    columns of ``vectors`` are not looked at. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows, rows_at = materialise(usable(vectors, vec_id, F.col(label) if isinstance(label, str) else label, vector), "negatives-rows")
    anchors, anchors_at = numbered(
        rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("best")).select("id", "best.*"),
        ["id"], "negatives-anchors")
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    per_block = max(1, min(BLOCK_ANCHORS, BLOCK_NUMBERS // max(1, size.width or 1)))
    out, schema = scratch_dir(spark, "negatives-result"), None
    for first in range(0, max(1, size.n), per_block):
        drawn = anchors.where(F.col("idx").between(first, first + per_block - 1)).orderBy("idx").collect()
        block = Block(np.array([a.id for a in drawn], dtype=np.int64), np.array([a.label for a in drawn], dtype=np.int64),
                      matrix(pa.array([a.vector for a in drawn], pa.list_(pa.int64()))))
        positives, positives_at = materialise(best_rows(rows, block, rule.positives), "negatives-positives")
        block = with_windows(block, positives.select("place", "anchor", "score").collect(), rule)
        found = windows_of(best_rows(rows, block, rule.negatives), positives, rule)
        schema = found.schema
        found.write.parquet(f"{out}/block-{first}")
        discard(spark, positives_at)
    discard(spark, rows_at, anchors_at)
    return spark.read.schema(schema).parquet(f"{out}/block-*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; anchors are the rows whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                  CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM pos p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
