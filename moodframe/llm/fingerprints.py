"""Document fingerprints by a randomised edit embedding.

All texts are walked with the same random bits: step j emits the character it
stands on and moves on if the bit of (j, character) is 1. Two walks that an
edit has drawn apart meet again soon, so texts at a small edit distance have
embeddings at a small Hamming distance. The walk covers the whole text.

A fingerprint samples the embedding at fixed steps: the first ``PER_SCALE``
steps, then as many from every doubling of the length, and keeps four hashed
bits of each. Its length grows with the logarithm of the text's. The likeness
of two fingerprints is the share of the longer embedding at which the samples
agree. Bands of samples tell which fingerprints are worth comparing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodframe.llm.common import documents, materialise
from moodframe.session import local_table

PER_SCALE = 64
SCALES = 40  # embeddings of up to 64 * 2**39 steps

# Random bits of the walk: period in steps, and classes of characters.
PERIOD = 4096
CLASSES = 256

# Characters that a task works on at once, positions that it walks at once, and
# the least number of texts for which vectors beat a plain loop.
CHARS_AT_ONCE = 6_000_000
POSITIONS_AT_ONCE = 1024
FEW_TEXTS = 40
PLAIN_POSITIONS = 1 << 16

# Samples in a band, and the likeness at which a candidate counts as the same.
PER_BAND = 8
SAME = 0.8


def _random_bytes(name: str, n: int) -> np.ndarray:
    return np.frombuffer(hashlib.shake_256(name.encode()).digest(n), dtype=np.uint8)


@cache
def _stays() -> np.ndarray:
    """Steps that a walk which reaches a character of class c at step j spends
    on it, at ``(j mod PERIOD) * CLASSES + c``."""
    moves = np.unpackbits(_random_bytes("walk", PERIOD * CLASSES // 8)).reshape(PERIOD, CLASSES)
    stays = np.zeros((2 * PERIOD + 1, CLASSES), dtype=np.int64)
    for j in range(2 * PERIOD - 1, -1, -1):
        stays[j] = np.where(moves[j % PERIOD] == 1, 1, stays[j + 1] + 1)
    return stays[:PERIOD].ravel()


@cache
def _stays_plain() -> bytes:
    return _stays().astype(np.uint8).tobytes()


@cache
def _samples() -> np.ndarray:
    """The sampled steps, ascending."""
    offsets = np.frombuffer(_random_bytes("samples", 8 * PER_SCALE * SCALES).tobytes(), dtype=np.uint64)
    parts = [np.arange(PER_SCALE, dtype=np.int64)]
    for scale in range(1, SCALES):
        width = 1 << (scale - 1)
        start = PER_SCALE * width + np.arange(PER_SCALE, dtype=np.int64) * width
        parts.append(start + (offsets[scale * PER_SCALE:][:PER_SCALE] % np.uint64(width)).astype(np.int64))
    return np.concatenate(parts)


@cache
def _weights() -> np.ndarray:
    """Steps that each sample stands for."""
    return np.repeat([1] + [1 << (scale - 1) for scale in range(1, SCALES)], PER_SCALE).astype(float)


@cache
def _symbols() -> np.ndarray:
    """Four bits for each sample (mod 256) and class."""
    return _random_bytes("symbols", 256 * CLASSES).reshape(256, CLASSES) & 15


def classes_of(text: str) -> np.ndarray:
    """A class for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return ((points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _sampled(at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbols of the samples between the first and the last step of ``at``,
    the steps at which the walk reaches each of ``classes`` and the next one."""
    first, last = np.searchsorted(_samples(), [at[0], at[-1]])
    position = np.searchsorted(at, _samples()[first:last], side="right") - 1
    return _symbols()[np.arange(first, last) % 256, classes[position]]


def _walk_plain(classes: np.ndarray, step: int) -> list[np.ndarray]:
    """The walk of one text from a step on, in a plain loop."""
    stays, found = _stays_plain(), []
    for k in range(0, len(classes), PLAIN_POSITIONS):
        part = classes[k:k + PLAIN_POSITIONS]
        at = np.fromiter(accumulate(part.tobytes(), lambda j, c: j + stays[(j % PERIOD) * CLASSES + c], initial=step),
                         dtype=np.int64, count=len(part) + 1)
        found.append(_sampled(at, part))
        step = int(at[-1])
    return found


def fingerprints(texts: list[str]) -> list[bytes]:
    """The samples of every text, a byte (0 to 15) each. Texts are walked side
    by side, a block of positions at a time; when few are left they are walked
    one by one."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    classes = [classes_of(texts[k]) for k in order]
    found: list[list[np.ndarray]] = [[] for _ in order]
    stays, step, start = _stays(), np.zeros(len(order), dtype=np.int64), 0
    while (left := sum(len(c) > start for c in classes)) >= FEW_TEXTS:
        block = np.zeros((left, POSITIONS_AT_ONCE), dtype=np.uint8)
        for k in range(left):
            part = classes[k][start:start + POSITIONS_AT_ONCE]
            block[k, :len(part)] = part
        columns = np.ascontiguousarray(block.T).astype(np.int64)
        at = np.empty((POSITIONS_AT_ONCE + 1, left), dtype=np.int64)
        at[0] = step[:left]
        spot = np.empty(left, dtype=np.int64)
        for p in range(min(POSITIONS_AT_ONCE, len(classes[0]) - start)):
            np.bitwise_and(at[p], PERIOD - 1, out=spot)
            np.multiply(spot, CLASSES, out=spot)
            np.add(spot, columns[p], out=spot)
            np.add(at[p], stays.take(spot), out=at[p + 1])
        at = np.ascontiguousarray(at.T)
        for k in range(left):
            n = min(POSITIONS_AT_ONCE, len(classes[k]) - start)
            found[k].append(_sampled(at[k, :n + 1], block[k]))
            step[k] = at[k, n]
        start += POSITIONS_AT_ONCE
    for k in range(left):
        found[k] += _walk_plain(classes[k][start:], int(step[k]))
    out = [b""] * len(texts)
    for k, parts in zip(order, found):
        out[k] = b"".join(p.tobytes() for p in parts)
    return out


def text_of(samples: bytes) -> str:
    """A hexadecimal digit for each sample."""
    return samples.hex()[1::2]


def likeness(a: bytes, b: bytes) -> float:
    """Share of the longer embedding at which the samples agree; 1 for two
    empty texts."""
    short, long = sorted((len(a), len(b)))
    if not long:
        return 1.0
    weights = _weights()[:long]
    same = np.frombuffer(a, np.uint8)[:short] == np.frombuffer(b, np.uint8)[:short]
    return float(weights[:short][same].sum() / weights.sum())


def bands(samples: bytes) -> set[tuple[int, bytes]]:
    """The keys under which a fingerprint is looked up: runs of ``PER_BAND``
    samples of its last two scales, or all samples where there are fewer. Texts
    that share none are no candidates."""
    if len(samples) < PER_BAND:
        return {(-1, samples)}
    last = (len(samples) // PER_BAND) * PER_BAND
    first = max(0, (last // PER_SCALE - 1) * PER_SCALE)
    return {(k, samples[k:k + PER_BAND]) for k in range(first, last, PER_BAND)}


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as much of the
    beginning of ``following``, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


ADDED = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
         "near_next double, bands_edited int, bands_next int, same_edited boolean, same_next boolean")


def compared(texts: list[str], following: list[str]) -> list[list]:
    """The values of ``ADDED`` for every text and the one that follows it, as
    columns."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    # the next text is as a rule the following row's own one
    own = {t: None for t in [*texts, *following]}
    samples = fingerprints([*own, *changed])
    own = dict(zip(own, samples))
    rows = []
    for text, after, new, new_samples in zip(texts, following, changed, samples[len(own):]):
        a, b = own[text], own[after]
        mine = bands(a)
        near = [likeness(a, new_samples), likeness(a, b)]
        shared = [len(mine & bands(new_samples)), len(mine & bands(b))]
        rows.append((len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), text_of(a), text_of(new_samples), *near, *shared,
                     *(bool(s and n >= SAME) for s, n in zip(shared, near))))
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in ADDED.split(",")]


def _decoded(texts: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()]


def _in_order(batches: Iterator[pa.RecordBatch], arrow_schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition (id, text) compared with the next row. The
    first row's text is passed on for the partition before, the last row is left
    open."""
    part = TaskContext.get().partitionId()
    ids, texts, begun = [], [], False

    def rows(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), type=f.type) for f in arrow_schema], schema=arrow_schema)

    def flush() -> pa.RecordBatch:
        n = len(texts) - 1
        values = compared(texts[:n], texts[1:])
        named = dict(zip((c.split()[0] for c in ADDED.split(", ")), values))
        out = rows({"id": ids[:n], "kind": ["row"] * n, "part": [part] * n} | named, n)
        del ids[:n], texts[:n]
        return out

    for batch in batches:
        ids += batch.column(0).to_pylist()
        texts += _decoded(batch.column(1))
        if texts and not begun:
            begun = True
            yield rows({"kind": ["first"], "part": [part], "text": [texts[0].encode("utf-8", "surrogatepass")]}, 1)
        if sum(map(len, texts)) >= CHARS_AT_ONCE:
            yield flush()
    if texts:
        yield flush()
        yield rows({"id": ids, "kind": ["open"], "part": [part], "text": [texts[0].encode("utf-8", "surrogatepass")]}, 1)


def _pairs(batches: Iterator[pa.RecordBatch], arrow_schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, following text) compared."""
    for batch in batches:
        values = compared(_decoded(batch.column(1)), _decoded(batch.column(2)))
        arrays = [batch.column(0), *(pa.array(v, type=f.type) for v, f in zip(values, list(arrow_schema)[1:]))]
        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow_schema)], schema=arrow_schema)


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text (the last half replaced
    by the beginning of the next document in descending order of id; after the
    last comes the first), and the likeness to the edited text's and the next
    document's fingerprints.

    Returns ``doc_id`` and the columns of ``ADDED``; ``bands_*`` counts the
    shared bands and ``same_*`` tells whether the two would be found as alike:
    a band is shared and the likeness is ``SAME`` or more.

    Cases: a null text is empty; an empty text has an empty fingerprint and a
    likeness of 1 to another empty one, 0 to others. Bytes that are not UTF-8
    count as replacement characters. Null ids come last; rows that repeat an id
    are ordered by a hash of the text, then by where they stand. A single row
    follows itself. An empty table gives an empty result. Other columns of
    ``docs`` are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    order = [F.col("id").desc_nulls_last(), "hash", "tie"]
    rows = (rows.withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
            .repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text"))
    kept = StructType([rows.schema["id"], *StructType.fromDDL(ADDED).fields])
    passed = StructType([*kept.fields, *StructType.fromDDL("kind string, part int, text binary").fields])
    arrow = to_arrow_schema(passed)
    done, _ = materialise(rows.mapInArrow(lambda batches: _in_order(batches, arrow), passed), "fingerprints", "zstd")
    # one number a partition: the last row of each meets the first of the next
    parts = sorted(r.part for r in done.where("kind = 'first'").select("part").collect())
    following = local_table(spark, list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    first = done.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    open_rows = done.where("kind = 'open'").join(F.broadcast(following), "part").join(first, "next_part")
    arrow_kept = to_arrow_schema(kept)
    linked = open_rows.select("id", "text", "next_text").mapInArrow(lambda batches: _pairs(batches, arrow_kept), kept)
    return done.where("kind = 'row'").select(*kept.names).unionByName(linked).withColumnRenamed("id", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return fingerprint_edits(documents(spark, sf_dir))
