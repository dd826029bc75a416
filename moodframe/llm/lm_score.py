"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts up to ``order`` bytes, counted over the
training documents. A byte is coded in its longest known context; where it was
never seen there, an escape is coded (method D) and the next shorter context
takes over, without the bytes that the longer one has ruled out. Below the
empty context all bytes that are left are equally likely.

The trie never is in one place. Documents are cut into chunks of some
megabytes; a chunk contributes its distinct runs of ``order + 1`` bytes, Spark
sums their counts, and the cost of every run is computed in groups that share
the last two context bytes, which hold all nodes of order two and more that a
cost depends on. Orders one and zero have at most 65,536 entries. Each chunk
then gets back the costs of its own runs, and of its own tokens for the
unigram base score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from moodframe.llm.common import ASCII_LOWER, documents, held_out, materialise, release_memory

ORDER = 5
CHUNK_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20
LOOK_UP_BYTES = 128 << 10  # packed
SPREAD = 2000
# Runs of bytes whose costs one task computes.
RUNS_PER_TASK = 300_000
# Never part of UTF-8: before a text, and after it. The latter is coded.
BEFORE, AFTER = 0xFE, 0xFF
SYMBOLS = 255


def runs_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts and one end each, the byte after its
    ``order`` predecessors, packed; and where each text's runs begin."""
    pad = bytes([BEFORE]) * order
    data = np.frombuffer(b"".join(part for t in texts for part in (pad, t, bytes([AFTER]))), dtype=np.uint8)
    packed = data[order:].astype(np.uint64)
    for k in range(1, order + 1):
        packed |= data[order - k:len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    return packed[data[order:] != BEFORE], starts


def blocks(texts: list[bytes], size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t) + 1
        if held >= size:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)


def count_runs(texts: list[bytes], training: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs and how often training texts hold each."""
    parts = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
    for wanted in (True, False):
        own = [t for t, w in zip(texts, training) if w == wanted]
        for a, b in blocks(own):
            runs, n = np.unique(runs_of(own[a:b], order)[0], return_counts=True)
            parts.append((runs, n if wanted else np.zeros(len(n), dtype=np.int64)))
    return _summed(parts)


def words_of(text: bytes) -> list[bytes]:
    """The tokens: words between ASCII white space, and the end, written as nothing."""
    return [*text.split(), b""]


# the trie


class _Level:
    """Contexts of one order: for each its training count and distinct bytes,
    and of each entry (context and byte) the count."""

    def __init__(self, entries: np.ndarray, counts: np.ndarray):
        self.entries, at = np.unique(entries, return_inverse=True)
        self.counts = np.bincount(at, counts, len(self.entries))
        self.contexts, self.of = np.unique(self.entries >> np.uint64(8), return_inverse=True)
        self.totals = np.bincount(self.of, self.counts, len(self.contexts))
        self.distinct = np.bincount(self.of, minlength=len(self.contexts))

    def count(self, entries: np.ndarray) -> np.ndarray:
        return _look_up(self.entries, self.counts, entries)

    def context(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _look_up(self.contexts, self.totals, contexts), _look_up(self.contexts, self.distinct, contexts)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return x & np.uint64((1 << (8 * n)) - 1)


def run_costs(runs: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, order: int) -> np.ndarray:
    """log10 of each run's probability. ``runs`` holds all runs whose last two
    context bytes are among theirs; ``pairs`` are all runs of two bytes."""
    levels = {}
    seen = counts > 0
    for k in range(order, 1, -1):
        levels[k] = _Level(_low_bytes(runs[seen], k + 1), counts[seen])
    levels[1] = _Level(pairs, pair_counts)
    levels[0] = _Level(_low_bytes(pairs, 1), pair_counts)
    cost, open_ = np.zeros(len(runs)), np.ones(len(runs), dtype=bool)
    for k in range(order, -1, -1):
        here = levels[k]
        total, distinct = here.context(_low_bytes(runs >> np.uint64(8), k))
        if k < order:  # what the next longer context ruled out
            above = levels[k + 1]
            ruled = np.bincount(above.of, here.count(_low_bytes(above.entries, k + 1)), len(above.contexts))
            contexts = _low_bytes(runs >> np.uint64(8), k + 1)
            total = total - _look_up(above.contexts, ruled, contexts)
            distinct = distinct - _look_up(above.contexts, above.distinct, contexts)
        n = here.count(_low_bytes(runs, k + 1))
        known = open_ & (distinct > 0)
        coded, escaped = known & (n > 0), known & (n == 0)
        cost[coded] += np.log10((2 * n[coded] - 1) / (2 * total[coded]))
        cost[escaped] += np.log10(distinct[escaped] / (2 * total[escaped]))
        open_ &= ~coded
    cost[open_] -= np.log10(SYMBOLS - len(levels[0].entries))
    return cost


# the jobs


def _to_chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """The rows with the number of the chunk that each is in: a task's rows in
    a row, up to ``chunk_bytes`` of text. The text, lower-cased, is packed: it
    is written once and shuffled once."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            numbers, packed = np.zeros(batch.num_rows, dtype=np.int64), []
            for k, text in enumerate(batch.column("text")):
                data = text.as_py().translate(ASCII_LOWER)
                if held and held + len(data) > chunk_bytes:
                    chunk, held = chunk + 1, 0
                held += len(data)
                numbers[k] = chunk
                packed.append(packer.compress(data))
            kept = [batch.column(c) for c in ("doc_id", "held_out", "training")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(packed, pa.binary()), pa.array(numbers)],
                                             ["doc_id", "held_out", "training", "text", "chunk"])
    return docs.mapInArrow(number, StructType(docs.schema.fields + [StructField("chunk", LongType())]))


def _counts(order: int, what: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        unpack = zstandard.ZstdDecompressor().decompress

        def done(chunk: int) -> pa.RecordBatch:
            parts = held.pop(chunk)
            if what == "runs":
                keys, n = _summed(parts)
                keys = pa.array(keys.view(np.int64))
            else:
                keys, n = pa.array(list(parts[0]), pa.binary()), np.fromiter(parts[0].values(), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), keys, pa.array(n)], ["chunk", "key", "n"])

        for batch in batches:
            chunks, training = batch.column("chunk").to_numpy(), batch.column("training").to_numpy(zero_copy_only=False)
            for chunk in np.unique(chunks).tolist():
                for old in [c for c in held if c != chunk]:
                    yield done(old)
                rows = np.flatnonzero(chunks == chunk)
                texts = [unpack(t) for t in batch.column("text").take(pa.array(rows)).to_pylist()]
                if what == "runs":
                    held[chunk] = [_summed(held.get(chunk, []) + [count_runs(texts, training[rows], order)])]
                    continue
                tally = held.setdefault(chunk, [{}])[0]
                for wanted in (True, False):
                    own: Counter = Counter()
                    for text, trains in zip(texts, training[rows]):
                        if trains == wanted:
                            own.update(words_of(text))
                    for word, n in own.items():
                        tally[word] = tally.get(word, 0) + (n if wanted else 0)
        for old in list(held):
            yield done(old)
        release_memory()
    return count


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held: str = "held_out",
              order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Score every document by a model of those that are not ``held`` out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``. ``score`` is the log10 probability of the text's bytes (A-Z
    lower-cased) and its end; ``base_score`` that of its tokens under smoothed
    token frequencies.

    Cases: a null or empty text has the end alone. Without training documents
    every byte costs the same and no token is known. Rows that repeat an id or
    a text count and are scored each for itself, and a null id stays null. An
    empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(held).alias("held_out"), (~F.col(held)).alias("training"),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    chunks, _ = materialise(_to_chunks(rows, chunk_bytes), "lm-chunks")
    held_in = chunks.select("chunk", "training", "text")

    # unigram counts of the chunks' tokens
    tokens = held_in.mapInArrow(_counts(order, "tokens"), "chunk long, key binary, n long")
    own = Window.partitionBy("key")
    tokens = tokens.select("chunk", "key", "n", F.sum("n").over(own).alias("c"),
                           (F.row_number().over(own.orderBy("chunk")) == 1).alias("once"))
    tokens, _ = materialise(tokens, "lm-tokens", compression="zstd")
    sums = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                      F.coalesce(F.sum((F.col("once") & (F.col("c") > 0)).cast("long")), F.lit(0)).alias("v")).first()

    # costs of the chunks' runs
    runs, _ = materialise(held_in.mapInArrow(_counts(order, "runs"), "chunk long, key long, n long"), "lm-runs", compression="zstd")
    totals, _ = materialise(runs.groupBy("key").agg(F.sum("n").alias("n")), "lm-totals")
    pair = F.col("key").bitwiseAND(0xFFFF)  # at most 65,536 rows
    pairs = totals.where("n > 0").groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).toPandas()
    pair_keys, pair_counts = pairs["pair"].to_numpy(dtype=np.uint64), pairs["n"].to_numpy(dtype=np.float64)
    groups = totals.count() // RUNS_PER_TASK + 1

    def cost(frame: pd.DataFrame) -> pd.DataFrame:
        found = run_costs(frame["key"].to_numpy().view(np.uint64), frame["n"].to_numpy(dtype=np.float64), pair_keys, pair_counts, order)
        out = pd.DataFrame({"key": frame["key"], "cost": found})
        release_memory()
        return out

    context = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    costs = totals.groupBy(F.pmod(F.xxhash64(context), F.lit(groups)).alias("group")).applyInPandas(cost, "key long, cost double")
    costs = runs.select("chunk", "key").join(costs, "key")

    known = tokens.select("chunk", F.lit(None).cast("long").alias("run"), F.col("key").alias("token"), F.col("c").cast("double").alias("value"))
    known = known.unionAll(costs.select("chunk", "key", F.lit(None).cast("binary"), "cost"))
    n_train, n_types = int(sums.n), int(sums.v)

    def score(own: pa.Table, given: pa.Table) -> pa.Table:
        is_token = given["token"].is_valid()
        runs_given, tokens_given = given.select(["run", "value"]).filter(pc.invert(is_token)), given.select(["token", "value"]).filter(is_token)
        del given
        keys = runs_given["run"].to_numpy().astype(np.int64, copy=False).view(np.uint64)
        sort = np.argsort(keys)
        keys, cost = keys[sort], runs_given["value"].to_numpy()[sort]
        del sort
        counts = dict(zip(tokens_given["token"].to_pylist(), tokens_given["value"].to_pylist()))
        del runs_given, tokens_given, is_token
        release_memory()
        packed, unpack = own["text"].to_pylist(), zstandard.ZstdDecompressor().decompress
        out = np.zeros((len(packed), 4))
        for a, b in blocks(packed, LOOK_UP_BYTES):
            texts = [unpack(bytes(t)) for t in packed[a:b]]
            runs, starts = runs_of(texts, order)
            distinct, at = np.unique(runs, return_inverse=True)  # in order, so that looking up is quick
            out[a:b, 3] = np.add.reduceat(cost[np.searchsorted(keys, distinct)][at], starts)
            for k, t in enumerate(texts, start=a):
                c = np.fromiter(map(counts.__getitem__, words_of(t)), dtype=np.float64)
                out[k, :3] = len(c), np.count_nonzero(c), np.log10(c + 1).sum() - len(c) * np.log10(n_train + n_types + 1)
        # ids stay in Arrow, where a null beside them changes nothing
        return pa.table([own["doc_id"], own["held_out"], *(pa.array(out[:, k].astype(np.int64)) for k in (0, 1)),
                         pa.array(np.full(len(out), n_train, dtype=np.int64)), pa.array(out[:, 2]), pa.array(out[:, 3])], names=schema.names)

    schema = StructType([chunks.schema["doc_id"], StructField("held_out", BooleanType())])
    for name in ("n_tokens", "n_known", "train_tokens"):
        schema.add(name, "long")
    schema.add("base_score", "double").add("score", "double")
    # a chunk is one group; where chunks are few, more partitions keep them apart
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(SPREAD, 4 * chunks.select("chunk").distinct().count()))
    return (chunks.select("chunk", "doc_id", "held_out", "text").repartition(parts, "chunk").groupBy("chunk")
            .cogroup(known.groupBy("chunk")).applyInArrow(score, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir).withColumn("held_out", held_out("doc_id", 7, 2)))
