"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from moodframe.session import local_table, scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

# A word is a run of anything but the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


# Rows of an Arrow batch. Spark's default of 10,000 is meant for narrow rows;
# of whole texts, a Python worker would hold tens of megabytes several times.
BATCH_ROWS = 1_000

_worker_caches: dict = {}


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get ``BATCH_ROWS`` rows at a time, unless the session
    has a setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(BATCH_ROWS))


def worker_cache(key, make: Callable):
    """What a Python worker keeps from one task to the next. Only the cache
    asked for last is kept, so that those of several operators never add up."""
    if key not in _worker_caches:
        _worker_caches.clear()
        _worker_caches[key] = make()
    return _worker_caches[key]


def release_memory() -> None:
    """Give back what a Python worker has freed. Workers stay for the tasks of
    later stages, and an executor's memory holds all of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id, written as text, leaves ``remainder``; a
    null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus) == F.lit(remainder)


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: the lineage ends there and lost executors re-read files that every
    machine sees. Returns the table and its path (for :func:`discard`)."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, str]:
    """``rows`` with ``idx``, their number from 0 in the given order.

    A range partitioning sorts them; a row's number is its place in its
    partition and the rows of the partitions before. Rows equal in ``order``
    are dealt by where they stand, so many of them do not meet in one task.
    """
    spark = rows.sparkSession
    keys = [*order, "tie"]
    placed = (rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
              .sortWithinPartitions(*keys).drop("tie").withColumn("spot", F.monotonically_increasing_id()))
    placed, at = materialise(placed, name)
    part = F.shiftright("spot", 33)
    counts = placed.groupBy(part.alias("part")).count().collect()  # one row a partition
    shifts, before = [], 0
    for part_no, n in sorted(tuple(r) for r in counts):
        shifts.append((part_no, before - (part_no << 33)))
        before += n
    shifts = local_table(spark, shifts, "part bigint, shift bigint")
    placed = placed.withColumn("part", part).join(F.broadcast(shifts), "part")
    return placed.withColumn("idx", F.col("spot") + F.col("shift")).drop("part", "spot", "shift"), at


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


# Keys with more than 1/HOT_SHARE of all rows are at most HOT_SHARE many,
# whatever the table's size; only those are broadcast.
HOT_SHARE = 2000


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``keyed``, one row for each key, where ``weight``
    counts the key's rows and ``total`` all of them. Rows of a hot key meet its
    broadcast row where they are; only the others are shuffled by key."""
    bound = F.lit(total / HOT_SHARE)
    hot = keyed.where(F.col(weight) > bound)
    in_hot = rows.join(F.broadcast(hot), on)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return in_hot.unionByName(others.join(keyed.where(F.col(weight) <= bound), on, how))


def keep_decided(docs: DataFrame, doc_id: str, keys: list[Column], decided: DataFrame, kept: str) -> DataFrame:
    """The rows of ``docs`` that ``decided`` keeps. Its columns are the id, the
    values of ``keys`` for the row and the flag ``kept``; a row is known by id
    and keys, and of rows that repeat both one stays for each one flagged.

    Only what goes is joined with the rows, so that the table of decisions is
    small where little goes.
    """
    id_col, *key_cols = [c for c in decided.columns if c != kept]
    rows = decided.groupBy(id_col, *key_cols).agg(
        F.count(F.lit(1)).alias("rows here"), F.sum(F.col(kept).cast("int")).alias("rows kept"))
    changed, _ = materialise(rows.where("`rows kept` < `rows here`"), "decided")
    named = {c: f"decided {c}" for c in [id_col, *key_cols]}

    def match(table: DataFrame, how: str) -> DataFrame:
        table = table.select(*[F.col(c).alias(n) for c, n in named.items()])
        same = F.col(doc_id).eqNullSafe(F.col(named[id_col]))
        for key, c in zip(keys, key_cols):
            same = same & (key == F.col(named[c]))
        return docs.join(table, same, how)

    out = match(changed, "left_anti")
    repeated = changed.where("`rows kept` > 0")
    if repeated.limit(1).count():
        some = match(repeated, "left_semi").withColumns({f"key {k}": key for k, key in enumerate(keys)})
        one = some.dropDuplicates([doc_id, *(f"key {k}" for k in range(len(keys)))])
        out = out.unionByName(one.select(*[F.col(f"`{c}`") for c in docs.columns]))
    return out


def sample_labelled(docs: DataFrame, truth: DataFrame, doc_id: str, text: str, label: str,
                    rows: int) -> DataFrame:
    """(text, label) of at most about ``rows`` labelled documents, drawn by a
    hash of the id, each distinct text once. The drawn labels are few enough
    to be sent to every task, so no text is shuffled to find them."""
    given = truth.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    given = given.groupBy(F.col(doc_id).alias("drawn_id")).agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, rows / max(1, given.count()))
    drawn = given.where(F.pmod(F.xxhash64("drawn_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = docs.select(F.col(doc_id).alias("drawn_id"), F.coalesce(text, F.lit("")).alias("text"))
    return (found.join(F.broadcast(drawn), "drawn_id").groupBy("text").agg(F.max("label").alias("label")))


def rate_texts(docs: DataFrame, text: str, carry: tuple[str, ...], make: Callable[[], Callable[[pd.Series], dict]],
               added: str) -> DataFrame:
    """The ``carry`` columns of every row and what ``make()``, called in each
    task, computes from a batch of texts. ``added`` is the schema of that. The carried
    columns stay in Arrow, so that values of any type come back as they are."""
    own = text in carry
    kept = docs.select(*carry) if own else docs.select(*carry, F.col(text).alias("text to rate"))
    schema = StructType(docs.select(*carry).schema.fields + StructType.fromDDL(added).fields)
    types = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(added))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = make()
        for batch in batches:
            at = carry.index(text) if own else len(carry)
            rated = rate(batch.column(at).to_pandas())
            columns = [*batch.columns[:len(carry)], *(pa.array(rated[name], type=kind, from_pandas=True) for name, kind in types.items())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        release_memory()

    return kept.mapInArrow(run, schema)
