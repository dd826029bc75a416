"""Keyed dense index: ``0..n-1`` inside each class, in the order of a 60-bit
hash (ties by key), without one window over a whole class.

Rows are range-bucketed on the hash's high bits, so buckets follow the hash
order. A small ``(class, bucket) -> count`` table gives each bucket its
offset (a running sum over at most ``buckets`` rows per class) and the row
number is taken inside ``(class, bucket)`` only. A hot class is therefore
spread over ``buckets`` window partitions, whose number follows from the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodframe.session import cut_lineage, local_table


HASH_SPACE = 1 << 60
# Rows that one window partition numbers, and the least number of buckets.
ROWS_PER_BUCKET = 50_000
MIN_BUCKETS = 1024


def dense_index(df: DataFrame, class_cols: list[str], hash_col: str, tie_cols: list[str],
                out_col: str = "idx", buckets: int | None = None) -> DataFrame:
    """Add ``out_col`` = rank (0-based) of the row inside its class by
    ``(hash_col, *tie_cols)``. ``hash_col`` must be a BIGINT in [0, 2^60)."""
    if buckets is None:  # as many as keep a bucket small, whatever the size
        buckets = max(MIN_BUCKETS, df.count() // ROWS_PER_BUCKET)
    width = HASH_SPACE // buckets + 1
    b = df.withColumn("_bkt", F.expr(f"`{hash_col}` div {width}"))
    counts = b.groupBy(*class_cols, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*class_cols).orderBy("_bkt").rowsBetween(
        Window.unboundedPreceding, -1)
    offs = counts.select(*class_cols, "_bkt",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    joined = b.join(offs, class_cols + ["_bkt"])
    inner = Window.partitionBy(*class_cols, "_bkt").orderBy(hash_col, *tie_cols)
    return (joined.withColumn(out_col, (F.col("_off") + F.row_number().over(inner) - 1)
                              .cast("bigint"))
            .drop("_bkt", "_off"))


# A key with more than 1/FREQUENT_SHARE of all occurrences is frequent; there are
# at most so many of them, whatever the table's size.
FREQUENT_SHARE = 2000
# Rows of frequent keys are dealt over so many keys of their own.
SPREAD = 4096
# Names of the join's own columns, which no table uses.
KEY, OFTEN, RARE, VALUE = ("frequent join: " + c for c in ("key", "often", "rare", "value"))


def join_frequent(rows: DataFrame, table: DataFrame, key: str, count: str, spread_by: str) -> DataFrame:
    """LEFT join of ``rows`` with ``table``, one row for each non-null ``key`` (a
    string), where ``count`` says how often a key occurs. The result has the
    columns of ``rows`` and those of ``table`` but for ``count``.

    Rows of frequent keys meet their broadcast row where they are, and go on
    under salted keys, so that no key has many rows in the shuffle join of the
    others. Rows without a key are salted too. One pass over ``rows``."""
    values = [c for c in table.columns if c not in (key, count)]
    total = table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first().n
    bound, packed = F.lit(float(total) / FREQUENT_SHARE), F.struct(*values)
    often = table.where(F.col(count) > bound).select(key, packed.alias(OFTEN))
    others = table.where(F.col(count) <= bound).select(F.col(key).alias(KEY), packed.alias(RARE))
    salt = F.concat(F.lit("\0"), F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("string"))
    met = rows.join(F.broadcast(often), key, "left").withColumn(
        KEY, F.when(F.col(OFTEN).isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(salt))
    joined = met.join(others, KEY, "left").withColumn(VALUE, F.coalesce(F.col(OFTEN), F.col(RARE)))
    return joined.select(*rows.columns, *[F.col(VALUE)[c].alias(c) for c in values])


def global_index(df: DataFrame, order: list[Column], out_col: str = "idx") -> DataFrame:
    """Add ``out_col``, the rows' number from 0 in the given order (of distinct
    values). A range partitioning sorts the rows; a row's number is its place in
    its partition and the rows of the partitions before, so no window spans more
    than a partition. The result is checkpointed."""
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_spot", F.monotonically_increasing_id()))
    part = F.shiftright("_spot", 33)
    counts = placed.groupBy(part.alias("part")).count().collect()  # one row a partition
    shifts, before = [], 0
    for number, n in sorted(tuple(r) for r in counts):
        shifts.append((number, before - (number << 33)))
        before += n
    shifts = local_table(df.sparkSession, shifts, "_part bigint, _shift bigint")
    return (placed.withColumn("_part", part).join(shifts, "_part")
            .withColumn(out_col, F.col("_spot") + F.col("_shift")).drop("_part", "_spot", "_shift"))
