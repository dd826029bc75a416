"""Class distribution and balancing.

Sampling is defined by a seeded md5 hash of ``(seed, class, draw)`` and of
row keys, so results depend on the data only, never on partitioning or task
order. Rows with a null class are not part of any class (as in a per-class
filter) and are left out of balanced outputs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodframe.functions.hashing import DEFAULT_SEED, md5int
from moodframe.operators.keyed import dense_index
from moodframe.operators.neighbours import CELL_ROWS, nearest_in_class
from moodframe.session import cut_lineage

# Draw rows generated per block row (bounds one generator's output).
DRAW_BLOCK = 100_000
# Buckets of hashes, as a power of two, by which a class is cut.
CUT_BITS = 16
# Largest expected multiplicity of one (class, row) join key before it is salted.
SALT_TARGET = 10_000


def class_counts(df: DataFrame, class_col: str) -> DataFrame:
    """Rows per class, nulls dropped, by count desc then class."""
    return (df.where(F.col(class_col).isNotNull()).groupBy(class_col)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(class_col)))


def max_class_count(df: DataFrame, class_cols: list[str]) -> DataFrame:
    """Size of the biggest class, one row per column."""
    parts = [class_counts(df, c).agg(F.max("n").alias("max_n"))
             .select(F.lit(c).alias("column"), "max_n") for c in class_cols]
    return reduce(DataFrame.unionByName, parts)


def distinct_classes(df: DataFrame, class_col: str, order_col: str) -> DataFrame:
    """D3: distinct values in first-appearance order (``order_col`` is the row
    position, e.g. the post key)."""
    first = (df.where(F.col(class_col).isNotNull()).groupBy(class_col)
             .agg(F.min(order_col).alias("first_seen")))
    return first.withColumn("ordinal", F.row_number().over(
        Window.orderBy("first_seen", class_col)).cast("bigint") - 1)


def class_filter(df: DataFrame, class_col: str, value) -> DataFrame:
    """Rows of one class."""
    return df.where(F.col(class_col) == F.lit(value))


def union_classes(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by column name (UNION ALL)."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def _class_sizes(df: DataFrame, class_col: str) -> DataFrame:
    return df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n_c"))


def oversample(df: DataFrame, class_col: str, key_cols: list[str], target: int | None = None,
               seed: int = DEFAULT_SEED, draw_col: str = "draw",
               buckets: int | None = None) -> DataFrame:
    """Bootstrap every class with replacement to ``target`` rows (default:
    the biggest class' size).

    Draw ``k`` of class ``c`` takes the row at dense index
    ``md5int(seed, c, k) % n_c`` (rows indexed by the hash of their key).
    Draws are generated in blocks spread over the cluster; a small class whose
    rows are drawn many times is salted (its rows replicated ``s_c`` times and
    draws spread over the copies), so no join key carries more than about
    ``SALT_TARGET`` draws. Output: the input columns plus ``draw_col``.
    """
    src = df.where(F.col(class_col).isNotNull())
    keyed = src.withColumn("_h", md5int(F.lit("row"), *key_cols, seed=seed))
    indexed = dense_index(keyed, [class_col], "_h", key_cols, "_idx", buckets).drop("_h")
    sizes = _class_sizes(src, class_col)
    if target is None:
        tgt = F.max("n_c").over(Window.partitionBy(F.lit(1)))
    else:
        tgt = F.lit(int(target)).cast("bigint")
    sizes = sizes.withColumn("_t", tgt).withColumn(
        "_salt", F.greatest(
            F.lit(1).cast("bigint"),
            F.ceil(F.col("_t") / (F.col("n_c") * F.lit(SALT_TARGET))).cast("bigint")))
    draws = _draw_rows(sizes, class_col, "_t", draw_col).select(
        class_col, draw_col,
        F.pmod(md5int(F.col(class_col), F.col(draw_col), seed=seed), F.col("n_c")).alias("_idx"),
        F.pmod(F.col(draw_col), F.col("_salt")).alias("_s"))
    rows = _salted_rows(indexed, sizes, class_col)
    return draws.join(rows, [class_col, "_idx", "_s"]).drop("_idx", "_s")


def balance_two_pass(df: DataFrame, first_col: str, second_col: str, key_cols: list[str],
                     seed: int = DEFAULT_SEED) -> DataFrame:
    """Oversample by ``first_col`` to its max class size, then the result by
    ``second_col`` to the max ``second_col`` class size measured *before* the
    first pass. Row keys of pass 1 are ``(first_col, draw1)``.

    Both passes draw keys and classes only. The first is written once. The
    other columns are joined to the result on the key and a salt, of as many
    values as keep a row that is drawn very often out of one task."""
    rest = [c for c in df.columns if c not in (first_col, second_col, *key_cols)]
    payload, df = df.select(*key_cols, *rest), df.select(*key_cols, first_col, second_col)
    target2 = _class_sizes(df.where(F.col(second_col).isNotNull()), second_col) \
        .agg(F.max("n_c").alias("t"))
    p1 = cut_lineage(oversample(df, first_col, key_cols, seed=seed, draw_col="draw1"))
    # the pass-2 target is a one-row aggregate; it is attached through the
    # size table inside ``oversample`` by passing it as a literal
    t2 = target2.first()["t"] or 0
    out = oversample(p1, second_col, [first_col, "draw1"], target=t2, seed=seed,
                     draw_col="draw2")
    return _join_drawn(out, payload, key_cols) if rest else out


def _join_drawn(drawn: DataFrame, payload: DataFrame, key_cols: list[str]) -> DataFrame:
    """Join draws to their rows' other columns. A row that is drawn more than
    ``SALT_TARGET`` times is repeated, and its draws are dealt over the copies."""
    drawn = cut_lineage(drawn)
    often = (drawn.groupBy(*key_cols).agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_TARGET)).cast("int").alias("_copies"))
             .where("_copies > 1"))
    # at most one row for each SALT_TARGET draws
    drawn = drawn.join(often, key_cols, "left").withColumn(
        "_s", F.pmod(F.xxhash64("draw2"), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    payload = payload.join(often, key_cols, "left").withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return drawn.join(payload, [*key_cols, "_s"]).drop("_s")



def shuffle_reindex(df: DataFrame, key_cols: list[str], seed: int = DEFAULT_SEED,
                    out_col: str = "row_idx", buckets: int | None = None) -> DataFrame:
    """Seeded random order with a new dense 0-based index, computed by hash
    range buckets (no single-partition window)."""
    h = df.withColumn("_h", md5int(F.lit("shuffle"), *key_cols, seed=seed)) \
        .withColumn("_all", F.lit(0))
    return dense_index(h, ["_all"], "_h", key_cols, out_col, buckets).drop("_h", "_all")


def undersample(df: DataFrame, class_col: str, key_cols: list[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Every class cut to the smallest class' size, without replacement,
    keeping the rows with the smallest seeded hash (ties by key, which is unique).

    Counts by class and hash bucket show in which bucket each class' last kept
    row lies; only that bucket is ranked. What cuts the rows is then a comparison
    with one value a class, and no row is moved for it."""
    src = df.where(F.col(class_col).isNotNull())
    keyed = src.withColumn("_h", md5int(F.lit("under"), *key_cols, seed=seed))
    narrow = cut_lineage(keyed.select(class_col, "_h", *key_cols).withColumn("_bkt", F.shiftright("_h", 60 - CUT_BITS)))
    counts = cut_lineage(narrow.groupBy(class_col, "_bkt").agg(F.count(F.lit(1)).alias("_n")))
    smallest = counts.groupBy(class_col).agg(F.sum("_n").alias("n")).agg(F.min("n")).first()[0] or 0
    upto = F.sum("_n").over(Window.partitionBy(class_col).orderBy("_bkt"))
    last = (counts.withColumn("_upto", upto).where((F.col("_upto") >= smallest) & (F.col("_upto") - F.col("_n") < smallest))
            .select(class_col, "_bkt", (F.lit(int(smallest)) - F.col("_upto") + F.col("_n")).alias("_need")))
    order = ["_h", *key_cols]
    ranked = narrow.join(last, [class_col, "_bkt"]).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(class_col).orderBy(*order)))
    cuts = cut_lineage(ranked.where(F.col("_rank") == F.col("_need")).select(class_col, F.struct(*order).alias("_cut")))
    # one row a class
    return keyed.join(F.broadcast(cuts), class_col).where(F.struct(*order) <= F.col("_cut")).select(*df.columns)


def balance_before_after(before: DataFrame, after: DataFrame, class_cols: list[str]) -> DataFrame:
    """``(column, class, n_before, n_after)`` for each class column, 0 where
    a class is absent on one side."""
    parts = []
    for c in class_cols:
        b = class_counts(before, c).select(F.col(c).alias("class"), F.col("n").alias("n_before"))
        a = class_counts(after, c).select(F.col(c).alias("class"), F.col("n").alias("n_after"))
        parts.append(b.join(a, "class", "full").select(
            F.lit(c).alias("column"), "class",
            F.coalesce("n_before", F.lit(0)).cast("bigint").alias("n_before"),
            F.coalesce("n_after", F.lit(0)).cast("bigint").alias("n_after")))
    return reduce(DataFrame.unionByName, parts)


def class_weights(df: DataFrame, class_col: str) -> DataFrame:
    """Balanced weights ``n / (n_classes * n_c)``."""
    sizes = class_counts(df, class_col)
    all_w = Window.partitionBy(F.lit(1))
    return sizes.select(
        class_col, "n",
        (F.sum("n").over(all_w) / (F.count(F.lit(1)).over(all_w) * F.col("n"))).alias("weight"))


def class_count_check(df: DataFrame, class_col: str, expected: int, weights: DataFrame | None = None,
                      strict: bool = False) -> DataFrame:
    """Data-quality rows ``(check, expected, actual, ok)``: number of
    classes and (optionally) number of weights. ``strict`` raises on failure
    inside the job (``raise_error``)."""
    n_cls = df.where(F.col(class_col).isNotNull()).agg(
        F.countDistinct(class_col).alias("actual")).select(
        F.lit(f"n_classes({class_col})").alias("check"),
        F.lit(int(expected)).cast("bigint").alias("expected"), F.col("actual").cast("bigint"))
    parts = [n_cls]
    if weights is not None:
        parts.append(weights.agg(F.count(F.lit(1)).alias("actual")).select(
            F.lit("n_weights").alias("check"), F.lit(int(expected)).cast("bigint").alias("expected"),
            F.col("actual").cast("bigint")))
    out = reduce(DataFrame.unionByName, parts).withColumn("ok", F.col("expected") == F.col("actual"))
    if strict:
        out = out.withColumn("ok", F.when(F.col("ok"), F.col("ok")).otherwise(
            F.raise_error(F.concat(F.lit("class count check failed: "), F.col("check")))))
    return out


def _draw_rows(sizes: DataFrame, class_col: str, count_col: str, draw_col: str) -> DataFrame:
    """``(class, n_c, _salt, draw)`` for draws ``0..count-1`` of each class,
    generated in blocks of ``DRAW_BLOCK`` spread over the cluster."""
    n_blocks = F.ceil(F.col(count_col) / F.lit(DRAW_BLOCK)).cast("bigint")
    blocks = (sizes.where(F.col(count_col) > 0)
              .select(class_col, "n_c", "_salt", count_col,
                      F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)).alias("_blk"))
              .repartition(class_col, "_blk"))
    lo = F.col("_blk") * DRAW_BLOCK
    hi = F.least(lo + DRAW_BLOCK, F.col(count_col)) - 1
    return blocks.select(class_col, "n_c", "_salt", F.explode(F.sequence(lo, hi)).alias(draw_col))


def _salted_rows(indexed: DataFrame, sizes: DataFrame, class_col: str) -> DataFrame:
    return (indexed.join(sizes.select(class_col, "_salt"), class_col)
            .withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salt") - 1)))
            .drop("_salt"))


def synthetic_oversample(df: DataFrame, class_col: str, key_cols: list[str], vec_col: str,
                         seed: int = DEFAULT_SEED, draw_col: str = "k",
                         buckets: int | None = None, neighbours: int = 5,
                         min_recall: float = 0.9, cell_rows: int = CELL_ROWS) -> DataFrame:
    """D10 (SMOTE): grow every class to the biggest class' size with synthetic
    vectors ``x + u (y - x)``. ``x`` (base) is a row of the class picked by a
    seeded hash of ``(class, k)``, ``y`` (partner) one of its ``neighbours``
    nearest rows of the class, picked by another hash, ``u`` in [0, 1) a third.

    Neighbours come from :func:`nearest_in_class`: exact for classes of one
    cell, else with a measured recall of at least ``min_recall``; only rows that
    are a base are looked up. A class of one row is its own partner. Base and
    partner are fetched by two salted equi-joins on ``(class, dense index)``;
    output columns: class, draw, base key, partner key, ``u`` and the synthetic
    vector ``vec_col``. Rows with a null class or vector take no part.
    """
    src = df.where(F.col(class_col).isNotNull() & F.col(vec_col).isNotNull())
    keyed = src.withColumn("_h", md5int(F.lit("row"), *key_cols, seed=seed))
    indexed = cut_lineage(dense_index(keyed, [class_col], "_h", key_cols, "_idx", buckets)
                          .select(class_col, "_idx", *key_cols, vec_col))
    sizes = _class_sizes(src, class_col).withColumn(
        "_need", F.max("n_c").over(Window.partitionBy(F.lit(1))) - F.col("n_c"))
    sizes = sizes.withColumn("_salt", F.greatest(F.lit(1).cast("bigint"), F.ceil(
            F.col("_need") / (F.col("n_c") * F.lit(SALT_TARGET))).cast("bigint")))
    draws = _draw_rows(sizes, class_col, "_need", draw_col).select(
        class_col, draw_col,
        F.pmod(md5int(F.lit("base"), F.col(class_col), F.col(draw_col), seed=seed), F.col("n_c"))
        .alias("_bi"),
        md5int(F.lit("partner"), F.col(class_col), F.col(draw_col), seed=seed).alias("_pick"),
        (md5int(F.lit("u"), F.col(class_col), F.col(draw_col), seed=seed).cast("double")
         / F.lit(float(1 << 60))).alias("u"),
        F.pmod(F.col(draw_col), F.col("_salt")).alias("_s"))
    near = nearest_in_class(indexed.select(class_col, F.col("_idx").alias("idx"), F.col(vec_col).alias("vec")), class_col,
                            draws.select(class_col, F.col("_bi").alias("idx")), neighbours, min_recall, cell_rows)
    near = cut_lineage(near.found.withColumnRenamed("idx", "_idx"))
    rows = _salted_rows(indexed, sizes, class_col)
    # only bases have neighbours, and they are salted with their rows
    base = _salted_rows(indexed.join(near, [class_col, "_idx"], "left"), sizes, class_col).select(
        class_col, F.col("_idx").alias("_bi"), "_s",
        *[F.col(k).alias(f"base_{k}") for k in key_cols], F.col(vec_col).alias("_x"), "neighbours")
    partner = rows.select(class_col, F.col("_idx").alias("_pi"), "_s",
                          *[F.col(k).alias(f"partner_{k}") for k in key_cols],
                          F.col(vec_col).alias("_y"))
    among = F.size("neighbours")
    picked = F.when(F.col("neighbours").isNull(), F.col("_bi")).otherwise(
        F.get("neighbours", F.pmod(F.col("_pick"), among).cast("int")))
    out = draws.join(base, [class_col, "_bi", "_s"]).withColumn("_pi", picked).join(partner, [class_col, "_pi", "_s"])
    synth = F.zip_with("_x", "_y", lambda a, b: a.cast("double") + F.col("u") * (b.cast("double")
                                                                                 - a.cast("double")))
    return out.select(class_col, draw_col, *[f"base_{k}" for k in key_cols],
                      *[f"partner_{k}" for k in key_cols], "u", synth.alias(vec_col))
