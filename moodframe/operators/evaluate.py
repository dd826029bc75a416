"""Evaluation and relationship analytics.

Reports are long DataFrames (one row per head and class); every metric is a
conditional aggregate, computed for all heads in one pass over a long
``(head, y_true, y_pred)`` view of the results table. Running sums (ROC) are
taken on data pre-aggregated by score and spread over score-range buckets,
never in one global window over raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodframe.session import cut_lineage, local_table

ALL = "All"


def _nz_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 (the report's zero-division rule)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def results_long(results: DataFrame, pairs: list[tuple[str, str]],
                 head_names: list[str]) -> DataFrame:
    """``(head, y_true, y_pred)`` for each (true, pred) column pair."""
    arr = F.array(*[F.struct(F.lit(h).alias("head"), F.col(t).cast("string").alias("y_true"),
                             F.col(p).cast("string").alias("y_pred"))
                    for h, (t, p) in zip(head_names, pairs)])
    return results.select(F.inline(arr))


def outcome_counts(long: DataFrame) -> DataFrame:
    """``(head, y_true, y_pred, n)``: all reports follow from this small table.
    A table that has an ``n`` already is taken for one."""
    if "n" in long.columns:
        return long
    return long.groupBy("head", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def labels_present(long: DataFrame) -> DataFrame:
    """Sorted distinct labels in the truth, per head, with their rank."""
    d = long.where(F.col("y_true").isNotNull()).select("head", F.col("y_true").alias("label")).distinct()
    return d.withColumn("ordinal", (F.row_number().over(
        Window.partitionBy("head").orderBy("label")) - 1).cast("bigint"))


def confusion_matrix(long: DataFrame) -> DataFrame:
    """``(head, y_true, y_pred, n)`` zero-filled over the labels seen in
    truth or prediction. Label pairs are generated from the (small) label set
    of each head, not by joining rows."""
    counts = long.groupBy("head", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    labs = (long.select("head", F.explode(F.array("y_true", "y_pred")).alias("l"))
            .where(F.col("l").isNotNull())
            .groupBy("head").agg(F.array_sort(F.collect_set("l")).alias("ls")))
    grid = (labs.select("head", F.explode("ls").alias("y_true"), "ls")
            .select("head", "y_true", F.explode("ls").alias("y_pred")))
    return (grid.join(counts, ["head", "y_true", "y_pred"], "left")
            .select("head", "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def _per_class_counts(long: DataFrame) -> DataFrame:
    """``(head, label, tp, support, n_pred)`` for labels present in the truth."""
    counts = outcome_counts(long)
    by_true = counts.where(F.col("y_true").isNotNull()).groupBy("head", F.col("y_true").alias("label")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = counts.where(F.col("y_pred").isNotNull()).groupBy(
        "head", F.col("y_pred").alias("label")).agg(F.sum("n").alias("n_pred"))
    return (by_true.join(by_pred, ["head", "label"], "left")
            .select("head", "label", F.col("tp").cast("bigint"), F.col("support").cast("bigint"),
                    F.coalesce("n_pred", F.lit(0)).cast("bigint").alias("n_pred")))


def class_report(long: DataFrame) -> DataFrame:
    """Per head and class: precision, recall, F1 (``2tp/(2tp+fp+fn)``),
    support; 0 where a denominator is 0. Classes = labels in the truth."""
    c = _per_class_counts(long)
    return c.select("head", "label",
                    _nz_div(F.col("tp"), F.col("n_pred")).alias("precision"),
                    _nz_div(F.col("tp"), F.col("support")).alias("recall"),
                    _nz_div(2 * F.col("tp"), F.col("support") + F.col("n_pred")).alias("f1"),
                    "support")


def report_averages(long: DataFrame) -> DataFrame:
    """Per head ``accuracy`` (or ``micro avg`` when some prediction is
    outside the truth's label set), ``macro avg`` and ``weighted avg``.
    The accuracy row carries its value in ``f1`` (precision/recall null)."""
    counts = outcome_counts(long)
    rep = class_report(counts)
    cnt = _per_class_counts(counts)
    labels = counts.where(F.col("y_true").isNotNull()).select("head", F.col("y_true").alias("y_pred")).distinct()
    outside = (counts.where(F.col("y_pred").isNotNull()).join(labels, ["head", "y_pred"], "left_anti")
               .groupBy("head").agg(F.sum("n").alias("n_out")))
    tot = counts.groupBy("head").agg(
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("n_ok"), F.sum("n").alias("n"))
    micro = cnt.groupBy("head").agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("np"),
                                    F.sum("support").alias("ns"))
    head = tot.join(micro, "head").join(outside, "head", "left") \
        .withColumn("n_out", F.coalesce("n_out", F.lit(0)))
    acc = head.select(
        "head",
        F.when(F.col("n_out") == 0, F.lit("accuracy")).otherwise(F.lit("micro avg")).alias("avg"),
        F.when(F.col("n_out") == 0, F.lit(None).cast("double"))
        .otherwise(_nz_div(F.col("tp"), F.col("np"))).alias("precision"),
        F.when(F.col("n_out") == 0, F.lit(None).cast("double"))
        .otherwise(_nz_div(F.col("tp"), F.col("ns"))).alias("recall"),
        F.when(F.col("n_out") == 0, F.col("n_ok") / F.col("n"))
        .otherwise(_nz_div(2 * F.col("tp"), F.col("np") + F.col("ns"))).alias("f1"),
        F.col("ns").cast("bigint").alias("support"))
    agg = rep.groupBy("head").agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").cast("bigint").alias("support"))
    macro = agg.select("head", F.lit("macro avg").alias("avg"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"), "support")
    weighted = agg.select("head", F.lit("weighted avg").alias("avg"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), "support")
    return acc.unionByName(macro).unionByName(weighted)


def report_long(long: DataFrame) -> DataFrame:
    """The report as one table: class rows then the average rows."""
    counts = outcome_counts(long)
    rep = class_report(counts).select("head", F.col("label").alias("row"), "precision", "recall",
                                      "f1", "support")
    avg = report_averages(counts).select("head", F.col("avg").alias("row"), "precision", "recall",
                                       "f1", "support")
    return rep.unionByName(avg)


def relation(results: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """Share of each ``value_col`` within each ``group_col``
    (``value_counts(normalize=True)``); missing pairs are absent (null)."""
    c = (results.where(F.col(group_col).isNotNull() & F.col(value_col).isNotNull())
         .groupBy(group_col, value_col).agg(F.count(F.lit(1)).alias("n")))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group_col)))


def relation_filled(results: DataFrame, group_col: str, value_col: str,
                    values: list[str]) -> DataFrame:
    """Wide relation matrix with 0 for missing pairs (heatmap input)."""
    rel = relation(results, group_col, value_col)
    wide = rel.groupBy(group_col).pivot(value_col, values).agg(F.first("share"))
    return wide.na.fill(0.0, subset=values)


def class_distribution_compare(long: DataFrame, label_table: DataFrame) -> DataFrame:
    """True vs predicted count for every known label (``head, label``),
    0 where absent (decoded labels, so the counts line up)."""
    t = long.groupBy("head", F.col("y_true").alias("label")).agg(F.count(F.lit(1)).alias("n_true"))
    p = long.groupBy("head", F.col("y_pred").alias("label")).agg(F.count(F.lit(1)).alias("n_pred"))
    return (label_table.select("head", "label")
            .join(t, ["head", "label"], "left").join(p, ["head", "label"], "left")
            .select("head", "label", F.coalesce("n_true", F.lit(0)).cast("bigint").alias("n_true"),
                    F.coalesce("n_pred", F.lit(0)).cast("bigint").alias("n_pred")))


def top_predictions(results: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values (ties by value); a top-k report."""
    return (results.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col)).limit(k))


def categorical_histogram(results: DataFrame, col: str) -> DataFrame:
    """G11 (categorical): counts per category."""
    return results.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def numeric_histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """G11 (numeric): equal-width bins over [min, max], the max in the last
    bin, empty bins kept with 0. Only min/max/n reach the driver."""
    st = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = st["lo"], st["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin bigint, lo double, hi double, n bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


# Bins of a density curve, in bandwidths, and moments that a bin holds.
BIN_WIDTH = 0.25
MOMENTS = 14


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients of the Hermite polynomials He_0 to He_(terms - 1), constant
    term first: He_(j+1)(t) = t He_j(t) - j He_(j-1)(t)."""
    rows = [[1], [0, 1]]
    for j in range(1, terms - 1):
        low = rows[j - 1] + [0, 0]
        rows.append([a - j * b for a, b in zip([0, *rows[j]], low)])
    return rows[:terms]


def density_curve(df: DataFrame, col: str, points: int = 64) -> DataFrame:
    """Gaussian kernel density on a ``points`` grid over [min, max],
    Scott bandwidth ``h = s * n^(-1/5)``.

    Values are binned with a width of ``h / 4``; a bin keeps the sums of the
    powers of its values' distances from its centre, which tasks add up, so no
    value is shuffled. Around a centre the kernel is a series of Hermite
    polynomials in those powers: with ``m`` moments a density is off by at most
    ``1.09 / sqrt(m!) / 8^m`` of the kernel's height (1e-18 for 14), less than the
    rounding of a direct sum."""
    df = df.select(F.col(col).cast("double").alias(col))
    st = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.stddev_samp(col).alias("s"),
                F.count(col).alias("n")).first()
    lo, hi, s, n = st["lo"], st["hi"], st["s"], st["n"]
    spark = df.sparkSession
    if not n or not s:
        return spark.createDataFrame([], "point bigint, x double, density double")
    h = s * n ** (-0.2)
    step = (hi - lo) / (points - 1)
    place = (F.col(col).cast("double") - F.lit(lo)) / F.lit(h * BIN_WIDTH)
    bins = (df.where(F.col(col).isNotNull()).select(F.round(place).cast("bigint").alias("bin"), place.alias("place"))
            .withColumn("u", (F.col("place") - F.col("bin")) * F.lit(BIN_WIDTH))
            .groupBy("bin").agg(*[F.sum(F.pow("u", F.lit(j)) if j else F.lit(1.0)).alias(f"m{j}") for j in range(MOMENTS)]))
    # sum over j of He_j(t) m_j / j! as a polynomial in t
    hermite = _hermite(MOMENTS)
    polynomial = [sum((F.lit(hermite[j][k] / math.factorial(j)) * F.col(f"m{j}") for j in range(k, MOMENTS) if hermite[j][k]), F.lit(0.0))
                  for k in range(MOMENTS)]
    at = bins.select("bin", *[p.alias(f"p{k}") for k, p in enumerate(polynomial)],
                     F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    t = F.col("point") * F.lit(step / h) - F.col("bin") * F.lit(BIN_WIDTH)
    value = F.lit(0.0)
    for k in reversed(range(MOMENTS)):
        value = value * F.col("t") + F.col(f"p{k}")
    # a kernel further away than 40 bandwidths is 0
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    sums = at.withColumn("t", t).groupBy("point").agg(
        (F.sum(F.when(F.abs("t") < 40, value * F.exp(-0.5 * F.col("t") * F.col("t"))).otherwise(0.0)) * norm).alias("density"))
    return sums.select(F.col("point").cast("bigint").alias("point"), (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"), "density")


def crosstab_margins(results: DataFrame, row_col: str, col_col: str) -> DataFrame:
    """``(row, col, n)`` counts with an ``All`` row and column, from a
    CUBE with ``grouping_id``."""
    c = results.cube(row_col, col_col).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return c.select(
        F.when(F.col("g").bitwiseAND(2) > 0, F.lit(ALL)).otherwise(F.col(row_col)).alias("row"),
        F.when(F.col("g").bitwiseAND(1) > 0, F.lit(ALL)).otherwise(F.col(col_col)).alias("col"),
        F.col("n").cast("bigint"))


def crosstab_normalised(results: DataFrame, row_col: str, col_col: str) -> DataFrame:
    """Each row's counts divided by the row total (true shares); the
    ``All`` row is kept, the ``All`` column dropped."""
    m = crosstab_margins(results, row_col, col_col)
    tot = m.where(F.col("col") == ALL).select("row", F.col("n").alias("_t"))
    return (m.where(F.col("col") != ALL).join(tot, "row")
            .select("row", "col", (F.col("n") / F.col("_t")).alias("share")))


def error_matrix(cm: DataFrame) -> DataFrame:
    """``1 - n / row_total`` over the zero-filled confusion matrix; a row
    without truth gives null."""
    tot = F.sum("n").over(Window.partitionBy("head", "y_true"))
    return cm.select("head", "y_true", "y_pred",
                     (F.lit(1.0) - F.col("n") / F.nullif(tot, F.lit(0))).alias("error"))


# Values that a task turns into sums at once.
VALUES_AT_ONCE = 1 << 21


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of numeric columns
    (pairwise-complete), long form ``(a, b, corr)``.

    Tasks sum products as matrices: for each column its counts, sums, squares and
    products over the rows where the other column has a value too. One row a
    column and task is shuffled, so hundreds of columns are one job. Values are
    taken from the column's smallest one, which keeps the sums small. As in an
    aggregate of pairs, fewer than two rows give null and a constant gives NaN."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    width = len(cols)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    least = rows.agg(*[F.coalesce(F.min(c), F.lit(0.0)).alias(c) for c in rows.columns]).first()
    shift = np.array([0.0 if math.isnan(v) or math.isinf(v) else v for v in least])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, 4, width))
        step = max(1, VALUES_AT_ONCE // max(1, width))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                have = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns], axis=1).astype(float)
                x = np.stack([pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in part.columns], axis=1)
                x = np.where(have > 0, x - shift, 0.0)
                for k, (left, right) in enumerate(((have, have), (x, have), (x * x, have), (x, x))):
                    sums[:, k] += left.T @ right
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(sums.reshape(width, -1)), pa.list_(pa.float64()))],
                                         ["i", "sums"])

    parts = rows.mapInArrow(run, "i int, sums array<double>").groupBy("i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    at = lambda k: F.get("sums", F.col("j") + F.lit(k * width))
    pairs = parts.select("i", "sums", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j")).select(
        "i", "j", at(0).alias("n"), at(1).alias("s"), at(2).alias("q"), at(3).alias("p"))
    other = pairs.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("t"), F.col("q").alias("r"))
    n = F.col("n")
    spread = (n * F.col("q") - F.col("s") * F.col("s")) * (n * F.col("r") - F.col("t") * F.col("t"))
    corr = F.when(n >= 2, F.when(spread > 0, (n * F.col("p") - F.col("s") * F.col("t")) / F.sqrt(spread)).otherwise(F.lit(float("nan"))))
    names = F.array(*[F.lit(c) for c in cols])
    return (pairs.where("i <= j").join(other, ["i", "j"])
            .select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), corr.alias("corr")))


def running_totals_desc(df: DataFrame, order_col: str, value_cols: list[str],
                        buckets: int = 1024) -> DataFrame:
    """Cumulative sums of ``value_cols`` in descending ``order_col`` order,
    for a table with one row per distinct ``order_col``.

    Rows are split into equal-depth buckets of the order column (approximate
    quantiles, then a binary-search ``Bucketizer``), so scores crowded into a
    narrow range still spread over ``buckets`` tasks. Bucket totals give each
    bucket's offset (a window over at most ``buckets`` rows) and the running
    sum is finished inside each bucket. No single window over all rows."""
    from pyspark.ml.feature import Bucketizer

    probs = [i / buckets for i in range(1, buckets)]
    qs = df.agg(F.percentile_approx(F.col(order_col).cast("double"), probs, 10 * buckets)
                .alias("q")).first()["q"] or []
    splits = [float("-inf")] + sorted({float(q) for q in qs if q is not None}) + [float("inf")]
    b = Bucketizer(splits=splits, inputCol="_ord", outputCol="_b", handleInvalid="keep").transform(
        df.withColumn("_ord", F.col(order_col).cast("double"))).drop("_ord")
    tot = b.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    before = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                              for c in value_cols])
    inner = Window.partitionBy("_b").orderBy(F.desc(order_col)).rowsBetween(
        Window.unboundedPreceding, 0)
    out = b.join(F.broadcast(offs), "_b")
    for c in value_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.sum(c).over(inner))
    return out.drop("_b", *[f"_o_{c}" for c in value_cols])


def roc_points(scored: DataFrame, score_col: str, label_col: str) -> DataFrame:
    """Pre-aggregated ROC steps: one row per distinct score with positives,
    negatives and their cumulative sums (descending score)."""
    agg = (scored.where(F.col(score_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(score_col).cast("double").alias("threshold"))
           .agg(F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                F.sum(F.when(F.col(label_col) == 1, 0).otherwise(1)).cast("bigint").alias("neg")))
    # read for the quantiles, the totals and the sums: the input runs once
    return running_totals_desc(cut_lineage(agg), "threshold", ["pos", "neg"])


def roc_curve(scored: DataFrame, score_col: str, label_col: str) -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score (all points are
    kept), plus the origin with a null threshold; positive class = 1."""
    pts = roc_points(scored, score_col, label_col)
    p_n = pts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = p_n["P"] or 0, p_n["N"] or 0
    spark = scored.sparkSession
    origin = local_table(spark, [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    steps = pts.select("threshold",
                       (F.col("cum_neg") / F.lit(float(N) if N else float("nan"))).alias("fpr"),
                       (F.col("cum_pos") / F.lit(float(P) if P else float("nan"))).alias("tpr"))
    return origin.unionByName(steps)


def roc_auc(scored: DataFrame, score_col: str, label_col: str) -> DataFrame:
    """Trapezoid area under the ROC curve, as the sum over score groups
    of ``neg_g * (positives ranked above + pos_g / 2) / (P N)``."""
    pts = roc_points(scored, score_col, label_col)
    return pts.agg(
        (F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0))
         / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def pair_moments_by_class(df: DataFrame, class_col: str, cols: list[str]) -> DataFrame:
    """G19 (moments): per class and numeric pair: n, means, sample std devs and
    covariance (pairwise-complete)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        aggs += [F.count(x).cast("bigint").alias(f"n{k}"), F.avg(x).alias(f"mean_a{k}"), F.avg(y).alias(f"mean_b{k}"),
                 F.stddev_samp(x).alias(f"std_a{k}"), F.stddev_samp(y).alias(f"std_b{k}"), F.covar_samp(x, y).alias(f"cov{k}")]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[
        F.col(f"{c}{k}").alias(c) for c in ("n", "mean_a", "mean_b", "std_a", "std_b", "cov")]) for k, (a, b) in enumerate(pairs)])
    return df.groupBy(class_col).agg(*aggs).select(class_col, F.inline(rows)).where("n > 0")


def pair_bins_by_class(df: DataFrame, class_col: str, a: str, b: str, bins: int = 10) -> DataFrame:
    """G19 (2-D bins): per class, counts of equal-width (a, b) bins."""
    st = df.agg(F.min(a).alias("alo"), F.max(a).alias("ahi"),
                F.min(b).alias("blo"), F.max(b).alias("bhi")).first()

    def bin_of(c, lo, hi):
        w = (hi - lo) / bins if hi is not None and hi > lo else 1.0
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("bigint")

    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(class_col, bin_of(a, st["alo"], st["ahi"]).alias("bin_a"),
                     bin_of(b, st["blo"], st["bhi"]).alias("bin_b"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))
