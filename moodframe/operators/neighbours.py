"""Nearest neighbours inside a class (the index behind D10).

Every class is cut into cells around centroids, as many as keep a cell at
about ``CELL_ROWS`` rows (``MAX_CELLS`` in all). A row is stored in its nearest
cell and looks for neighbours in its nearest ``probes`` cells. Cells and the
queries that probe them are split into chunks, so that neither a hot class nor a
crowded cell is one task, and two rows only meet where a cell is probed. A
class of one cell is searched whole.

How many cells to probe follows from the data: for a bounded sample of queries
the answer is compared with the one from all cells, and probes are doubled until
the share of true neighbours found reaches ``min_recall`` with two standard
errors to spare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from moodframe.session import cut_lineage

# Rows of a cell, and the most cells there are: their centroids go to every
# task (16 MB of 128 numbers each).
CELL_ROWS = 2048
MAX_CELLS = 16_384
# Rows and queries that meet in one group.
CHUNK = 8192
FIRST_PROBES = 4
# Queries whose recall is measured.
MEASURED = 400
# Distances computed at once.
AT_ONCE = 1 << 21


@dataclass
class Neighbours:
    """``found`` has a row for each query (``class_col, idx``) with
    ``neighbours``, the indexes of the nearest other rows of its class, nearest
    first; ``recall`` is what was measured with ``probes`` cells (1.0 where every
    class is one cell)."""

    found: DataFrame
    recall: float
    probes: int


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def _matrix(vectors) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.zeros((0, 1))
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def _with_cells(rows: DataFrame, class_col: str, centroids: dict, probes: int) -> DataFrame:
    """``rows`` with ``cells``, the nearest ``probes`` cells of their class,
    nearest first."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("cells array<int>").fields])
    arrow = to_arrow_schema(schema)
    at_class, at_vec = rows.columns.index(class_col), rows.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            classes, cells = batch.column(at_class).to_pylist(), [[0]] * batch.num_rows
            for c in set(classes) & known.keys():
                at = np.array([i for i, x in enumerate(classes) if x == c])
                vectors = _matrix(batch.column(at_vec).take(pa.array(at)))
                step = max(1, AT_ONCE // len(known[c]))
                for k in range(0, len(at), step):
                    near = np.argsort(squared_distances(vectors[k:k + step], known[c]), axis=1, kind="stable")[:, :probes]
                    for i, row in zip(at[k:k + step], near.tolist()):
                        cells[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, arrow.field("cells").type)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _best(queries: pa.Table, rows: pa.Table, k: int, schema: pa.Schema, class_col: str) -> pa.Table:
    """The ``k`` nearest ``rows`` of each query, itself left out."""
    out = [[], [], [], []]
    if queries.num_rows and rows.num_rows:
        ids = rows["idx"].to_numpy()
        order = np.argsort(ids)  # ties go to the smaller index
        ids, vectors = ids[order], _matrix(rows["vec"])[order]
        wanted, own = _matrix(queries["vec"]), queries["idx"].to_numpy()
        step = max(1, AT_ONCE // len(ids))
        for at in range(0, len(own), step):
            d = np.round(squared_distances(wanted[at:at + step], vectors), 9)
            d[own[at:at + step, None] == ids] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            far = np.take_along_axis(d, near, axis=1)
            q, place = np.nonzero(np.isfinite(far))
            out[1].append(own[at + q])
            out[2].append(ids[near[q, place]])
            out[3].append(far[q, place])
    columns = [np.concatenate(c) if c else np.zeros(0) for c in out[1:]]
    label = pa.repeat(queries[class_col][0], len(columns[0])) if queries.num_rows else pa.nulls(0, schema.field(0).type)
    return pa.Table.from_arrays([label, *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)


def _search(index: DataFrame, counts: DataFrame, queries: DataFrame, class_col: str, k: int, chunk: int) -> DataFrame:
    """``class_col, idx, neighbours`` for queries with ``cells``. Rows of
    ``index`` have their ``cell``; ``counts`` has the cells' rows (``n``)."""
    probing = queries.select(class_col, "idx", "vec", F.explode("cells").alias("cell"))
    asked = probing.groupBy(class_col, "cell").agg(F.count(F.lit(1)).alias("asked"))
    # one row a cell, of which there is a fixed number besides the classes
    parts = F.broadcast(counts.join(asked, [class_col, "cell"]).select(
        class_col, "cell", F.ceil(F.col("n") / chunk).cast("int").alias("row_parts"),
        F.ceil(F.col("asked") / chunk).cast("int").alias("query_parts")))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """A row's own part by its hash, and one copy for each part of the other side."""
        return (rows.join(parts, [class_col, "cell"])
                .withColumn(own, F.pmod(F.xxhash64("idx"), F.col(f"{own}s")).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
                .select(class_col, "cell", "row_part", "query_part", "idx", "vec"))

    keys = [class_col, "cell", "row_part", "query_part"]
    left, right = dealt(probing, "query_part", "row_part"), dealt(index.select(class_col, "cell", "idx", "vec"), "row_part", "query_part")
    schema = StructType([index.schema[class_col], *StructType.fromDDL("idx bigint, other bigint, distance double").fields])
    arrow = to_arrow_schema(schema)
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda q, r: _best(q, r, k, arrow, class_col), schema)
    place = F.row_number().over(Window.partitionBy(class_col, "idx").orderBy("distance", "other"))
    near = met.withColumn("place", place).where(F.col("place") <= k)
    return near.groupBy(class_col, "idx").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]).alias("neighbours"))


def nearest_in_class(rows: DataFrame, class_col: str, queries: DataFrame | None = None, k: int = 5, min_recall: float = 0.9,
                     cell_rows: int = CELL_ROWS, chunk: int = CHUNK, probes: int = FIRST_PROBES) -> Neighbours:
    """The ``k`` nearest other rows of the same class, by squared distance (to 9
    decimals, ties to the smaller index), for each of ``queries`` (``class_col,
    idx``; default: all rows).

    ``rows`` are ``class_col, idx, vec``: ``idx`` counts from 0 in each class, in
    an order that does not depend on the vectors (:func:`dense_index` by a
    hash), so that the first rows of a class are a sample of it. Vectors of a
    class have one length and no nulls. Where a class has fewer than ``k`` other
    rows, the list is shorter; a class of one row has no row in ``found``.
    """
    rows = cut_lineage(rows.select(class_col, F.col("idx").cast("bigint").alias("idx"),
                                   F.col("vec").cast("array<double>").alias("vec")))
    sizes = {r[0]: r.n for r in rows.groupBy(class_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    per_cell = max(cell_rows, -(-sum(sizes.values()) // MAX_CELLS))
    cells = {c: -(-n // per_cell) for c, n in sizes.items() if n > per_cell}
    most = max(cells.values(), default=1)
    centroids = {c: [] for c in cells}
    if cells:
        for r in rows.where((F.col("idx") < most) & F.col(class_col).isin(list(cells))).orderBy(class_col, "idx").collect():
            if r["idx"] < cells[r[class_col]]:
                centroids[r[class_col]].append(r["vec"])
    centroids = {c: np.array(v) for c, v in centroids.items()}
    index = cut_lineage(_with_cells(rows, class_col, centroids, 1).withColumn("cell", F.col("cells")[0]).drop("cells"))
    counts = cut_lineage(index.groupBy(class_col, "cell").agg(F.count(F.lit(1)).alias("n")))
    asking = rows if queries is None else rows.join(queries.select(class_col, F.col("idx").cast("bigint").alias("idx")).distinct(),
                                                    [class_col, "idx"], "left_semi")

    def search(asked: DataFrame, probed: int) -> DataFrame:
        return _search(index, counts, _with_cells(asked, class_col, centroids, probed), class_col, k, chunk)

    recall, probes = 1.0, min(probes, most)
    if cells:
        each = max(1, MEASURED // len(cells))
        drawn = cut_lineage(rows.where(F.col(class_col).isin(list(cells)) & (F.col("idx") < each)))
        truth = cut_lineage(search(drawn, most))
        while True:
            own = search(drawn, probes).withColumnRenamed("neighbours", "own")
            hits = truth.join(own, [class_col, "idx"], "left").agg(
                F.count(F.lit(1)).alias("queries"), F.sum(F.size("neighbours")).alias("all"),
                F.sum(F.size(F.array_intersect("neighbours", F.coalesce("own", F.array().cast("array<bigint>"))))).alias("hit")).first()
            recall = hits.hit / hits["all"]
            # the sample may flatter: two standard errors to spare
            spare = 2 * (recall * (1 - recall) / hits.queries) ** 0.5
            if recall - spare >= min_recall or probes >= most:
                break
            probes = min(2 * probes, most)
    return Neighbours(search(asking, probes), recall, probes)
