"""Merkle manifest of a table, with a proof for every row.

Rows are leaves, ordered by group and id. Every three consecutive nodes of a
group become one node of the next level until one is left (the group's
subroot); the subroots, ordered by group, are folded in the same way to the
root. Levels are aggregates over ``(tree, run)``, so no group is ever in one
task.

Proofs come by pointer jumping: every node holds an ancestor and the sibling
digests on the way to it. Joining the table with itself on the ancestor doubles
the distance and concatenates the segments, so a tree of height h needs
log2(h) joins instead of h. After each join only nodes whose level is a
multiple of the distance can be met again; the others are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.llm.common import HOT_SHARE, discard, documents, join_hot, materialise, numbered

RUN = 3
DIGEST_BYTES = 32

# Number of the tree over the subroots; the groups' trees count from 0.
TOP = -1

NODE = ["tree", "level", "idx"]
ANCESTOR = ["to_tree", "to_level", "to_idx"]


def value_part(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon and value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(parts: Column) -> Column:
    """sha256 of a text, 32 bytes."""
    return F.unhex(F.sha2(parts.cast("binary"), 256))


def leaf_of(*values: Column) -> Column:
    return digest_of(F.concat(*[value_part(v) for v in values]))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


@dataclass
class Tree:
    """Runs of every level (``tree, level, run, kids, digest, n``; ``kids`` are
    the digests of the nodes below, ``n`` the tree's nodes on the level above)
    and the topmost node of every tree."""

    runs: list[DataFrame]
    tops: DataFrame


def fold_levels(nodes: DataFrame, most: int, name: str) -> Tree:
    """Fold trees of ``nodes`` (``tree, idx, digest, n``; ``n`` nodes in the
    tree, at most ``most``) to one node each."""
    runs, tops = [], nodes.where("n = 1").select("tree", "digest")
    for level in range(levels_above(most)):
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda kid: kid["digest"])
        run = (nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {RUN}").alias("run"))
               .agg(kids.alias("kids"), F.max("n").alias("n"))
               .select("tree", F.lit(level).alias("level"), "run", "kids",
                       F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"),
                       digest_of(F.concat_ws("", F.transform("kids", hex_text))).alias("digest")))
        run, _ = materialise(run, f"{name}-level-{level}")
        runs.append(run)
        nodes = run.select("tree", F.col("run").alias("idx"), "digest", "n")
        tops = tops.unionByName(nodes.where("n = 1").select("tree", "digest"))
    return Tree(runs, tops)


def levels_above(nodes: int) -> int:
    """Levels over so many nodes until one is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // RUN), levels + 1
    return levels


def step_up(at: Column) -> list[Column]:
    """Where the node at position ``at`` of the run in ``kids`` is led to, the
    siblings and the shape of that step."""
    left, size = (at % RUN).cast("int"), F.size("kids")
    siblings = [F.when((left != k) & (size > k), F.get("kids", F.lit(k))).otherwise(F.lit(b"")) for k in range(RUN)]
    # the last node of a group's tree is a leaf of the tree over the groups
    ends = (F.col("n") == 1) & (F.col("tree") != TOP)
    return [F.when(ends, F.lit(TOP)).otherwise(F.col("tree")).cast("bigint").alias("to_tree"),
            F.when(ends, F.lit(0)).otherwise(F.col("level") + 1).cast("int").alias("to_level"),
            F.when(ends, F.col("tree")).otherwise(F.col("run")).alias("to_idx"),
            F.concat(*siblings).alias("siblings"),
            (left * 3 + size - 1 - left).cast("string").alias("shape")]


def links(runs: list[DataFrame]) -> list[DataFrame]:
    """One entry for each node below the given runs."""
    return [run.select("*", F.posexplode("kids").alias("k", "kid")).select(
        "tree", "level", (F.col("run") * RUN + F.col("k")).alias("idx"), *step_up(F.col("k"))) for run in runs]


def at_node(node: tuple[int, int, int]) -> Column:
    is_at = F.lit(True)
    for name, value in zip(ANCESTOR, node):
        is_at = is_at & (F.col(name) == value)
    return is_at


def jump(entries: DataFrame, inner: DataFrame, distance: int, total: int, root: tuple[int, int, int]) -> DataFrame:
    """Replace the ancestor of every entry by the ancestor's own one in
    ``inner`` and join the segments. Entries span ``distance`` levels now, or
    have reached ``root``; they are ``total`` at most."""
    there = inner.select(*[F.col(a).alias(b) for a, b in zip(NODE, ANCESTOR)],
                         *[F.col(a).alias(f"next_{a}") for a in [*ANCESTOR, "siblings", "shape"]])
    waiting = entries.where(~at_node(root))
    # at most RUN ** distance entries point to one node
    if RUN ** distance * HOT_SHARE <= total:
        met = waiting.join(there, ANCESTOR)
    else:
        pointing = waiting.groupBy(*ANCESTOR).agg(F.count(F.lit(1)).alias("pointing"))
        met = join_hot(waiting, there.join(pointing, ANCESTOR), ANCESTOR, "pointing", total)
    met = met.withColumns({a: F.col(f"next_{a}") for a in ANCESTOR}
                          | {a: F.concat(a, f"next_{a}") for a in ("siblings", "shape")}).select(*entries.columns)
    return entries.where(at_node(root)).unionByName(met)


def fold(start: Column, siblings: Column, shape: Column) -> Column:
    """Hex digest of the node that a proof leads to from the digest ``start``."""
    def step(state: Column, code: Column) -> Column:
        left, right = F.floor(code.cast("int") / 3).cast("int"), code.cast("int") % 3
        before = siblings.substr(state["at"], left * DIGEST_BYTES)
        after = siblings.substr(state["at"] + left * DIGEST_BYTES, right * DIGEST_BYTES)
        return F.struct(F.sha2(F.concat(hex_text(before), state["node"], hex_text(after)).cast("binary"), 256).alias("node"),
                        (state["at"] + (left + right) * DIGEST_BYTES).alias("at"))

    codes = F.filter(F.split(shape, ""), lambda c: c != "")
    begin = F.struct(hex_text(start).alias("node"), F.lit(1).alias("at"))
    return F.aggregate(codes, begin, step, lambda state: state["node"])


def manifest(leaves: DataFrame) -> DataFrame:
    """Every leaf of ``leaves`` with its proof. Columns: ``id`` (of any type
    that orders), ``group`` (string), ``leaf`` (32 bytes) and ``extra``, anything
    that the caller wants back.

    Returns ``id, group, leaf, extra, subroot, root`` (32 bytes) and the proof:
    ``siblings`` (the digests one after another) and ``shape`` (a character a
    level, 3 * siblings on the left + siblings on the right).

    Cases: leaves of a group are ordered by id (null first), then by digest;
    equal rows are leaves of their own. A null group comes first and is no
    other group's. A group of one row has its leaf as subroot; where there is
    one group its subroot is the root. Without rows the result is empty.
    """
    spark = leaves.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))  # orders like the group, null first
    # range partitioning reads its input twice; the leaves are made once
    made, made_at = materialise(leaves.select(name.alias("name"), "id", "leaf", "extra"), "merkle-made")
    rows, rows_at = numbered(made, ["name", "id", "leaf"], "merkle-leaves")
    discard(spark, made_at)
    groups, groups_at = numbered(rows.groupBy("name").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n")),
                                 ["name"], "merkle-groups")
    groups = groups.withColumnRenamed("idx", "tree")
    size = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    total = size.rows or 0
    nodes, nodes_at = materialise(
        join_hot(rows, groups, ["name"], "n", total)
        .select("tree", "name", (F.col("idx") - F.col("first")).alias("idx"), "id", F.col("leaf").alias("digest"), "extra", "n"),
        "merkle-nodes")
    discard(spark, rows_at)

    below = fold_levels(nodes.select("tree", "idx", "digest", "n"), size.most or 0, "merkle")
    subroots = below.tops.join(groups.select("tree", F.col("n").alias("rows")), "tree")
    subroots, _ = materialise(subroots, "merkle-subroots")
    discard(spark, groups_at)
    above = fold_levels(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), "digest",
                                        F.lit(size.groups).cast("bigint").alias("n")), size.groups, "merkle-top")
    root = (TOP, len(above.runs), 0)

    kept = ["id", "name", F.col("digest").alias("leaf"), "extra"]
    starts = (nodes.where("n = 1").select(  # the leaf is its group's subroot
        *kept, F.col("digest").alias("subroot"), F.lit(TOP).cast("bigint").alias("to_tree"), F.lit(0).alias("to_level"),
        F.col("tree").alias("to_idx"), F.lit(b"").alias("siblings"), F.lit("").alias("shape")))
    if below.runs:
        first = join_hot(below.runs[0].drop("digest"), subroots.withColumnRenamed("digest", "subroot"), ["tree"], "rows", total)
        starts = starts.unionByName(
            nodes.where("n > 1").drop("n").withColumn("run", F.expr(f"idx div {RUN}")).join(first, ["tree", "run"])
            .select(*kept, "subroot", *step_up(F.col("idx"))))
    inner = links(below.runs[1:]) + links(above.runs)
    entries, entries_at = materialise(starts, "merkle-proofs-1")
    table = None
    if inner:
        table, _ = materialise(reduce(DataFrame.unionByName, inner), "merkle-links-1")
    distance, needed = 1, len(below.runs) + len(above.runs) + 1
    while distance < needed and table is not None:
        entries = jump(entries, table, distance, total, root)
        if 2 * distance < needed:
            further = jump(table, table, distance, total, root).where(f"tree = {TOP} or level % {2 * distance} = 0")
            table, _ = materialise(further, f"merkle-links-{2 * distance}", "zstd")
            entries, at = materialise(entries, f"merkle-proofs-{2 * distance}", "zstd")
            discard(spark, entries_at)
            entries_at = at
        distance *= 2
    group = F.when(F.col("name") != "", F.expr("substring(name, 2)")).alias("group")
    top = above.tops.first()  # one row, none without leaves
    return entries.select("id", group, "leaf", "extra", "subroot",
                          F.lit(bytes(top.digest) if top else None).cast("binary").alias("root"), "siblings", "shape")


# Columns of ``documents`` that make a leaf, in this order.
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by source. Rows whose id's crc32 is even are verified
    after the line feeds of their text went. Null columns are ``-`` in the leaf;
    a row with a null id is verified as it is."""
    docs = documents(spark, sf_dir)
    values = {c: F.col(c) for c in LEAF_COLUMNS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = leaf_of(*(values | {"text": F.translate("text", "\n", "")}).values())
    leaves = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), leaf_of(*values.values()).alias("leaf"),
                         F.when(tampered & F.contains("text", F.lit("\n")), found).alias("extra"))
    proved = manifest(leaves)
    start = F.coalesce("extra", "leaf")
    return proved.select(
        F.col("id").alias("doc_id"), *[hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(hex_text(F.col("siblings")).cast("binary"), 256).alias("proof_sha256"),
        fold(start, F.col("siblings"), F.col("shape")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# crc32's lowest bit is all that is needed of it; T is its table.
ORACLE_SQL = """
WITH RECURSIVE
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
            lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc AS (SELECT doc_id, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
            lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])) AS c FROM documents, tab),
part AS (SELECT d.doc_id, d.source, d.text,
            CASE WHEN d.doc_id IS NULL THEN '-' ELSE strlen(d.doc_id::VARCHAR) || ':' || d.doc_id END
            || CASE WHEN d.source IS NULL THEN '-' ELSE strlen(d.source) || ':' || d.source END
            || CASE WHEN d.lang IS NULL THEN '-' ELSE strlen(d.lang) || ':' || d.lang END
            || CASE WHEN d.n_chars IS NULL THEN '-' ELSE strlen(d.n_chars::VARCHAR) || ':' || d.n_chars END AS head,
            xor(crc.c, 4294967295) % 2 = 0 AS even
         FROM documents d JOIN crc ON crc.doc_id = d.doc_id),
leaf AS (SELECT doc_id, source,
            sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
            sha256(head || CASE WHEN text IS NULL THEN '-' WHEN even THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')
                           ELSE strlen(text) || ':' || text END) AS found FROM part),
grp AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM leaf)),
base AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx, doc_id, leaf, found,
            count(*) OVER (PARTITION BY tree) AS n
         FROM leaf JOIN grp ON leaf.source IS NOT DISTINCT FROM grp.source),
low AS (SELECT tree, 0 AS level, idx, leaf AS digest, n FROM base
        UNION ALL
        SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
        FROM low WHERE n > 1 GROUP BY tree, level, idx // 3, n),
sub AS (SELECT tree, level AS height, digest FROM low WHERE n = 1),
high AS (SELECT 0 AS level, tree AS idx, digest, (SELECT count(*) FROM sub) AS n FROM sub
         UNION ALL
         SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
         FROM high WHERE n > 1 GROUP BY level, idx // 3, n),
top AS (SELECT digest AS root FROM high WHERE n = 1),
step AS (
  SELECT b.doc_id, l.level AS k, coalesce(string_agg(l.digest, '' ORDER BY l.idx) FILTER (l.idx < b.idx // CAST(3 ** l.level AS BIGINT)), '') AS pre,
         coalesce(string_agg(l.digest, '' ORDER BY l.idx) FILTER (l.idx > b.idx // CAST(3 ** l.level AS BIGINT)), '') AS post
  FROM base b JOIN low l ON l.tree = b.tree AND l.n > 1 AND l.idx // 3 = b.idx // CAST(3 ** (l.level + 1) AS BIGINT)
  GROUP BY b.doc_id, l.level
  UNION ALL
  SELECT b.doc_id, s.height + h.level, coalesce(string_agg(h.digest, '' ORDER BY h.idx) FILTER (h.idx < b.tree // CAST(3 ** h.level AS BIGINT)), ''),
         coalesce(string_agg(h.digest, '' ORDER BY h.idx) FILTER (h.idx > b.tree // CAST(3 ** h.level AS BIGINT)), '')
  FROM base b JOIN sub s ON s.tree = b.tree JOIN high h ON h.n > 1 AND h.idx // 3 = b.tree // CAST(3 ** (h.level + 1) AS BIGINT)
  GROUP BY b.doc_id, s.height, h.level),
proof AS (SELECT doc_id, sha256(string_agg(pre || post, '' ORDER BY k)) AS proof_sha256 FROM step GROUP BY doc_id),
fold AS (SELECT doc_id, 0 AS k, found AS digest FROM base
         UNION ALL
         SELECT f.doc_id, f.k + 1, sha256(s.pre || f.digest || s.post) FROM fold f JOIN step s ON s.doc_id = f.doc_id AND s.k = f.k),
folded AS (SELECT doc_id, arg_max(digest, k) AS folded_root FROM fold GROUP BY doc_id)
SELECT b.doc_id, b.leaf, s.digest AS subroot, t.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root,
       f.folded_root = t.root AS verified
FROM base b JOIN sub s ON s.tree = b.tree JOIN folded f ON f.doc_id = b.doc_id LEFT JOIN proof p ON p.doc_id = b.doc_id, top t
"""
