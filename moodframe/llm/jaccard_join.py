"""N-gram Jaccard join with prefix trees.

Documents become sets of word n-grams, ordered globally by their hashes. Those
that can link meet in a group, each distinct set once, where their
ordered sets are stored in a trie; a probe walks the trie with the overlap so
far, shares it among all sets below a node, and leaves a subtree whose
remaining lengths cannot reach the overlap that the threshold asks for.

Which classes meet: sets with ``J >= t`` differ in at most ``d`` elements, so
if the hash range is cut into parts, at most ``d`` parts differ. Each set emits
a signature of its first ``d + 1`` parts that hold at least ``q`` elements.
Within the shorter of two linked sets' runs of parts, one of those ``d + 1``
parts agrees, so the two share a signature. A set with too few such parts
emits all of them and takes part in the next level, whose last holds every
element as a part of its own; a pair is therefore missed at no level, whatever
the data. Elements that very many documents have are left out of the first
level's parts, where they would join strangers; that changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from moodframe.llm.common import SPACE_CLASS, UPPER, discard, documents, join_hot, keep_decided, materialise, release_memory, worker_cache
from moodframe.llm.components import connected_components

# An n-gram is frequent where at least so many documents hold it, and one of so
# many of all documents. The frequent list is bounded by a document's mean
# number of n-grams times the latter.
FREQUENT_DOCS = 20
FREQUENT_SHARE = 1_000
# Bits of the most counters that a task keeps, and the counters of one row.
COUNTER_BITS = 24
COUNTERS = 1 << 12
# Elements of the sets that one trie task holds.
BLOCK_ELEMENTS = 400_000

# Set sizes are classed by powers of this.
CLASS_RATIO = 1.5

MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: Column, n: int) -> Column:
    """Hashes of all word n-grams, with repeats; the whole sequence as one if
    there are fewer words, none without words."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    words = F.array_remove(F.split(lowered, SPACE_CLASS), "")

    def over(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))),
                           lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        whole = F.array(F.xxhash64(w))
        return F.when(F.size(w) >= n, runs).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), over), F.lit(0))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * (MIX + np.uint64(2 * salt))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class Signer:
    """Signatures of a set for a threshold of ``percent`` hundredths."""

    def __init__(self, percent: int, frequent: np.ndarray):
        self.percent, self.frequent = percent, frequent
        # the least number of elements of a part that counts, and the mean of
        # all parts: as large as leave more than d + 1 such parts to sets of
        # every size in a class; d + 1 is about ``share`` of the size
        share = (100 - percent) / percent
        self.least, self.load = max(
            ((q, load) for q in (1, 2, 3, 4) for load in (1.2, 1.6, 2.0, 2.4, 3.0, 4.0, 5.0, 6.0)
             if min(_full(x, q) / x for x in (load, load / CLASS_RATIO)) > 1.15 * share), default=(1, 1.0))

    def differ(self, size: int) -> int:
        """How many elements a set of ``size`` and one linked with it can differ in."""
        larger = size * 100 // self.percent
        return (size + larger) * (100 - self.percent) // (100 + self.percent)

    def size_classes(self, size: int) -> list[tuple[int, int]]:
        """(class, parts): two linked sets meet in the class of the smaller
        one, so a set is in all classes of sizes that it can be linked with
        and that are not larger."""
        def of(k: int) -> int:
            return int(np.floor(np.log(k) / np.log(CLASS_RATIO) + 1e-9))
        smallest = max(1, -(-size * self.percent // 100))
        return [(c, max(1, int(CLASS_RATIO ** (c + 1) / self.load))) for c in range(of(smallest), of(size) + 1)]

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """``elements`` are distinct and in order. A set that can only be
        linked with equal ones has the signature of the whole set."""
        need, out = self.differ(len(elements)) + 1, []
        if need <= 1:
            return _mixed(_mixed(elements, 1).sum(dtype=np.uint64, keepdims=True), 2)[:len(elements)]
        rare = elements
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, elements), len(self.frequent) - 1)
            rare = elements[self.frequent[at] != elements]
        for size_class, parts in self.size_classes(len(elements)):
            for level, own, count, least in ((0, rare, parts, self.least), (1, elements, parts, self.least), (2, elements, 0, 1)):
                if count:
                    part = ((own >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
                    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(own) else np.zeros(0, dtype=np.int64)
                    sizes = np.diff(np.r_[starts, len(own)])
                    sums = np.add.reduceat(_mixed(own, 1), starts) if len(starts) else np.zeros(0, dtype=np.uint64)
                    sums = sums[sizes >= least] + part[starts][sizes >= least] * MIX
                else:
                    sums = own
                out.append(_mixed(sums[:need], 3 + 4 * (3 * size_class + level)))
                if len(sums) >= need:
                    break
        return np.unique(np.concatenate(out))


def _full(load: float, least: int) -> float:
    """The share of parts with at least ``least`` elements at a mean ``load``."""
    terms, term = 0.0, np.exp(-load)
    for k in range(least):
        terms, term = terms + term, term * load / (k + 1)
    return 1 - terms


def linked(shared: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (size + sizes - shared)


class Trie:
    """Ordered sets in a trie whose chains are one node: a node holds a run of
    elements, its children, and the least and largest set size below it."""

    def __init__(self, sets: list[np.ndarray]):
        """``sets``: distinct sets of increasing numbers, in lexicographic order."""
        self.sizes = np.array([len(s) for s in sets])
        of, first, last, leaf, parent, children = [], [], [], [], [], []

        def add(own: int, begin: int, end: int, above: int, ends: int) -> int:
            for column, value in zip((of, first, last, leaf, parent, children), (own, begin, end, ends, above, [])):
                column.append(value)
            return len(of) - 1

        path: list[int] = []  # nodes from a root to the last set's end
        for k, own in enumerate(sets):
            shared = 0
            if k:
                before = sets[k - 1][:len(own)]
                differ = np.flatnonzero(before != own[:len(before)])
                shared = int(differ[0]) if len(differ) else len(before)
            while path and first[path[-1]] >= shared:
                path.pop()
            if path and last[path[-1]] > shared:  # the chain forks inside this node
                top = path[-1]
                rest = add(of[top], shared, last[top], top, leaf[top])
                children[rest], children[top] = children[top], [rest]
                for child in children[rest]:
                    parent[child] = rest
                last[top], leaf[top] = shared, -1
            above = path[-1] if path else -1
            path.append(add(k, shared, len(own), above, k))
            if above >= 0:
                children[above].append(path[-1])
        self.leaf, self.depth, self.lengths = np.array(leaf), np.array(last), np.array(last) - np.array(first)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.elements = np.concatenate([sets[o][a:b] for o, a, b in zip(of, first, last)])
        self.last = np.array([sets[o][b - 1] for o, b in zip(of, last)])
        self.children = [np.array(c, dtype=np.int64) for c in children]
        self.roots = np.flatnonzero(np.array(parent) < 0)
        self.low, self.high = np.full(len(of), np.iinfo(np.int64).max), np.zeros(len(of), dtype=np.int64)
        for node in np.flatnonzero(self.leaf >= 0).tolist():
            size = self.sizes[self.leaf[node]]
            while node >= 0 and not self.low[node] <= size <= self.high[node]:
                self.low[node], self.high[node] = min(self.low[node], size), max(self.high[node], size)
                node = parent[node]
        self.mark = np.zeros(int(self.elements.max()) + 1, dtype=bool)

    def probe(self, own: np.ndarray, percent: int) -> np.ndarray:
        """The places of the sets that are linked with ``own``."""
        found, nodes, so_far = [], self.roots, np.zeros(len(self.roots), dtype=np.int64)
        self.mark[own] = True
        size = len(own)
        while len(nodes):
            fits = (percent * self.low[nodes] <= 100 * size) & (100 * self.high[nodes] >= percent * size)
            nodes, so_far = nodes[fits], so_far[fits]
            if not len(nodes):
                break
            lengths = self.lengths[nodes]
            ends = np.cumsum(lengths)
            places = np.arange(ends[-1]) + np.repeat(self.at[nodes] - (ends - lengths), lengths)
            so_far = so_far + np.add.reduceat(self.mark[self.elements[places]], ends - lengths, dtype=np.int64)
            # what is left of the probe after a node's last element, and of the sets below it
            left = size - np.searchsorted(own, self.last[nodes], side="right")
            most = so_far + np.minimum(left, self.high[nodes] - self.depth[nodes])
            alive = linked(most, size, np.maximum(self.low[nodes], most), percent)
            nodes, so_far = nodes[alive], so_far[alive]
            here = self.leaf[nodes]
            ended = here >= 0
            exact = linked(so_far[ended], size, self.sizes[here[ended]], percent)
            found.append(here[ended][exact])
            below = [self.children[k] for k in nodes.tolist()]
            so_far = np.repeat(so_far, [len(b) for b in below])
            nodes = np.concatenate(below) if below else nodes
        self.mark[own] = False
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def links_within(keys: np.ndarray, sets: list[np.ndarray], groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join all of ``groups``, the known components of the sets,
    that are connected by links here: fewer than there are sets."""
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64)
    numbered = np.split(numbers, np.cumsum([len(s) for s in sets])[:-1])
    order = sorted(range(len(sets)), key=lambda k: numbered[k].astype(">i8").tobytes())
    trie, links = Trie([numbered[k] for k in order]), []
    groups = groups[order]
    for place, k in enumerate(order):
        for other in trie.probe(numbered[k], percent).tolist():
            if groups[other] != groups[place]:
                groups[groups == groups[other]] = groups[place]
                links.append((int(keys[k]), int(keys[order[other]])))
    return links


def _trie_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links within the rows of equal ``task`` and ``comp``; a task
    holds a bounded number of elements."""
    def join(frame: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, own in frame.groupby("comp", sort=False):
            if len(own) > 1:
                ordered = [np.sort(np.asarray(e, dtype=np.int64).view(np.uint64)) for e in own["elements"]]
                links += links_within(own["class"].to_numpy(), ordered, own["known"].to_numpy().copy(), percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")
    return (sets.select("task", "comp", "class", "known", "elements").groupBy("task")
            .applyInPandas(join, "a long, b long"))


def _across_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Links between all sets of a component, one task for each pair of its blocks."""
    totals = sets.groupBy("comp").agg(F.sum("size").alias("elements_of_comp"))
    at = sets.join(totals, "comp").withColumn("n", F.ceil(F.col("elements_of_comp") / F.lit(BLOCK_ELEMENTS)))
    own = F.pmod(F.xxhash64("class"), F.col("n"))
    at = at.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    task = F.concat_ws(" ", "comp", F.least("own", "other"), F.greatest("own", "other"))
    return _trie_links(at.withColumn("task", task), percent)


def _meeting_rows(rows: DataFrame) -> DataFrame:
    """(nth, lead): rows that share a signature, each with the first of them."""
    signs = rows.select("nth", F.explode("signs").alias("sign"))
    meet = signs.groupBy("sign").agg(F.min("nth").alias("lead"), F.count(F.lit(1)).alias("met")).where("met > 1")
    total = rows.agg(F.coalesce(F.sum(F.size("signs")), F.lit(0)).alias("n")).first().n
    met = join_hot(signs, meet, ["sign"], "met", total)
    return met.where("nth <> lead").select("nth", "lead").distinct()


def _linked_rows(docs: DataFrame, text: str, keys: list[Column], n: int, percent: int,
                 rows: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b): links between rows that connect whatever links connect."""
    near = connected_components(near, "nth", "lead").select(F.col("node").alias("nth"), F.col("root").alias("comp"))
    # each distinct set of a component once, as the first row that has it
    found, found_at = materialise(rows.drop("id").join(near, "nth"), "join-candidates")
    equal = ["comp", "size", "set_a", "set_b"]
    classes, _ = materialise(
        found.groupBy(*equal).agg(F.min("nth").alias("class"), F.min(F.struct("text_a", "text_b")).alias("sample"),
                                  F.count(F.lit(1)).alias("copies")), "join-classes")
    copies = join_hot(found, classes, equal, "copies", found.count()).where("nth <> class")
    links, _ = materialise(copies.select(F.col("class").alias("a"), F.col("nth").alias("b")), "join-links")
    discard(docs.sparkSession, found_at)

    totals = classes.groupBy("comp").agg(F.sum("size").alias("of_comp"), F.count(F.lit(1)).alias("members")).withColumn(
        "blocks", F.ceil(F.col("of_comp") / F.lit(BLOCK_ELEMENTS))).where("members > 1")
    shape = totals.agg(F.coalesce(F.max("blocks"), F.lit(0)).alias("most"), F.coalesce(F.sum("of_comp"), F.lit(0)).alias("all")).first()
    buckets = F.lit(shape["all"] // BLOCK_ELEMENTS + 1)
    # small components share tasks, large ones have several
    task = F.when(F.col("blocks") == 1, F.concat_ws(" ", F.lit("bucket"), F.pmod(F.xxhash64("comp"), buckets))).otherwise(
        F.concat_ws(" ", "comp", F.pmod(F.xxhash64("class"), F.col("blocks"))))
    placed = (classes.join(totals, "comp").withColumn("task", task)
              .select("class", "comp", "size", "blocks", "task", "sample.text_a", "sample.text_b"))
    texts = docs.select(*keys, F.col(text).alias("text to join")).join(placed, ["text_a", "text_b"])
    one = texts.groupBy("class", "comp", "size", "task", "blocks").agg(F.any_value("text to join").alias("t"))
    sets = one.select("class", "comp", "size", "task", "blocks", F.array_distinct(ngrams(F.col("t"), n)).alias("elements"))
    sets, _ = materialise(sets.withColumn("known", F.col("class")), "join-sets")
    within, _ = materialise(_trie_links(sets, percent), "join-links")
    links = links.unionAll(within)
    if shape.most > 1:
        large = sets.where("blocks > 1").drop("known")

        def known_after(links: DataFrame) -> DataFrame:
            roots = connected_components(links, "a", "b").withColumnsRenamed({"node": "class", "root": "known"})
            return large.join(roots, "class", "left").withColumn("known", F.coalesce("known", "class"))

        # one set of each part of a component first; most parts are joined by then
        more, _ = materialise(_across_blocks(known_after(within).where("known = class"), percent), "join-links")
        within, links = within.unionAll(more), links.unionAll(more)
        now, _ = materialise(known_after(within), "join-sets")
        apart = now.groupBy("comp").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low <> high")
        more, _ = materialise(_across_blocks(now.join(apart.select("comp"), "comp", "left_semi"), percent), "join-links")
        links = links.unionAll(more)
    return links


def _listed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a batch of documents, and each one's row."""
    lists = batch.column(0)
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy().view(np.uint64)[offsets[0]:offsets[-1]]
    return values, np.repeat(np.arange(batch.num_rows), np.diff(offsets))


def _counters(bits: int):
    """One task's counts of n-grams by their lowest ``bits``, repeats included:
    never less than the documents that hold one."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("no cache", dict)
        release_memory()  # what an operator before left
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            np.add.at(counts, (_listed(batch)[0] & np.uint64((1 << bits) - 1)).astype(np.int64), np.uint32(1))
        parts = counts.reshape(-1, COUNTERS)
        most = parts.max(axis=1)
        for part in np.flatnonzero(most).tolist():
            packed = parts[part].astype(np.uint8 if most[part] < 256 else np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], ["part", "counts"])
    return count


def _held(bits: int, many: bytes):
    """``h, n``: n-grams whose counter is marked in ``many``, and how many
    documents of a batch hold each."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(many, dtype=np.uint8)).astype(bool)
        for batch in batches:
            values, rows = _listed(batch)
            kept = marked[(values & np.uint64((1 << bits) - 1)).astype(np.int64)]
            values, rows = values[kept], rows[kept]
            order = np.lexsort((rows, values))
            values, rows = values[order], rows[order]
            once = np.r_[True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])][:len(values)]
            found, n = np.unique(values[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])
    return count


def frequent_ngrams(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """N-grams that at least ``FREQUENT_DOCS`` documents and one of
    ``FREQUENT_SHARE`` hold, counted over all documents. They only steer which
    sets meet, never which are linked.

    A first pass counts by some bits of the n-grams, a bounded number of counters
    a task, which are added up. A second counts the documents of those n-grams
    whose counter reaches the bound; no other one can be frequent."""
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).first()
    least = max(FREQUENT_DOCS, -(-size["docs"] // FREQUENT_SHARE))
    # four times as many counters as would hold the bound each, with six characters a word
    bits = int(np.clip(np.ceil(np.log2(1 + 4 * size["chars"] / 6 / least)), COUNTERS.bit_length() - 1, COUNTER_BITS))
    lists = docs.select(ngrams(F.col(text), n).alias("ngrams"))

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for packed in frame["counts"]:
            total += np.frombuffer(packed, dtype=np.uint8 if len(packed) == COUNTERS else np.uint32)
        return pd.DataFrame({"part": frame["part"][:1], "many": [np.packbits(total >= least).tobytes()]})

    parts = lists.mapInArrow(_counters(bits), "part int, counts binary").groupBy("part").applyInPandas(added, "part int, many binary")
    many = np.zeros((1 << bits) // 8, dtype=np.uint8)  # a bit a counter
    for part, packed in parts.collect():
        many[part * COUNTERS // 8:(part + 1) * COUNTERS // 8] = np.frombuffer(packed, dtype=np.uint8)
    if not many.any():
        return np.zeros(0, dtype=np.uint64)
    counts = lists.mapInArrow(_held(bits, many.tobytes()), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return np.sort(counts.where(F.col("n") >= least).select("h").toPandas()["h"].to_numpy(dtype=np.int64).astype(np.uint64))


def _sign(percent: int, frequent: np.ndarray):
    shipped = frequent.tobytes()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("no cache", dict)
        release_memory()  # what an operator before left
        signer = Signer(percent, np.frombuffer(shipped, dtype=np.uint64))
        for batch in batches:
            lists = batch.column("ngrams")
            values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            size, a, b, signs = [], [], [], []
            for first, last in zip(offsets[:-1], offsets[1:]):
                own = np.unique(values[first:last])
                size.append(len(own))
                a.append(int(_mixed(own, 7).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                b.append(int(_mixed(own, 8).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                signs.append(signer.signatures(own).view(np.int64))
            ends = np.cumsum([0] + [len(s) for s in signs]).astype(np.int32)
            flat = np.concatenate(signs) if signs else np.zeros(0, dtype=np.int64)
            kept = [batch.column(c) for c in ("id", "text_a", "text_b")]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["id", "text_a", "text_b", "size", "set_a", "set_b", "signs"])
    return sign


def text_keys(text: str) -> list[Column]:
    """128 bits that stand for a text where rows are found again."""
    value = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(value), F.xxhash64(F.lit(1), value)]


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3,
                    percent: int = 90) -> DataFrame:
    """The component of every document under links of ``J >= percent / 100``.

    Returns per row of ``docs`` ``doc_id``, ``n_shingles`` (size of its set),
    ``component_id`` (smallest id that it reaches by links, itself included),
    ``set_a, set_b`` (what rows with an equal set share), ``text_a, text_b``
    (:func:`text_keys` of the row's text) and ``first`` (true for one row of
    each component, one with the smallest id).

    Cases: words end at ASCII white space and A-Z count as a-z. A null, empty
    or blank text has the empty set, which is linked with nothing, not even
    another empty one: such a row's component is itself. Repeated rows are
    linked with each other; a null id counts as larger than any other, and a
    component of nothing but null ids has a null id. An empty table gives an
    empty result. Other columns are not looked at.
    """
    frequent = frequent_ngrams(docs, text, n)
    keys = [k.alias(name) for k, name in zip(text_keys(text), ("text_a", "text_b"))]
    signed = docs.select(F.col(doc_id).alias("id"), *keys, ngrams(F.col(text), n).alias("ngrams"))
    schema = StructType([signed.schema["id"]])
    for name in ("text_a", "text_b", "size", "set_a", "set_b"):
        schema.add(name, "long")
    schema.add("signs", ArrayType(LongType()))
    wide, wide_at = materialise(signed.mapInArrow(_sign(percent, frequent), schema)
                                .withColumn("nth", F.monotonically_increasing_id()), "join-signatures")
    near, _ = materialise(_meeting_rows(wide), "join-near")
    rows, _ = materialise(wide.drop("signs"), "join-rows")
    discard(docs.sparkSession, wide_at)  # most of what is written
    roots = connected_components(_linked_rows(docs, text, keys, n, percent, rows, near), "a", "b")
    joined, _ = materialise(roots.join(rows.select(F.col("nth").alias("node"), "id"), "node"), "join-components")
    least = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("node").alias("nth"))
    ends = joined.groupBy("root").agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("members"))
    ends = join_hot(joined, ends, ["root"], "members", rows.count()).select(F.col("node").alias("nth"), "least")
    own = F.col("least").isNull()
    return rows.join(ends, "nth", "left").select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"),
        F.when(own, F.col("id")).otherwise(F.col("least.id")).alias("component_id"), "set_a", "set_b", "text_a", "text_b",
        (own | (F.col("least.nth") == F.col("nth"))).alias("first"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one of each component, with all their columns."""
    found = jaccard_classes(docs, doc_id, text, n, percent).select("doc_id", "text_a", "text_b", "first")
    return keep_decided(docs, doc_id, text_keys(text), found, "first")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda t: t <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY 1, 2
"""
