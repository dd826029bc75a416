"""Personal data: base formats, and contextual extraction bootstrapped from them.

The base formats (email, ip, card, phone) are seeds. The words around each
occurrence are patterns, and every identifier-like string is an instance of
the patterns around it. In rounds, a pattern is scored by the share of its
distinct instances that are known to be of a kind, an instance by the noisy-or
of its reliable patterns, and instances that score high enough join the known
ones, also for patterns that no seed has. The rounds end when no instance
joins. Identifiers found that way are added to the base spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from moodframe.llm.common import discard, documents, join_hot, materialise

KINDS = ("email", "ip", "card", "phone")
UNKNOWN = -1

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start inside a run of digits cannot match where the run's own start failed
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IDENTIFYING = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
EDGES = ".,;:!?()[]{}<>\"'|#$%&*="
DIGIT = re.compile(r"[0-9]")

# Context that patterns are made of, in characters on either side.
LEFT, RIGHT = 80, 40

# A reliable pattern's known instances, weighted by their scores, and its
# confidence; the score of an instance that joins.
MIN_SEEDS = 3
MIN_PATTERN = 0.8
MIN_INSTANCE = 0.9
# A rise of a known instance's score that no longer counts as a change.
TOLERANCE = 1e-4


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base formats, by kind and start."""
    spans = [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                spans.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m.group())) <= 15:
                    spans.append((3, *m.span()))
    return spans


def candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Strings with a digit or an at sign that no base span touches. How many
    digits they have does not matter: their patterns decide."""
    taken, k = sorted((a, b) for _, a, b in spans), 0
    for m in TOKEN.finditer(text):
        token = m.group()
        if not IDENTIFYING.search(token):
            continue
        start = m.start() + len(token) - len(token.lstrip(EDGES))
        end = m.end() - (len(token) - len(token.rstrip(EDGES)))
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        at, touched = k, False
        while not touched and at < len(taken) and taken[at][0] < end:
            touched = start < taken[at][1]
            at += 1
        if start < end and not touched:
            yield start, end


def patterns(text: str, start: int, end: int) -> list[str]:
    """The words around a place: two before, one before, one on each side."""
    before = DIGIT.sub("0", text[max(0, start - LEFT):start].lower()).split()[-2:]
    after = DIGIT.sub("0", text[end:end + RIGHT].lower()).split()[:1]
    one = before[-1] if before else "^"
    out = [f"{one} _", f"{one} _ {after[0] if after else '$'}"]
    return out + ([f"{before[0]} {one} _"] if len(before) == 2 else [])


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, found): each row's base spans, and all its identifier-like
    places with their patterns and kind (-1: unknown)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(
        "base array<struct<kind: int, start: int, end: int>>, "
        "found array<struct<kind: int, start: int, end: int, instance: string, patterns: array<string>>>").fields])
    _, base_type, found_type = to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for value in batch.column(1).to_pylist():
                value = value or ""
                spans = base_spans(value) if IDENTIFYING.search(value) else []
                places = list(spans)
                if IDENTIFYING.search(value):
                    places += [(UNKNOWN, a, b) for a, b in candidates(value, spans)]
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                found.append([{"kind": k, "start": a, "end": b, "instance": value[a:b].lower(), "patterns": patterns(value, a, b)}
                              for k, a, b in places])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_type), pa.array(found, found_type)],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


def bootstrap(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(instance, kind) of the unknown instances that the pattern graph of
    ``edges`` (pattern, instance, kind) takes for identifiers: the fixed point,
    or what ``rounds`` rounds find.

    Scores of a kind only rise from round to round, so that what has joined
    stays, and the fixed point is reached.
    """
    # each instance once a pattern; what is a seed anywhere is one everywhere
    graph, _ = materialise(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-graph")
    seeds = [F.col(f"seeds{k}") for k in range(len(KINDS))]
    unknown = F.col("instances") - sum(seeds)
    most = F.greatest(*seeds) + unknown  # held if all unknown instances were of the best kind
    # only patterns go that could never be reliable or have nothing to find
    sizes, _ = materialise(graph.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("instances"), *[F.sum((F.col("kind") == k).cast("double")).alias(f"seeds{k}") for k in range(len(KINDS))])
        .where((unknown > 0) & (most >= MIN_SEEDS) & (F.round(most / (F.col("instances") + 1), 9) >= MIN_PATTERN)), "pii-patterns")
    open_, _ = materialise(graph.where(F.col("kind") == UNKNOWN).select("pattern", "instance")
                           .join(sizes.select("pattern"), "pattern", "left_semi"), "pii-open")
    total, known, known_at, done = open_.count(), None, None, 0
    spark = edges.sparkSession
    while rounds is None or done < rounds:
        scored = sizes
        if known is not None:
            # unknown instances that joined in earlier rounds count for their patterns
            gained = open_.join(known, "instance").groupBy("pattern").agg(
                *[F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(f"gained{k}") for k in range(len(KINDS))])
            scored = sizes.join(gained, "pattern", "left").select("pattern", "instances", *[
                (F.col(f"seeds{k}") + F.coalesce(f"gained{k}", F.lit(0.0))).alias(f"seeds{k}") for k in range(len(KINDS))])
        best = F.array_max(F.array(*[F.struct(F.col(f"seeds{k}").alias("held"), F.lit(k).alias("kind")) for k in range(len(KINDS))]))
        # rounded, as sums in another order must not move a score across a cut
        scored = scored.withColumn("best", best).select(
            "pattern", "instances", F.col("best.kind").alias("kind"), F.round("best.held", 9).alias("held"),
            F.round(F.col("best.held") / (F.col("instances") + 1), 9).alias("confidence"))
        reliable, reliable_at = materialise(scored.where((F.col("held") >= MIN_SEEDS) & (F.col("confidence") >= MIN_PATTERN)), "pii-reliable")
        # patterns of few instances are joined by key, frequent ones where their edges are
        voted = join_hot(open_, reliable, ["pattern"], "instances", total)
        votes = voted.groupBy("instance", "kind").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("confidence")))), 9).alias("score"))
        votes = votes.where(F.col("score") >= MIN_INSTANCE)
        if known is None:
            votes = votes.withColumn("joined", F.lit(None).cast("int")).withColumn("had", F.lit(None).cast("double"))
        else:
            votes = votes.join(known.select("instance", F.col("kind").alias("joined"), F.col("score").alias("had")), "instance", "left")
        # a known instance keeps its kind
        top = F.max(F.struct(F.coalesce(F.col("kind") == F.col("joined"), F.lit(False)).alias("same"), "score", "kind", "had")).alias("top")
        after, after_at = materialise(votes.groupBy("instance").agg(top).select("instance", "top.kind", "top.score", "top.had"), "pii-known")
        changed = after.where(F.col("had").isNull() | (F.col("score") - F.col("had") > TOLERANCE)).limit(1).count()
        discard(spark, reliable_at, *([known_at] if known_at else []))
        known, known_at, done = after.drop("had"), after_at, done + 1
        if not changed:
            break
    return known.select("instance", "kind")


def spelt(spans: str) -> Column:
    """kind:start:end, by kind and start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """Personal data of every row: ``doc_id``, the number of base spans of each
    kind, ``base_sha256``, ``spans`` (base and added ones) and ``n_added``.
    Offsets are code points, ends exclusive.

    Cases: a null or empty text has no span. Rows that repeat an id are
    searched each for itself, their contexts count once. A null id stays null.
    An empty table gives an empty result; other columns are not looked at.
    """
    rows, _ = materialise(extract(docs, doc_id, text).withColumn("nth", F.monotonically_increasing_id()), "pii-rows")
    places = rows.select("nth", F.explode("found").alias("p")).select("nth", "p.*")
    known = bootstrap(places.select(F.explode("patterns").alias("pattern"), "instance", "kind"), rounds)
    added = places.where(F.col("kind") == UNKNOWN).select("nth", "start", "end", "instance").join(known, "instance")
    added = added.groupBy("nth").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    none = F.array().cast("array<struct<kind: int, start: int, end: int>>")
    out = rows.select("nth", "doc_id", "base").join(added, "nth", "left").withColumn("added", F.coalesce("added", none))
    out = out.withColumn("all", F.concat("base", "added"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(spelt("base").cast("binary"), 256).alias("base_sha256"),
                      spelt("all").alias("spans"), F.size("added").cast("long").alias("n_added"))


def _is(kind: int):
    return lambda s: s["kind"] == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
