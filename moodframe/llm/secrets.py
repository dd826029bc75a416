"""Secret scans: candidate strings judged by a random forest.

Candidates are long runs of key characters, and all values that are assigned
to a secret's name, of any length and alphabet. Each gets features of its length
and alphabet, of its character transitions under those of the corpus, of the
share that corpus words cover, of the path it was found at, and of the words
around it. A random forest, trained from labelled findings, tells secrets from
false positives; without a table of labelled findings, those that context or
format decide serve as such.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodframe.llm.common import discard, documents, held_out, join_hot, materialise

MIN_LENGTH = 16
# Bound of the model: labelled findings that it is fitted on.
MAX_FINDINGS = 50_000
# The dictionary is every word of so many letters that so many documents hold.
MIN_WORD = 4
MIN_WORD_DOCS = 5
# Longest word looked for inside a candidate.
LONGEST_INSIDE = 20
# Characters that are looked at together, so that memory does not follow a run.
BLOCK = 1 << 18
TREES, DEPTH, SEED = 40, 8, 1
CUT = 0.5

RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}+" % MIN_LENGTH)
LETTERS = re.compile(rb"[a-z]+")
# Context of a candidate, in characters on either side.
CONTEXT = 48

# Names that secrets are assigned to, words of placeholders, and
# parts of paths that hold examples.
NAME = (r"(?:secret|token|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|signature)[a-z_]*['\"]?\s*")
NAMED = re.compile(NAME + r"(=|:|=>|:=)\s*['\"]?$", re.I)
NAME_BEFORE = re.compile(NAME + "$", re.I)
ASSIGNS = re.compile(r"(?<![=:!<>])(?:=>|:=|={1,3}|:)(?![=:])")
QUOTED = re.compile(r"\s*(?:\"((?:\\.|[^\"\\\n])*+)\"|'((?:\\.|[^'\\\n])*+)'|`((?:\\.|[^`\\\n])*+)`)")
LEAD = re.compile(r"[^\S\n]*+['\"`]?")
UNQUOTED = re.compile(r"\S++")
# What ends a statement or a pair, after a value without quotes.
CLOSING = ",;&)]}'\"`"
NAMES = re.compile(r"secret|token|passw|pwd|key|auth|bearer|credential|signature", re.I)
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|your|test|fake|xxxx|1234567", re.I)
EXAMPLE_PATH = re.compile(r"test|example|sample|doc|mock|fixture", re.I)
ASSIGNED = re.compile(r"(=|:|=>|:=)\s*['\"]?$")
SAME_CLASS = re.compile(rb"0+|1+|2+|3+")
HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")

FEATURES = (
    "log_length", "digits", "uppers", "lowers", "symbols", "distinct", "entropy", "is_hex", "longest_class_run",
    "class_changes", "transitions", "worst_transition", "dictionary", "path_length", "path_depth", "example_path",
    "name_before", "assigned", "quoted", "placeholder_near", "placeholder_inside", "words_near_in_dictionary")
INSIDE, NEAR = FEATURES.index("dictionary"), FEATURES.index("words_near_in_dictionary")


# what the corpus tells: transitions of bytes, and its words


def corpus_statistics(docs: DataFrame, text: str) -> tuple[np.ndarray, DataFrame]:
    """log2 probabilities of a byte after another over all documents, and the
    table (word) of all words that ``MIN_WORD_DOCS`` documents hold. Every task
    sums its own documents first."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, words = np.zeros(1 << 16, dtype=np.int64), Counter()
        for frame in frames:
            for value in frame["text"]:
                data = bytes(value)
                codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint16)
                pairs += np.bincount((codes[:-1] << 8) | codes[1:], minlength=1 << 16) if len(codes) > 1 else 0
                words.update({w for w in LETTERS.findall(data.lower()) if len(w) >= MIN_WORD})
            if len(words) > 1_000_000:
                yield pd.DataFrame({"pair": -1, "word": list(words), "n": list(words.values())})
                words = Counter()
        seen = np.flatnonzero(pairs)
        yield pd.DataFrame({"pair": seen, "word": None, "n": pairs[seen]})
        yield pd.DataFrame({"pair": -1, "word": list(words), "n": list(words.values())})

    rows = docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    counts, _ = materialise(rows.mapInPandas(count, "pair int, word binary, n long")
                            .groupBy("pair", "word").agg(F.sum("n").alias("n")), "secret-statistics")
    table = np.full((256, 256), 0.5)
    for r in counts.where("pair >= 0").collect():  # at most 65,536 rows
        table[r.pair >> 8, r.pair & 255] += r.n
    return np.log2(table / table.sum(axis=1, keepdims=True)), counts.where((F.col("pair") < 0) & (F.col("n") >= MIN_WORD_DOCS)).select("word")


# candidates and their features


def assigned_values(text: str) -> Iterator[tuple[int, int]]:
    """Values that follow a secret's name and a sign that assigns or compares:
    what is in quotes, else all up to white space or the next such name."""
    named = []
    for m in ASSIGNS.finditer(text):
        at = max(0, m.start() - CONTEXT)
        if name := NAME_BEFORE.search(text[at:m.start()]):
            named.append((at + name.start(), m.end()))
    done = 0
    for k, (_, at) in enumerate(named):
        if at < done:  # inside a quoted value
            continue
        if m := QUOTED.match(text, at):
            start, end = m.span(m.lastindex)
            done = m.end()
        else:
            start = LEAD.match(text, at).end()
            # a name that is itself the value's beginning does not end it
            m = UNQUOTED.match(text, start, next((n for n, _ in named[k + 1:k + 3] if n > start), len(text)))
            end = start + len(m.group().rstrip(CLOSING)) if m else start
        if start < end:
            yield start, end


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Values assigned to a secret's name, and runs of key characters."""
    yield from sorted({*assigned_values(text), *key_runs(text)})


def key_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of key characters with a digit, or with both cases inside."""
    for m in RUN.finditer(text):
        run = m.group()
        if not run.isalpha() and re.search("[0-9]", run) or (run[1:] != run[1:].lower() and run != run.upper()):
            yield m.span()


def _classes(run: str) -> bytes:
    """One byte a character: 0 digits, 1 upper, 2 lower case, 3 others."""
    kinds = {ord(c): "0" if c.isdigit() else "1" if c.isupper() else "2" if c.islower() else "3" for c in set(run)}
    return run.translate(kinds).encode()


def _steps(run: str, transitions: np.ndarray) -> tuple[float, float]:
    """Mean and least of the transitions along a run, in blocks."""
    codes = np.frombuffer(run.encode(), dtype=np.uint8)
    if len(codes) < 2:
        return 0.0, 0.0
    total, least = 0.0, np.inf
    for at in range(0, len(codes) - 1, BLOCK):
        part = codes[at:at + BLOCK + 1]
        steps = transitions[part[:-1], part[1:]]
        total, least = total + steps.sum(), min(least, steps.min())
    return total / (len(codes) - 1), least


def covered(run: str, dictionary: frozenset[bytes]) -> float:
    """The share of characters that dictionary words cover, longest first from
    the left."""
    data, at, total = run.lower().encode(), 0, 0
    lengths = sorted({len(w) for w in dictionary if MIN_WORD <= len(w) <= LONGEST_INSIDE}, reverse=True)
    while lengths and at < len(data):
        size = next((n for n in lengths if at + n <= len(data) and data[at:at + n] in dictionary), 0)
        total, at = total + size, at + max(size, 1)
    return total / len(data)


def near_words(text: str, start: int, end: int) -> list[str]:
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    return re.findall(r"[a-z]{%d,}" % MIN_WORD, (before + " " + after).lower())


def dictionary_features(run: str, near: list[str], dictionary: frozenset[bytes]) -> tuple[float, float]:
    return covered(run, dictionary), sum(w.encode() in dictionary for w in near) / max(1, len(near))


def word_beginnings(dictionary: DataFrame) -> np.ndarray:
    """For every beginning of ``MIN_WORD`` letters, the lengths of the dictionary's
    words that have it, as bits: a table of 26 ** MIN_WORD numbers."""
    letters = [F.ascii(F.substring(F.col("word").cast("string"), k + 1, 1)) - 97 for k in range(MIN_WORD)]
    first = sum((letter * 26 ** (MIN_WORD - 1 - k) for k, letter in enumerate(letters)), F.lit(0))
    lengths = F.expr(f"shiftleft(1, octet_length(word) - {MIN_WORD})")
    inside = dictionary.where(F.octet_length("word") <= LONGEST_INSIDE)
    table = np.zeros(26 ** MIN_WORD, dtype=np.int32)
    for r in inside.groupBy(first.alias("first")).agg(F.bit_or(lengths).alias("lengths")).collect():  # at most 456,976 rows
        table[r["first"]] = r.lengths
    return table


def asked_words(run: str, near: list[str], beginnings: np.ndarray) -> Iterator[bytes]:
    """What :func:`dictionary_features` may find in the dictionary: the words
    around, and the parts of the run that begin as a word of their length does.
    A part may come more than once, but not twice from one block of the run."""
    yield from {w.encode() for w in near}
    for m in LETTERS.finditer(run.lower().encode()):
        word = m.group()
        for start in range(0, len(word) - MIN_WORD + 1, BLOCK):
            part = word[start:start + BLOCK + LONGEST_INSIDE - 1]
            codes = np.frombuffer(part, dtype=np.uint8).astype(np.int32) - 97
            last = min(BLOCK, len(part) - MIN_WORD + 1)
            first = sum(codes[k:k + last] * 26 ** (MIN_WORD - 1 - k) for k in range(MIN_WORD))
            lengths = beginnings[first]
            for n in range(MIN_WORD, min(LONGEST_INSIDE, len(part)) + 1):
                places = np.flatnonzero(lengths[:max(0, len(part) - n + 1)] & (1 << (n - MIN_WORD)))
                yield from {part[at:at + n] for at in places.tolist()}


def features(text: str, start: int, end: int, path: str | None, transitions: np.ndarray, dictionary: frozenset[bytes]) -> list[float]:
    run, path = text[start:end], path or ""
    classes = _classes(run)
    share = [classes.count(kind) / len(run) for kind in (b"0", b"1", b"2", b"3")]
    counts = np.array(list(Counter(run).values())) / len(run)
    stretches = longest = 0
    for m in SAME_CLASS.finditer(classes):
        stretches, longest = stretches + 1, max(longest, m.end() - m.start())
    mean_step, least_step = _steps(run, transitions)
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    inside, near = dictionary_features(run, near_words(text, start, end), dictionary)
    return [np.log(len(run)), *share, len(counts) / len(run), -(counts * np.log2(counts)).sum(), float(HEX.fullmatch(run) is not None),
            longest, (stretches - 1) / len(run), mean_step, least_step, inside,
            len(path), path.count("/"), float(EXAMPLE_PATH.search(path) is not None),
            float(NAMES.search(before[-24:]) is not None), float(ASSIGNED.search(before) is not None),
            float(before[-1:] in ("'", '"', "`") and after[:1] == before[-1:]),
            float(PLACEHOLDER.search(before + " " + after) is not None), float(PLACEHOLDER.search(run) is not None),
            near]


def decided(text: str, start: int, end: int) -> int:
    """The label of a finding that its context or format decides, else -1: 1 if
    it is assigned to a secret's name (and quoted, if it is no key run), 0 if
    it is a placeholder, a number or words and numbers joined by signs."""
    run = text[start:end]
    if PLACEHOLDER.search(run) or len(set(run)) <= min(4, len(run) // 4) or re.fullmatch(r"[0-9_/+=-]+", run):
        return 0
    before = text[max(0, start - CONTEXT):start]
    if NAMED.search(before) and not PLACEHOLDER.search(before):
        # prose has names of secrets before a colon too
        return 1 if before[-1:] in ("'", '"') or (0, len(run)) in key_runs(run) else -1
    return 0 if re.fullmatch(r"(?:[A-Za-z]+|[0-9]+)(?:[-_/+=](?:[A-Za-z]+|[0-9]+))+", run) else -1


def find_candidates(docs: DataFrame, transitions: np.ndarray, doc_id: str, text: str, path: str) -> DataFrame:
    """(doc_id, start, end, finding_sha256, decided, features, run, near) of
    every candidate. ``run`` and ``near`` are what the dictionary is asked
    for; until :func:`with_dictionary` its features are 0."""
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, value, place in zip(frame["doc_id"], frame["text"], frame["path"]):
                for start, end in candidates(value or ""):
                    rows.append((key, start, end, hashlib.sha256(value[start:end].encode()).hexdigest(), decided(value, start, end),
                                 [float(x) for x in features(value, start, end, place, transitions, frozenset())],
                                 value[start:end], near_words(value, start, end)))
            if rows:
                out = pd.DataFrame(rows, columns=["doc_id", "start", "end", "finding_sha256", "decided", "features", "run", "near"])
                out["doc_id"] = pd.Series(out["doc_id"].tolist(), dtype="Int64" if whole else object)
                yield out

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(path).cast("string").alias("path"))
    whole = rows.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    rest = "start int, end int, finding_sha256 string, decided int, features array<double>, run string, near array<string>"
    return rows.mapInPandas(find, StructType([rows.schema["doc_id"]] + StructType.fromDDL(rest).fields))


def with_dictionary(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``found`` with the features that the table ``dictionary`` (word) tells,
    without ``run`` and ``near``. Only words that candidates ask for are joined
    with it, and each candidate gets those of its own that it holds."""
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for nth, run, near in zip(frame["nth"], frame["run"], frame["near"]):
                for word in asked_words(run, near, beginnings):
                    rows.append((nth, word))
                    if len(rows) >= 100_000:
                        yield pd.DataFrame(rows, columns=["nth", "word"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["nth", "word"])

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            filled = []
            for values, run, near, known in zip(frame["features"], frame["run"], frame["near"], frame["known"]):
                values = list(values)
                known = frozenset() if known is None else frozenset(bytes(w) for w in known)
                values[INSIDE], values[NEAR] = dictionary_features(run, list(near), known)
                filled.append([float(x) for x in values])
            yield pd.DataFrame({"nth": frame["nth"], "features": pd.Series(filled, index=frame.index, dtype=object)})

    spark, beginnings = found.sparkSession, word_beginnings(dictionary)
    rows, rows_at = materialise(found.withColumn("nth", F.monotonically_increasing_id()), "secret-found")
    asked, asked_at = materialise(rows.select("nth", "run", "near").mapInPandas(ask, "nth long, word binary"), "secret-asked")
    held, held_at = materialise(asked.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(dictionary, "word", "left_semi"), "secret-held")
    # words that many candidates ask for are met where the candidates are
    known = join_hot(asked, held, ["word"], "n", asked.count()).groupBy("nth").agg(F.collect_set("word").alias("known"))
    told = rows.select("nth", "features", "run", "near").join(known, "nth", "left").mapInPandas(fill, "nth long, features array<double>")
    out, _ = materialise(rows.drop("features", "run", "near").join(told, "nth").drop("nth"), "secret-candidates")
    discard(spark, rows_at, asked_at, held_at)
    return out


def draw(findings: DataFrame, label: str, rows: int) -> DataFrame:
    """(features, label, weight): at most about ``rows`` distinct ones of the
    labelled findings. The chance to be drawn grows with the number of equal
    ones, up to certainty; the weight is that number over the chance, so that
    every kind counts as often as it is found."""
    equal = findings.groupBy("features", F.col(label).cast("double").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = equal.agg(F.sum("n").alias("n")).first().n or 1
    chance = F.least(F.lit(1.0), F.col("n") * (rows / total))
    drawn = equal.withColumn("chance", chance).where(
        F.pmod(F.xxhash64("features", "label"), F.lit(1 << 30)) < F.col("chance") * (1 << 30))
    return drawn.select("features", "label", (F.col("n") / F.col("chance")).alias("weight"))


def train(findings: DataFrame, label: str = "label") -> RandomForestClassificationModel | None:
    """A forest from labelled findings (``features`` and ``label`` 0 or 1), at
    most about ``MAX_FINDINGS`` distinct ones with weights. Without both labels
    there is nothing to learn, and no model."""
    given = findings.where(F.col(label).isin(0, 1))
    if given.agg(F.count_distinct(label).alias("labels")).first().labels < 2:
        return None
    drawn = draw(given, label, MAX_FINDINGS).withColumn("features", array_to_vector("features"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight").fit(drawn)


def judge(findings: DataFrame, model: RandomForestClassificationModel | None, cut: float = CUT) -> DataFrame:
    """``findings`` with ``score``, the forest's share of votes for a secret,
    and ``is_secret``. Without a model nothing is removed: every score is 1."""
    if model is None:
        return findings.withColumn("score", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    rated = model.transform(findings.withColumn("vector", array_to_vector("features"))
                            .withColumnRenamed("features", "values").withColumnRenamed("vector", "features"))
    rated = rated.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return (rated.drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("values", "features")
            .withColumn("is_secret", F.col("score") >= cut))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source",
         findings: DataFrame | None = None, held: str | None = None, cut: float = CUT) -> DataFrame:
    """All candidates of ``docs`` with ``score`` and ``is_secret``: ``doc_id,
    start, end`` (code points, end exclusive), ``finding_sha256, score,
    is_secret``; secrets themselves are not repeated.

    ``findings`` are labelled findings (``doc_id, start, end, label``); without
    them, those of the candidates that context or format decide train the
    forest. Documents for which the column ``held`` is true train nothing.

    Cases: null and empty texts have no candidate, a null path is an empty one.
    Rows that repeat an id are scanned each for itself; a null id stays null.
    An empty table gives an empty result; other columns are not looked at.
    """
    transitions, dictionary = corpus_statistics(docs, text)
    found = with_dictionary(find_candidates(docs, transitions, doc_id, text, path), dictionary)
    if findings is None:
        known = found.withColumn("label", F.col("decided"))
    else:
        known = found.join(findings.select("doc_id", "start", "end", "label"), ["doc_id", "start", "end"])
    if held is not None:
        out = docs.where(F.col(held)).select(F.col(doc_id).alias("doc_id")).distinct()
        known = known.join(out, "doc_id", "left_anti")
    return judge(found, train(known), cut).select("doc_id", "start", "end", "finding_sha256", "score", "is_secret")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out("doc_id", 5, 0))
    return scan(docs, held="held_out").withColumn("held_out", held_out("doc_id", 5, 0))
