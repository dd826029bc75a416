"""C1 with phrases: a lexicon whose entries may have several words.

A lexicon of a counted, bounded size becomes an automaton that every Python
worker builds once; a chunk is read through it a single time, whatever the number
of entries, and nothing is shuffled. A larger lexicon is joined with the word
sequences of the chunks. Both give the same scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from moodframe.operators.keyed import join_frequent
from moodframe.operators.scoring import DEFAULT_PRIORS, top1_from_sums
from moodframe.session import cut_lineage

# Characters of all entries up to which the automaton is used: a million entries
# of two words are 14 million, and take a worker 360 MB and six seconds to build.
MAX_CHARS = 16_000_000

_built: dict = {}


def word_sequence(text: str | Column, lowercase: bool = True) -> Column:
    """The words of a text with single blanks between them."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(text) if lowercase else text, r"\s+", " "))


def _automaton(key: str, packed: bytes):
    """The automaton of the entries and their weights, one row an entry. A worker
    keeps the one that it built last."""
    if key not in _built:
        import ahocorasick

        table = pa.ipc.open_stream(packed).read_all()
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for at, phrase in enumerate(table["phrase"].to_pylist()):
            machine.add_word(f" {phrase} ", at)
        machine.make_automaton()
        flat = table["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        _built.clear()
        _built[key] = machine, flat.reshape(table.num_rows, -1)
    return _built[key]


@dataclass
class PhraseScorer:
    """C1 scorer from a lexicon ``(phrase, label, weight)``.

    An entry is hit wherever its words stand in a row in the chunk, whole
    words only; entries that overlap or lie inside each other are all hit. With
    entries of one word the scores are those of ``LexiconScorer``: smoothed
    share of hits, ties by label name.

    Entries may repeat (their weights add up); entries without a word or of
    another label than ``priors`` has count nothing, nor does a null weight. A
    chunk without a hit has the largest prior's label. Keys are unique, as for
    every scorer. ``max_chars`` bounds the lexicon that is sent to the workers.
    """

    lexicon: DataFrame
    priors: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_PRIORS))
    lowercase: bool = True
    max_chars: int = MAX_CHARS

    @property
    def labels(self) -> list[str]:
        return sorted(self.priors)

    def entries(self) -> DataFrame:
        """``(phrase, weights)``: one row an entry, a weight for each of ``labels``."""
        known = self.lexicon.where(F.col("label").isin(self.labels)).select(
            word_sequence("phrase", self.lowercase).alias("phrase"), "label", F.col("weight").cast("double").alias("weight"))
        sums = [F.coalesce(F.sum(F.when(F.col("label") == l, F.col("weight"))), F.lit(0.0)) for l in self.labels]
        return known.where("phrase <> ''").groupBy("phrase").agg(F.array(*sums).alias("weights"))

    def score(self, chunks: DataFrame, key_cols: list[str] | None = None, chunk_col: str = "chunk") -> DataFrame:
        key_cols = key_cols or ["doc_id", "chunk_idx"]
        entries = cut_lineage(self.entries())
        size = entries.agg(F.coalesce(F.sum(F.length("phrase") + 2), F.lit(0)).alias("chars")).first().chars
        hits = self._by_automaton if size <= self.max_chars else self._by_join
        sums = [F.get("sums", F.lit(i)).alias(f"h{i}") for i in range(len(self.labels))]
        rows = chunks.select(*key_cols, word_sequence(F.coalesce(chunk_col, F.lit("")), self.lowercase).alias("words to score"))
        return top1_from_sums(hits(rows, key_cols, entries).select(*key_cols, *sums), key_cols, self.labels,
                              [self.priors[l] for l in self.labels], float(sum(self.priors.values())))

    def _by_automaton(self, rows: DataFrame, key_cols: list[str], entries: DataFrame) -> DataFrame:
        table, width = entries.toArrow(), len(self.labels)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        packed = rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
        key, any_entry = uuid.uuid4().hex, table.num_rows > 0
        schema = StructType(rows.select(*key_cols).schema.fields + StructType.fromDDL("sums array<double>").fields)
        kind = to_arrow_schema(schema).field("sums").type

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, weights = _automaton(key, packed.value) if any_entry else (None, np.zeros((0, width)))
            for batch in batches:
                sums = np.zeros((batch.num_rows, width))
                for at, text in enumerate(batch.column(len(key_cols))) if any_entry else ():
                    hit = [entry for _, entry in machine.iter(f" {text.as_py()} ")]
                    if hit:
                        # an entry that is hit a million times is added once
                        which, times = np.unique(np.array(hit), return_counts=True)
                        sums[at] = times @ weights[which]
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
                lists = pa.ListArray.from_arrays(ends, pa.array(sums.ravel())).cast(kind)
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(key_cols)], lists], names=schema.names)

        return rows.mapInArrow(find, schema)

    def _by_join(self, rows: DataFrame, key_cols: list[str], entries: DataFrame) -> DataFrame:
        """Every run of as many words as an entry has is joined with the entries;
        frequent ones meet theirs where they are."""
        lengths = entries.agg(F.sort_array(F.collect_set(F.size(F.split("phrase", " ")))).alias("n")).first().n
        def runs(words, n):
            # the words are a lambda variable, so the text is split once
            starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))
            return F.coalesce(F.transform(starts, lambda at: F.concat_ws(" ", *[F.get(words, at + k) for k in range(n)])),
                              F.array().cast("array<string>"))

        every = F.transform(F.array(F.split("words to score", " ")), lambda words: F.concat(
            F.array().cast("array<string>"), *[runs(words, n) for n in lengths]))
        spread = F.xxhash64(*key_cols).alias("spread by")
        met = rows.select(*key_cols, spread, F.explode_outer(F.flatten(every)).alias("phrase"))
        often = met.groupBy("phrase").agg(F.count(F.lit(1)).alias("times")).join(entries, "phrase")
        told = join_frequent(met, cut_lineage(often), "phrase", "times", "spread by")
        sums = [F.coalesce(F.sum(F.get("weights", F.lit(i))), F.lit(0.0)) for i in range(len(self.labels))]
        return told.groupBy(*key_cols).agg(F.array(*sums).alias("sums"))
