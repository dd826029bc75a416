"""Best-fit packing by minimum bin slack.

Documents are tokenised where they lie and cut into pieces. Only the number of
pieces of each length matters for the plan, and that histogram has at most
``capacity`` entries however large the corpus is. The plan is made from it:
for one bin, a bitset subset-sum over the available lengths finds the fullest
combination with the longest piece, the combination is used as often as the
counts allow, and it is removed. Every piece then finds its bin from its rank
among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodframe.llm.common import documents, materialise, worker_cache

CAPACITY = 2048
END = (0).to_bytes(4, "little")
# Words whose ids a Python worker keeps in each of two generations; when the
# younger is full it becomes the older one.
CACHED_WORDS = 700_000

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = re.compile(rb"([A-Za-z]+)([!-/:-@\[-`{-~]*)")


class WordIds:
    """Ids of whole texts, as little-endian 32-bit bytes, from those of words.

    The tokenizer cuts a text at white space and between letters and other
    signs before it merges, so a text's ids are those of its words in a row,
    and a word of letters that ends in punctuation has the ids of both parts.
    Words end at ASCII white space here; the tokenizer itself handles whatever
    else is inside them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _plain(self, part: bytes) -> bytes:
        """Ids of a run of lower-case ASCII letters, or of punctuation."""
        ids = self.young.get(part) or self.old.get(part)
        if ids is None:
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(part.decode())]).tobytes()
            self.young[part] = ids
        return ids

    def _encode(self, words: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        learned, others = {}, {}
        for word in missing:
            if m := PLAIN.fullmatch(word):
                core, tail = m.groups()
                learned[word] = self._plain(core.lower()) + (self._plain(tail) if tail else b"")
            else:
                text = word.decode("utf-8")
                core = text.rstrip(PUNCTUATION)
                letters = normalize("NFC", core).lower().isalpha()
                others[word] = (core, text[len(core):]) if letters else (text, "")
        cores = [c for c in dict.fromkeys(c for c, _ in others.values())]
        ids = dict(zip(cores, self._encode(cores)))
        for word, (core, tail) in others.items():
            learned[word] = ids[core] + (self._plain(tail.encode()) if tail else b"")
        return learned

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").split()
        own: dict[bytes, bytes | None] = dict.fromkeys(words)
        missing = []
        for word in own:
            ids = self.young.get(word)
            if ids is None:
                ids = self.old.get(word)
                if ids is None:
                    missing.append(word)
                    continue
                self.young[word] = ids
            own[word] = ids
        if missing:
            learned = self._learn(missing)
            own.update(learned)
            self.young.update(learned)
        if len(self.young) > CACHED_WORDS:
            self.young, self.old = {}, self.young
        return np.frombuffer(b"".join([*map(own.__getitem__, words), END]), dtype="<u4")


def word_ids(path: str) -> WordIds:
    """One per Python worker and tokenizer file."""
    return worker_cache(("word ids", path), lambda: WordIds(path))


def cut_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
               capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): the pieces, the
    task that cut each and its number among that task's pieces of its length."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_ids(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(value.as_py())
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start:start + capacity]
                    rows.append((key, piece, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, [batch.schema.field(0).type, pa.int32()] + [pa.int64()] * 5)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long")


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths, each used at most as often as counted, whose sum is the
    largest that fits in ``room``: a bitset whose bit s says that s is a sum."""
    reach, steps = 1, []
    within = (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[:room + 1])[::-1].tolist():
        left, take = min(int(counts[length]), room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & within
            left, take = left - take, take * 2
        if reach >> room:
            break
    target, used = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            used += [length] * take
            target -= length * take
    return used


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Minimum bin slack over a histogram of lengths (index: length).

    Returns the rows ``(length, first rank, how many of it a bin takes, first
    bin, offset of the first in the bin)`` in order of length and rank, and
    the number of bins.
    """
    counts, taken = counts.astype(np.int64).copy(), np.zeros(len(counts), dtype=np.int64)
    rows, bins = [], 0
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            combination = [longest] + fullest(counts, capacity - longest)
            counts[longest] += 1
            lengths, uses = np.unique(combination, return_counts=True)
            times, offset = int((counts[lengths] // uses).min()), 0
            for length, use in zip(lengths.tolist(), uses.tolist()):
                rows.append((length, taken[length], use, bins, offset))
                offset += length * use
                taken[length] += use * times
                counts[length] -= use * times
            bins += times
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5), bins


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. Pieces in a sequence leave no gap.

    Cases: a null or empty text is the end token alone. Rows that repeat an id
    or a text are packed each for itself, and a null id stays null. An empty
    table gives an empty result. Other columns are not looked at.
    """
    pieces, pieces_at = materialise(cut_pieces(docs, tokenizer, doc_id, text, capacity), "pack-pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts, counts_at = materialise(counts, "pack-counts")
    # at most ``capacity`` rows, whatever the size of the corpus
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    plan, _ = plan_bins(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(ranks, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = plan[:, 0].astype(np.float64) * 2.0 ** 40 + plan[:, 1]
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            row = plan[np.searchsorted(starts, length.astype(np.float64) * 2.0 ** 40 + rank, side="right") - 1]
            nth = rank - row[:, 1]
            frame["sequence_id"] = row[:, 3] + nth // row[:, 2]
            frame["offset"] = row[:, 4] + nth % row[:, 2] * length
            yield frame.drop(columns="rank")

    kind = docs.schema[doc_id].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                     "sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())
