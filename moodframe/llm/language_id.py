"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. A run of three letters is the
product of its letters' vectors, each rotated by its place; a text is the sum
of its trigrams' vectors, and a language the sum of its texts' directions. A
text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.llm.common import documents, held_out, rate_texts, worker_cache

DIMENSIONS = 1024
SEED = 20
UNDETERMINED = "und"
# Characters whose trigrams are bundled in one matrix product.
BATCH_CHARS = 200_000
# Directions are summed as integers, so that sums do not depend on their order.
SCALE = 1 << 20


class LetterVectors:
    """Random sign vectors by code point, made when a letter first occurs."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.is_letter = np.array([chr(c).isalpha() for c in range(0x110000)])
        self.row = np.full(0x110000, -1, dtype=np.int32)
        # by place in the trigram: rotated by two, by one, not at all
        self.signs = np.zeros((3, 0, dimensions), dtype=np.int8)

    def _vector(self, code: int) -> np.ndarray:
        bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dimensions)
        return (bits * 2 - 1).astype(np.int8)

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams, packed in 63 bits, and their counts. Anything but
        letters is a word end, written as 0; a text without letters has none."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(self.is_letter[codes], codes, 0).astype(np.int64)
        codes = np.concatenate(([0], codes, [0]))
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        if len(codes) < 3:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        parts = [grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF]
        new = [c for c in np.unique(np.concatenate(parts)).tolist() if self.row[c] < 0]
        if new:
            self.row[new] = np.arange(len(new)) + self.signs.shape[1]
            made = np.stack([self._vector(c) for c in new])
            made = np.stack([np.roll(made, 2, axis=1), np.roll(made, 1, axis=1), made])
            self.signs = np.concatenate([self.signs, made], axis=1)
        a, b, c = (self.signs[k][self.row[part]] for k, part in enumerate(parts))
        return (a * b * c).astype(np.float32)


def letter_vectors(dimensions: int, seed: int) -> LetterVectors:
    return worker_cache(("letters", dimensions, seed), lambda: LetterVectors(dimensions, seed))


def directions(texts: list[str | None], letters: LetterVectors) -> np.ndarray:
    """A unit vector for each text, zeros for one without letters."""
    out = np.zeros((len(texts), letters.dimensions), dtype=np.float32)
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (last == first or chars + len(texts[last] or "") <= BATCH_CHARS):
            chars += len(texts[last] or "")
            last += 1
        counted = [letters.trigrams(t or "") for t in texts[first:last]]
        grams = np.unique(np.concatenate([g for g, _ in counted]))
        counts = np.zeros((last - first, len(grams)), dtype=np.float32)
        for k, (own, n) in enumerate(counted):
            counts[k, np.searchsorted(grams, own)] = n
        # a very long text has many trigrams: bounded blocks of them at a time
        for at in range(0, len(grams), 8192):
            out[first:last] += counts[:, at:at + 8192] @ letters.vectors(grams[at:at + 8192])
        first = last
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norms, 1e-30)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", dimensions: int = DIMENSIONS,
          seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Prototypes of all languages of ``docs``: each task bundles its texts by
    language, Spark sums what the tasks bundled. Only a vector for each
    language comes to the driver."""
    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, sums = letter_vectors(dimensions, seed), {}
        for frame in frames:
            units = np.rint(directions(frame["text"].tolist(), letters) * SCALE).astype(np.int64)
            for name, rows in frame.groupby("lang").indices.items():
                sums[name] = sums.get(name, 0) + units[rows].sum(axis=0)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "total": [v.tolist() for v in sums.values()]})

    own = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    summed = (own.mapInPandas(bundle, "lang string, total array<bigint>")
              .select("lang", F.posexplode("total").alias("place", "value"))
              .groupBy("lang", "place").agg(F.sum("value").alias("value"))
              .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")))
    found = sorted((r.lang, [v.value for v in r.v]) for r in summed.collect())
    prototypes = np.array([v for _, v in found], dtype=np.float64).reshape(len(found), dimensions)
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return [name for name, _ in found], (prototypes / np.maximum(norms, 1e-30)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text",
             carry: tuple[str, ...] = ("doc_id",), seed: int = SEED) -> DataFrame:
    """The ``carry`` columns of every row with ``lang_pred`` and ``score``, the
    cosine with the language's prototype (0 to 1).

    Cases: a text that is null or has no letter gives ``und`` and 0, and so
    does every text if no language was learned. Of languages with the same
    cosine the first by name is taken. Repeated rows are scored each for
    itself; an empty table gives an empty result. Columns other than ``text``
    and ``carry`` are not looked at.
    """
    names, prototypes = model

    def make():
        letters = letter_vectors(prototypes.shape[1] if names else DIMENSIONS, seed)

        def predict(texts: pd.Series) -> dict:
            units = directions(texts.tolist(), letters)
            best, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
            known = units.any(axis=1) & bool(names)
            if known.any():
                cosines = units[known] @ prototypes.T
                best[known] = np.array(names, dtype=object)[cosines.argmax(axis=1)]
                score[known] = np.clip(cosines.max(axis=1), 0, 1)
            return {"lang_pred": best, "score": score}
        return predict

    return rate_texts(docs, text, carry, make, "lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out("doc_id", 4, 2))
    model = learn(docs.where(~F.col("held_out")))
    return identify(docs, model, carry=("doc_id", "held_out"))
