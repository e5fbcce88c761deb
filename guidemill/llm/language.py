"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram binds (multiplies) its letters' vectors, the first
rotated by two places and the second by one; a text bundles (adds) its trigram vectors, and so does a language.  A text gets the
language whose profile has the greatest cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.llm.common import map_text

UNKNOWN = "und"
SPACE = 32


@lru_cache(1)
def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of three code points and their counts; what is no letter is one space, also at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letters = _letter_table()[points]
    if not letters.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.where(letters, points, SPACE)
    points = points[np.concatenate([[True], (points[1:] != SPACE) | (points[:-1] != SPACE)])]
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:], return_counts=True)


class Vectors:
    """Trigram vectors, made on demand from seeds and kept up to a bound."""

    def __init__(self, size: int, bound: int = 50_000):
        self.size, self.bound = size, bound
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, size), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng(point).integers(0, 2, self.size, np.int8) * 2 - 1
        return self.letters[point]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """int8 matrix with a row per trigram code."""
        if len(self.rows) + len(codes) > self.bound:
            self.rows.clear()
        wanted = codes.tolist()
        for code in wanted:
            if code not in self.rows:
                at = len(self.rows)
                if at == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                a, b, c = code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF
                self.table[at] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
                self.rows[code] = at
        return self.table[[self.rows[c] for c in wanted]]

    def bundle(self, codes: np.ndarray, counts: np.ndarray, step: int = 20_000) -> np.ndarray:
        total = np.zeros(self.size, np.float64)
        for at in range(0, len(codes), step):
            total += counts[at: at + step].astype(np.float32) @ self.of(codes[at: at + step]).astype(np.float32)
        return total


def language_profiles(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", size: int = 1024) -> dict[str, np.ndarray]:
    """Unit profile per language over all rows for which ``learn`` holds and the language is known.

    Each task adds up its trigram counts per language and sends one vector per language; these are summed in Spark
    dimension by dimension, so the driver receives languages x dimensions numbers whatever the input.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches):
        vectors, sums = Vectors(size), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found: dict[str, list] = {}
            for text, lang in zip(texts, langs):
                found.setdefault(lang, []).append(trigrams(text or ""))
            for lang, parts in found.items():
                codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([n for _, n in parts])) if len(codes) else np.zeros(0)
                sums[lang] = sums.get(lang, 0) + vectors.bundle(codes, counts)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vector.tolist()], pa.list_(pa.float64()))], names=["lang", "vector"])

    partial = rows.mapInArrow(run, "lang string, vector array<double>")
    sums = partial.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()
    profiles: dict[str, np.ndarray] = {}
    for r in sums:
        profiles.setdefault(r["lang"], np.zeros(size))[r["at"]] = r["value"]
    return {k: v / n for k, v in sorted(profiles.items()) if (n := np.linalg.norm(v))}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", size: int = 1024) -> DataFrame:
    """(all columns but the text, lang_pred, score): the most similar profile and its cosine, at least 0.

    A text that is null or has no letter, or any text without a profile to compare with, is ``und`` with score 0.
    Ties go to the first language by name.
    """
    names = sorted(profiles)
    matrix = np.array([profiles[n] for n in names]) if names else np.zeros((0, size))
    state: dict[str, Vectors] = {}

    def run(texts):
        vectors = state.setdefault("v", Vectors(size))
        langs, scores = [], []
        for text in texts:
            codes, counts = trigrams(text)
            if not len(codes) or not names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            own = vectors.bundle(codes, counts)
            cosines = matrix @ own / (np.linalg.norm(own) or 1.0)
            best = int(np.argmax(cosines))
            langs.append(names[best])
            scores.append(float(min(1.0, max(0.0, cosines[best]))))
        return [langs, scores]

    return map_text(docs, text_col, "lang_pred string, score double", run)
