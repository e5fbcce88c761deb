"""Document quality: random Fourier features, ridge regression and isotonic calibration.

Statistics of a whole text are standardised and mapped to random cosines, whose inner products approximate a
Gaussian kernel.  Ridge scores come from normal equations that each partition adds up and the driver solves;
isotonic regression on rows not used for them turns scores into probabilities.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.llm.common import bounded_sample, map_text, materialize

LOWER, UPPER, DIGIT, SPACE, NEWLINE, STOP, QUOTE, MARK, OTHER = range(9)
STATISTICS = 24


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = UPPER if x.isupper() else LOWER
        elif x.isdigit():
            table[c] = DIGIT
        elif x.isspace():
            table[c] = NEWLINE if x == "\n" else SPACE
        elif x in ".,;:!?":
            table[c] = STOP
        elif x in "'\"()-":
            table[c] = QUOTE
        elif c < 0x3000:
            table[c] = MARK
    return table


def statistics(text: str) -> np.ndarray:
    """Numbers that describe a whole text; an empty one has all zeros but the first."""
    out = np.zeros(STATISTICS)
    words = text.split()
    if not words:
        out[0] = 1.0
        return out
    n, chars = len(words), len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    share = np.bincount(_classes()[points], minlength=9) / chars
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    top = counts.most_common(3)
    lines = [x for x in text.split("\n") if x.strip()]
    line_counts = Counter(lines)
    p = np.fromiter(counts.values(), np.float64, len(counts)) / n
    same = sum(a == b for a, b in zip(words, words[1:]))
    out[1:10] = share
    out[10:] = [
        np.log1p(n), np.log1p(sizes.mean()), np.log1p(sizes.std()), np.log1p(sizes.max()), len(counts) / n, top[0][1] / n, sum(c for _, c in top) / n,
        same / n, -(p * np.log(p)).sum() / np.log(n + 1), np.log1p(n / len(lines)), 1 - len(line_counts) / len(lines),
        sum(not w[-1].isalnum() for w in words) / n, sum(w.isupper() for w in words) / n, sum(not any(c.isalnum() for c in w) for w in words) / n]
    return out


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by ``stats array<double>``."""
    def run(texts):
        flat = np.concatenate([statistics(t) for t in texts]) if texts else np.zeros(0)
        return [pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, STATISTICS, dtype=np.int32), pa.array(flat))]

    return map_text(docs, text_col, "stats array<double>", run)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    fitted: bool = True

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def isotonic(positions: np.ndarray, weights: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the increasing least-squares fit (pool adjacent violators)."""
    pools: list[list[float]] = []
    for x, w, m in zip(positions, weights, means):
        pools.append([x * w, w, m * w])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def _stack(pdf) -> np.ndarray:
    return np.vstack(pdf["stats"].to_numpy()) if len(pdf) else np.zeros((0, STATISTICS))


def fit_quality(rows: DataFrame, sample_rows: int = 100_000, waves: int = 256, ridge: float = 1e-2, seed: int = 7) -> QualityModel:
    """Fit on (id, stats, label) with label 0 or 1; rows with a null in them are left out.

    Learns from at most about ``sample_rows`` labelled rows chosen by a hash of their id; a fifth of them, by another
    hash, only calibrates.  Without any labelled row every text scores 0.5; with one class, that class.
    """
    kept = bounded_sample(rows.where("id IS NOT NULL AND stats IS NOT NULL AND label IS NOT NULL"), "id", sample_rows).repartition(16, "id")  # bounded, so few rows move
    kept = materialize(kept.select("stats", F.col("label").cast("double").alias("label"), (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0).alias("hold")), "labelled")

    def moments(batches):
        for pdf in batches:
            x = _stack(pdf)
            if len(x):
                yield pdf.iloc[:1].assign(n=float(len(x)), total=[x.sum(0).tolist()], square=[(x * x).sum(0).tolist()])[["n", "total", "square"]]

    parts = kept.mapInPandas(moments, "n double, total array<double>, square array<double>").collect()
    n = sum(r["n"] for r in parts)
    rng = np.random.default_rng(seed)
    if not n:
        return QualityModel(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros((STATISTICS, 1)), np.zeros(1), np.zeros(2), np.zeros(1), np.full(1, 0.5), fitted=False)
    mean = sum(np.array(r["total"]) for r in parts) / n
    scale = np.sqrt(np.maximum(sum(np.array(r["square"]) for r in parts) / n - mean**2, 0)) + 1e-6
    model = QualityModel(mean, scale, rng.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, waves)), rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.zeros(1), np.zeros(1))

    def normal(batches):
        gram, right = np.zeros((waves + 1, waves + 1)), np.zeros(waves + 1)
        for pdf in batches:
            pdf = pdf[~pdf["hold"]]
            z = model.features(_stack(pdf))
            gram += z.T @ z
            right += z.T @ pdf["label"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([gram.ravel().tolist()]), pa.array([right.tolist()])], names=["gram", "target"])

    def arrow_normal(batches):
        yield from normal(b.to_pandas() for b in batches)

    sums = kept.coalesce(16).mapInArrow(arrow_normal, "gram array<double>, target array<double>").collect()
    gram = sum(np.array(r["gram"]).reshape(waves + 1, waves + 1) for r in sums)
    model.weights = np.linalg.solve(gram + ridge * np.eye(waves + 1), sum(np.array(r["target"]) for r in sums))

    def bins(batches):
        for pdf in batches:
            raw = model.raw(_stack(pdf))
            yield pdf.assign(bin=np.round(np.clip(raw, -1, 2) * 200).astype("int32"), raw=raw)[["bin", "raw", "label", "hold"]]

    scored = kept.mapInPandas(bins, "bin int, raw double, label double, hold boolean")
    table = scored.where("hold").groupBy("bin").agg(F.avg("raw").alias("x"), F.count(F.lit(1)).alias("w"), F.avg("label").alias("y")).orderBy("bin").collect()
    table = table or scored.groupBy("bin").agg(F.avg("raw").alias("x"), F.count(F.lit(1)).alias("w"), F.avg("label").alias("y")).orderBy("bin").collect()
    model.knots, model.values = isotonic(*(np.array([r[c] for r in table], float) for c in ("x", "w", "y")))
    return model


def score_statistics(rows: DataFrame, model: QualityModel) -> DataFrame:
    """Replace ``stats`` by ``score double``."""
    names = [c for c in rows.columns if c != "stats"]

    def run(batches):
        for batch in batches:
            flat = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(model.score(flat), pa.float64())], names=names + ["score"])

    return rows.mapInArrow(run, rows.drop("stats").withColumn("score", F.lit(0.0)).schema)


def _sampled_labels(labels: DataFrame, learn: Column, id_col: str, label_col: str, sample_rows: int) -> DataFrame:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(learn & F.col("id").isNotNull() & F.col("label").isNotNull())
    return bounded_sample(known, "id", sample_rows)


def train_and_score(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                    sample_rows: int = 100_000, **options) -> DataFrame:
    """(id, learn, score) for every row of the documents, empty and null texts included.

    ``learn`` (over ``id``) says which labels may be used, at most about ``sample_rows`` of them; the text is read once.  Several
    labels of one id all count; repeated documents are scored each.
    """
    stats = materialize(with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "statistics")
    known = _sampled_labels(labels, learn, id_col, label_col, sample_rows)
    model = fit_quality(stats.join(F.broadcast(known), "id"), sample_rows, **options)  # bounded by sample_rows
    return score_statistics(stats, model)


def filter_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   threshold: float = 0.7, sample_rows: int = 100_000, **options) -> DataFrame:
    """The documents scored at ``threshold`` or more, with their columns.

    The model is fitted on a bounded sample of labels, whose texts alone are read for it; scoring is one narrow pass.
    Without labels nothing is known to be bad and all documents stay.
    """
    known = _sampled_labels(labels, learn, id_col, label_col, sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # bounded by sample_rows
    model = fit_quality(materialize(with_statistics(texts), "statistics"), sample_rows, **options)

    if not model.fitted:
        return docs

    def run(batches):
        for batch in batches:
            stats = np.array([statistics(t or "") for t in batch.column(text_col).to_pylist()]).reshape(-1, STATISTICS)
            yield batch.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(run, docs.schema)
