"""Quality scores by regularised quadratic discriminant analysis over document statistics.

Each class gets a mean and a covariance of transformed statistics; the covariance is shrunk to that of both classes
pooled, and then to a multiple of the identity. A score is the logistic of the difference of the classes' log densities (Mahalanobis
terms by triangular solves with Cholesky factors computed once) plus that of the log class shares.

Only statistics of the text enter a score. Sums for means and covariances are added up over all learning rows. A null
text counts as empty; empty texts have statistics (zeros) and scores like others. Labels other than 0 and 1 are not learnt from, nor are labels of no document; a
document with several labels counts once for each. Where a class has no rows every score is the share of the other, smoothed; without any label
it is 0.5. Repeated rows and ties need no rule: a score depends on the row's text alone. Texts of any length are taken whole. An empty
table gives an empty result. Columns of the results are those named; of ``docs`` the filter keeps all, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, discard, id_text, map_arrow, pieces, raw_texts, stash, vector_sum

NAMES = (
    "log_bytes log_words mean_word upper digits space breaks stops symbols bangs bars distinct top_word repeated capital_words entropy "
    "letters long_words"
).split()
D = len(NAMES)
_BYTE = np.arange(256)
_CLASSES = np.stack(
    [
        (_BYTE >= 65) & (_BYTE <= 90),
        (_BYTE >= 48) & (_BYTE <= 57),
        np.isin(_BYTE, [32, 9]),
        np.isin(_BYTE, [10, 13]),
        np.isin(_BYTE, [ord(c) for c in ".,;:?'\"-()"]),
        np.isin(_BYTE, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]),
        _BYTE == ord("!"),
        _BYTE == ord("|"),
        ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128),
    ]
).astype(np.float64)


#: Shares of a neutral text, and its size in bytes and words, by which shares are smoothed: in a short text one number or
#: capital is no sign of anything.
NEUTRAL = np.array([0.02, 0.0, 0.15, 0.005, 0.03, 0.0, 0.0, 0.0, 0.81])
NEUTRAL_BYTES, NEUTRAL_WORDS = 128, 20


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text: logarithms of counts, square roots of smoothed shares."""
    n = len(text)
    if not n:
        return [0.0] * D
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (_CLASSES @ hist + NEUTRAL_BYTES * NEUTRAL) / (n + NEUTRAL_BYTES)
    p = hist[hist > 0] / n
    words = text.split()
    m = len(words) + NEUTRAL_WORDS
    count = Counter(words)
    top = max(count.values()) if count else 0
    twice = sum(map(bytes.__eq__, words, words[1:]))
    capital = sum(map(bytes.isupper, words))
    long_words = sum(1 for w in words if len(w) > 12)
    of_words = [(len(count) + NEUTRAL_WORDS) / m, top / m, twice / m, capital / m]
    a = [np.log1p(n), np.log1p(len(words)), np.log1p((n + 6 * NEUTRAL_WORDS) / m)]
    return [*a, *np.sqrt(shares[:8]).tolist(), *np.sqrt(of_words).tolist(), float(-(p * np.log2(p)).sum()), float(shares[8]) ** 0.5, (long_words / m) ** 0.5]


def forward_solved(chol: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """z with ``chol @ z = row`` for every row, by forward substitution."""
    z = np.empty_like(rows)
    for i in range(len(chol)):
        z[:, i] = (rows[:, i] - z[:, :i] @ chol[i, :i]) / chol[i, i]
    return z


class Model:
    """Class means, Cholesky factors of shrunk covariances and log class shares."""

    def __init__(self, total: np.ndarray, pooled: float = 0.3, ridge: float = 0.02):
        block = 1 + D + D * D
        self.n = [float(total[c * block]) for c in (0, 1)]
        self.share = float(np.log((self.n[1] + 1) / (self.n[0] + 1)))
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] = []
        if min(self.n) < 2:
            return
        means, covs = [], []
        for c in (0, 1):
            part = total[c * block : (c + 1) * block]
            mean = part[1 : 1 + D] / self.n[c]
            means.append(mean)
            covs.append(part[1 + D :].reshape(D, D) / self.n[c] - np.outer(mean, mean))
        both = (self.n[0] * covs[0] + self.n[1] * covs[1]) / sum(self.n)
        self.scale = np.sqrt(np.maximum(np.diag(both), 1e-10))
        for mean, cov in zip(means, covs):
            mixed = ((1 - pooled) * cov + pooled * both) / np.outer(self.scale, self.scale)
            mixed = (1 - ridge) * mixed + ridge * max(np.trace(mixed) / D, 1e-6) * np.eye(D)
            chol = np.linalg.cholesky(mixed + 1e-9 * np.eye(D))
            self.classes.append((mean, chol, 2 * float(np.log(np.diag(chol)).sum())))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), 1 / (1 + np.exp(-self.share)))
        density = []
        for mean, chol, logdet in self.classes:
            z = forward_solved(chol, (x - mean) / self.scale)
            density.append(-0.5 * ((z * z).sum(axis=1) + logdet))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.share, -500, 500)))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x binary): statistics of every row as packed doubles."""
    return map_arrow(id_text(docs, id_col, text_col), described, "doc_id long, x binary")


def described(batch: pa.RecordBatch) -> pa.RecordBatch:
    x = [np.array(statistics(t)).tobytes() for t in raw_texts(batch)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary())], ["doc_id", "x"])


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist())).reshape(batch.num_rows, D)


def learnable(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(lid, y) of labels that a model may learn from."""
    known = labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("y"))
    return known.where("y in (0, 1) and lid is not null").where(~held_out(F.col("lid")))


def fit(rows: DataFrame, known: DataFrame) -> Model:
    """Learn from statistics ``rows(doc_id, x)`` and labels ``known(lid, y)``; what the driver receives is a fixed number of sums."""
    joined = rows.join(known, F.col("doc_id") == F.col("lid")).select("x", "y")
    block = 1 + D + D * D

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        x, y, out = matrix(batch), batch.column("y").to_numpy(zero_copy_only=False), np.zeros(2 * block)
        for c in (0, 1):
            own = x[y == c]
            out[c * block : (c + 1) * block] = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        return out

    return Model(vector_sum(joined, sums, 2 * block))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score) of every row."""
    rows = stash(features(docs, id_col, text_col), "statistics")
    model = fit(rows, learnable(labels, id_col, label_col))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(matrix(batch)))], ["doc_id", "score"])

    return map_arrow(rows, run, "doc_id long, score double")


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of ``least`` or more; texts are not shuffled.

    The model learns from the statistics of documents whose ids a filter of the labelled ids lets through, and the join decides.
    """
    known = stash(learnable(labels, id_col, label_col), "labels")
    ids = Bitmap.of(known.select(F.xxhash64("lid").alias("h")), "h")

    def labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(ids.may_hold(batch.column("h").to_numpy(zero_copy_only=False))))

    some = id_text(docs, id_col, text_col).withColumn("h", F.xxhash64("doc_id"))
    rows = stash(map_arrow(map_arrow(some, labelled, some.schema), described, "doc_id long, x binary"), "statistics")
    model = fit(rows, known)
    discard(known, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = np.array([statistics(t) for t in raw_texts(batch, text_col)])
            yield batch.filter(pa.array(model.scores(x) >= least))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Query: score of every document."""
    scored = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
