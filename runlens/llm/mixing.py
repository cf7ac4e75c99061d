"""Mixing documents to target weights of domains by soft membership.

A softmax classifier over hashed byte pairs, learnt from a labelled table, gives each document's domain posteriors p. Its
rate r >= 0 says how often the document is taken. Rates minimise the squared distance of the expected token totals
s = sum(tokens * r * p) from the targets, by projected gradient from r = 1: the step is p times the gradient of the K totals, scaled
by the inverse of their Gram matrix over documents with a positive rate, cut at 0 and halved when it would not help. As a
document's rate depends on its posteriors and the K numbers of each step alone, a step is one pass over a narrow table and
sends K + K * K sums.

The classifier is fitted on a bounded sample of labelled rows (``sample``, those of the least id hashes); posteriors, totals and
rates cover all rows. Labelled domains without a target have target 0. Where no budget is given, every rate is 1 at least: documents are
repeated, never lost.

Null and empty texts have the posteriors of an empty text, no tokens and a rate; texts of any length are taken whole; null ids are kept.
Labels without a domain or document are not learnt from; an id with several domains or texts counts with the least of each; with no
label at all each target domain is equally likely. Equal rows get equal rates, and copies by id. An empty table gives an empty result.
``resampled`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, id_text, map_arrow, pieces, raw_texts, stash, vector_sum

DIMS = 1024
#: Labelled rows that the classifier sees at most.
SAMPLE = 4096


def pair_features(text: bytes) -> np.ndarray:
    """Shares of hashed pairs of neighbouring bytes, square-rooted."""
    b = np.frombuffer(text, np.uint8).astype(np.int64)
    if len(b) < 2:
        return np.zeros(DIMS)
    return np.sqrt(np.bincount((b[:-1] * 2654435761 + b[1:] * 40503 >> 4) % DIMS, minlength=DIMS) / (len(b) - 1))


class Classifier:
    """Softmax regression with a bias, fitted by accelerated gradient steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 200, ridge: float = 1e-4):
        self.names = names
        self.w = np.zeros((DIMS + 1, len(names)))
        if not len(x):
            return
        x = np.hstack([x, np.ones((len(x), 1))])
        target = np.eye(len(names))[y]
        step = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + ridge)
        z = self.w.copy()
        for i in range(rounds):
            grad = x.T @ (softmax(x @ z) - target) / len(x) + ridge * z
            new = z - step * grad
            z = new + i / (i + 3) * (new - self.w)
            self.w = new

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return softmax(x @ self.w[:-1] + self.w[-1])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learn(docs: DataFrame, labelled: DataFrame, targets: list[str], sample: int = SAMPLE) -> Classifier:
    """A classifier from ``labelled(doc_id, domain)`` and the texts of at most ``sample`` of its rows; its domains are those of the
    targets and of the sample."""
    known = labelled.where("doc_id is not null and domain is not null").groupBy(F.col("doc_id").cast("long").alias("lid")).agg(F.min("domain").alias("domain"))
    chosen = stash(known.orderBy(F.xxhash64("lid"), "lid").limit(sample), "labelled")
    texts_ = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("lid")).groupBy("lid", "domain").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [pair_features(t).astype(np.float32).tobytes() for t in raw_texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("lid"), batch.column("domain"), pa.array(x, pa.binary())], ["lid", "domain", "x"])

    rows = sorted(map_arrow(texts_.select("lid", "domain", "text"), run, "lid long, domain string, x binary").collect(), key=lambda r: r["lid"])
    discard(chosen)
    names = sorted({*targets, *(r["domain"] for r in rows)}) if rows else sorted(targets)
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(-1, DIMS)
    return Classifier(x, np.array([names.index(r["domain"]) for r in rows], int), names)


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, p binary): white-space tokens and posteriors of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = raw_texts(batch)
        p = np.concatenate([model.posteriors(np.array([pair_features(t) for t in raw[lo : lo + 512]])) for lo in range(0, len(raw), 512)])
        cols = [batch.column("doc_id"), pa.array([len(t.split()) for t in raw], pa.int64()), pa.array([r.tobytes() for r in p], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "p"])

    return map_arrow(docs, run, "doc_id long, n_tokens long, p binary")


def unpacked(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("p").to_pylist())).reshape(batch.num_rows, k)


def rates_of(p: np.ndarray, steps: list[np.ndarray], least: float = 0.0) -> np.ndarray:
    """Rates after the given steps, each cut at ``least``."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(least, r - p @ g)
    return r


def totals(p: np.ndarray, tokens: np.ndarray, steps: list[np.ndarray], least: float = 0.0) -> np.ndarray:
    """Expected domain totals, and the Gram matrix of the documents whose rate is above the least (of all before the first step)."""
    r = rates_of(p, steps, least)
    live = tokens * (r > least) if steps else tokens
    return np.concatenate([(tokens * r) @ p, ((p * live[:, None]).T @ p).ravel()])


def solve(total_at, target: np.ndarray, rounds: int = 25) -> list[np.ndarray]:
    """Steps to the targets; ``total_at(steps)`` gives the sums of ``totals`` over all documents."""
    k, steps = len(target), []
    now = total_at(steps)
    size = max(1.0, float(np.abs(target).sum()))
    for _ in range(rounds):
        gap, gram = now[:k] - target, now[k:].reshape(k, k)
        loss = float(gap @ gap)
        if np.sqrt(loss) <= 1e-9 * size:
            break
        step = np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ gap
        for _ in range(6):
            then = total_at([*steps, step])
            if float(((then[:k] - target) ** 2).sum()) < loss:
                steps, now = [*steps, step], then
                break
            step = step / 2
        else:
            break
    return steps


def fit_rates(rows: DataFrame, weights: dict[str, float], names: list[str], budget: float | None = None) -> tuple[list[np.ndarray], float]:
    """Steps to the token totals ``budget * weight``, and the least rate.

    Without a budget it is the least that lets no domain with a target shrink, and a hundredth more, and no rate falls below 1.
    """
    k, least = len(names), 0.0 if budget is not None else 1.0

    def total_at(steps: list[np.ndarray]) -> np.ndarray:
        def sums(batch: pa.RecordBatch) -> np.ndarray:
            return totals(unpacked(batch, k), batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float), steps, least)

        return vector_sum(rows.select("n_tokens", "p"), sums, k + k * k)

    w = np.array([weights.get(n, 0.0) for n in names])
    w = w / w.sum()
    if budget is None:
        natural = total_at([])[:k]
        budget = 1.01 * max((natural[i] / w[i] for i in range(k) if w[i] > 0), default=0.0)
    return solve(total_at, budget * w), least


def copies(rate: Column, id_col: Column) -> Column:
    """Whole copies: the rate rounded up or down by a hash of the id, so that their mean is the rate."""
    u = F.pmod(F.xxhash64(F.lit("copies"), id_col), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + u).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, p_<domain> for each target or learnt domain, rate, copies) of every row."""
    base = id_text(docs, id_col, text_col)
    model = learn(base, labelled, list(weights), sample)
    names, k = model.names, len(model.names)
    rows = stash(memberships(base, model), "memberships")
    steps, least = fit_rates(rows, weights, names, budget)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = unpacked(batch, k)
        cols = [batch.column("doc_id"), batch.column("n_tokens"), *[pa.array(p[:, i]) for i in range(k)], pa.array(rates_of(p, steps, least))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", *(f"p_{n}" for n in names), "rate"])

    out = map_arrow(rows, run, "doc_id long, n_tokens long, " + "".join(f"`p_{n}` double, " for n in names) + "rate double")
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def resampled(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its rate says; texts are not shuffled."""
    rate = free_name(docs, "mix_rate")
    base = id_text(docs, id_col, text_col)
    model = learn(base, labelled, list(weights), sample)
    rows = stash(memberships(base, model), "memberships")
    steps, least = fit_rates(rows, weights, model.names, budget)
    discard(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            p = model.posteriors(np.array([pair_features(t) for t in raw_texts(batch, text_col)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates_of(p, steps, least))], [*batch.schema.names, rate])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{rate}` double"
    n = copies(F.col(rate), F.col(id_col).cast("long"))
    wide = docs.mapInArrow(run, fields)
    return wide.withColumn(rate, F.explode(F.array_repeat(F.lit(1), n))).drop(rate)


#: Target shares of languages in the query and the pipeline.
WEIGHTS = {"en": 0.55, "fr": 0.17, "de": 0.15, "es": 0.13}


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the query: languages of the documents that ``labels`` covers."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Query: posteriors, rate and copies of every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixed(docs, labelled_languages(docs, labels), WEIGHTS)
