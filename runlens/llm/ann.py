"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are halved and each half is quantised by k-means of its own (fitted on a bounded sample); a vector's cell is the pair of its
centroids. A query walks the pairs in descending order of the summed inner products of its halves with the centroids
until the cells hold a share of all distinct vectors, and all of their vectors are scored: by products of matrices, and those that may be
among its nearest on the original values in double precision. Every row is indexed.

The number of centroids grows with the table, so that there are about as many cells as vectors until each half has ``CENTROIDS``. The share is learnt
on the fitting sample: the least that finds ``recall`` of the true neighbours there, for queries and candidates that k-means has not
seen if the table is larger than the sample. Clustered vectors need a few hundredths, vectors without structure far more.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id or of another
dimension than the sample's most frequent one. Rows with the query's id are never its neighbours. Repeated rows are candidates
each, but count once towards the share; ties go to the smaller id. Query rows with equal id and vector are one query; an id with
several vectors has a list, ranked from 1, for each of them, told apart by ``query_hash``. A query with fewer candidates than ``k`` gets
all; an empty table gives an empty result. Columns other than the id, the vector and those of ``is_query`` are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, stash

#: Rows that k-means and the choice of the share see, those of the least id hashes: the bound of the fitting sample.
SAMPLE = 8192
#: Centroids of a half at most, and vectors of a cell that their number aims at.
CENTROIDS, CELL = 256, 1
#: Sample queries that the share is learnt on.
TRIALS = 512
#: Vectors of one cell that lie together; larger cells are dealt to several blocks.
BLOCK = 4096
#: Products of queries and vectors that a task holds at once.
SCORED = 1 << 21
#: Parts that the index has at least; more where parts would hold over 16 blocks of vectors.
SHARDS = 32


def usable(column, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of usable vectors and their values."""
    rows, out = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and (dim is None or len(v) == dim) and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                rows.append(i)
                out.append(x)
    return np.array(rows, np.int64), (np.array(out) if out and dim else out)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        label = nearest_centroid(x, c)
        total, count = np.zeros_like(c), np.bincount(label, minlength=len(c))
        np.add.at(total, label, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)


def walk(a: np.ndarray, b: np.ndarray, full: np.ndarray, weight: np.ndarray, want: int) -> np.ndarray:
    """Those of the cells ``full`` that come first in descending order of a[i] + b[j], until their ``weight`` reaches ``want``.

    Cells with equal sums are taken together.
    """
    sums = np.add.outer(a, b).ravel()[full]
    order = np.argsort(-sums)
    last = min(int(np.searchsorted(np.cumsum(weight[order]), want)), len(order) - 1)
    return full[~(sums < sums[order[last]])]


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up in the order of the components."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * v[:, d]
    return out


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query: by score, then smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    head = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.repeat(np.flatnonzero(head), np.diff(np.concatenate([np.flatnonzero(head), [len(q)]])))
    return order[place < k]


def centroids_for(n: int, sample: int) -> int:
    """Centroids of a half for ``n`` vectors: a power of two, with 16 sample vectors for each."""
    want = max(2.0, min(CENTROIDS, (n / CELL) ** 0.5, sample / 16))
    return 1 << int(np.log2(want))


def share_for(ca: np.ndarray, cb: np.ndarray, x: np.ndarray, k: int, recall: float) -> float:
    """The least share of the vectors ``x``, in the order of the walk, that holds ``recall`` of the k nearest of its queries.

    The queries are its first rows; each leaves itself out.
    """
    half, width = ca.shape[1], len(cb)
    cell = nearest_centroid(x[:, :half], ca) * width + nearest_centroid(x[:, half:], cb)
    size = np.bincount(cell, minlength=len(ca) * width)
    needed = []
    for i in range(min(TRIALS, len(x))):
        score = x @ x[i]
        score[i] = -np.inf
        best_ = np.argpartition(-score, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)] if len(x) > 1 else np.zeros(0, int)
        sums = (ca @ x[i, :half])[:, None] + (cb @ x[i, half:])[None, :]
        order = np.argsort(-sums.ravel(), kind="stable")
        reach = np.empty(len(order), np.int64)
        reach[order] = np.cumsum(size[order])
        needed.append(reach[cell[best_]])
    needed = np.concatenate(needed) if needed else np.zeros(0)
    return float(np.quantile(needed, recall)) / len(x) if len(needed) else 1.0


def key_hash(values: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(v) for v in values], np.uint64).view(np.int64)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.94,
    centroids: int | None = None,
    share: float | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score, query_hash) of the k nearest rows found for each row that ``is_query`` marks.

    ``centroids`` of a half and the ``share`` of distinct vectors that are scored for each query follow the table and the fitting
    sample where they are not given; what a query of the sample misses is then ``1 - recall``. In a sample of S of n rows the
    ``k * S / n`` nearest, one at least, stand for the k nearest of all.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    base = base.where("id is not null and v is not null")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_hash long")
    sample = base.orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(SAMPLE).select("v").collect()
    sizes = Counter(len(r["v"]) for r in sample if r["v"] and None not in r["v"])
    dim = max(sizes, key=lambda n: (sizes[n], n)) if sizes else 0
    fit = [np.array(r["v"], np.float64) for r in sample if r["v"] and None not in r["v"] and len(r["v"]) == dim]
    fit = [x for x in fit if np.isfinite(x).all() and x.any()]
    if not fit:
        return empty
    _, first_of = np.unique(np.array(fit), axis=0, return_index=True)
    x, half, n_rows = np.array(fit)[np.sort(first_of)], max(1, dim // 2), base.count()
    whole = n_rows <= SAMPLE
    seen = x if whole else x[len(x) // 4 :]
    tried = x if whole else x[: len(x) // 4]
    many = centroids or centroids_for(n_rows, len(seen))
    ca, cb = kmeans(seen[:, :half], many), kmeans(seen[:, half:], many) if dim > half else np.zeros((1, 0))
    cells = len(ca) * len(cb)
    if share is None:
        share = share_for(ca, cb, tried, max(1, round(k * len(tried) / max(n_rows, len(tried)))), recall)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, found = usable(batch.column("v"), dim)
            if not len(rows):
                continue
            cell = nearest_centroid(found[:, :half], ca) * len(cb) + nearest_centroid(found[:, half:], cb)
            at, raw = pa.array(rows), [r.tobytes() for r in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("query").take(at), pa.array(cell.astype(np.int32)), pa.array(key_hash(raw)), pa.array(raw, pa.binary())],
                ["id", "query", "cell", "h", "v"],
            )

    rows = stash(base.mapInArrow(index, "id long, query boolean, cell int, h long, v binary"), "cells")
    counts, distinct = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for r in rows.groupBy("cell", "h").count().groupBy("cell").agg(F.sum("count").alias("n"), F.count("*").alias("d")).collect():
        counts[r["cell"]], distinct[r["cell"]] = r["n"], r["d"]
    total = int(counts.sum())
    if not total:
        return empty
    want = max(int(np.ceil(share * distinct.sum())), k + 1)
    full = np.flatnonzero(counts)
    weight = distinct[full]
    blocks = np.maximum(1, -(-counts // BLOCK))
    shards = max(SHARDS, -(-total // (16 * BLOCK)))
    first = np.cumsum(blocks) - blocks  # number of each cell's first block
    schema = "shard int, query boolean, id long, h long, v binary, cells array<int>"
    names = ["shard", "query", "id", "h", "v", "cells"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors to the shard of their block."""
        for batch in pieces(batches):
            ids, cell, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "cell", "h"))
            spread = (ids ^ h).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            block = first[cell] + spread.astype(np.int64) % blocks[cell]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32)), pa.array(cell.astype(np.int32)))
            cols = [pa.array((block % shards).astype(np.int32)), pa.array(np.zeros(len(ids), bool)), batch.column("id"), batch.column("h"), batch.column("v"), lists]
            yield pa.RecordBatch.from_arrays(cols, names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to the shards of the blocks of the cells that they walk."""
        for batch in pieces(batches, 256):
            ids, h, raw = (batch.column(c) for c in ("id", "h", "v"))
            asking, shard_of, many, lists = [], [], [], []
            for i, v in enumerate(raw.to_pylist()):
                q = np.frombuffer(v)
                seen = walk(ca @ q[:half], cb @ q[half:], full, weight, want)
                size = blocks[seen]
                block = np.repeat(first[seen], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                pair = np.unique(block % shards * cells + np.repeat(seen, size))  # a cell may have several blocks in a shard
                shard, n = np.unique(pair // cells, return_counts=True)
                asking.append(np.full(len(shard), i))
                shard_of.append(shard)
                many.append(n)
                lists.append(pair % cells)
            at, ends = pa.array(np.concatenate(asking)), np.cumsum(np.concatenate(many))
            wanted = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(lists).astype(np.int32)))
            cols = [pa.array(np.concatenate(shard_of).astype(np.int32)), pa.array(np.ones(len(at), bool)), ids.take(at), h.take(at), raw.take(at), wanted]
            yield pa.RecordBatch.from_arrays(cols, names)

    asked = rows.where("query").dropDuplicates(["id", "h", "v"])
    dealt = rows.mapInArrow(deal, schema).unionByName(asked.mapInArrow(ask, schema))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "query")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, cell, v, held = None, [], [], [], None
        for batch in batches:
            number, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "query"))
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            for part in np.split(np.arange(batch.num_rows), cuts):
                if not len(part):
                    continue
                piece = batch.slice(int(part[0]), len(part))
                if number[part[0]] != shard:
                    shard, ids, cell, v, held = number[part[0]], [], [], [], None
                piece_ids = piece.column("id").to_numpy(zero_copy_only=False)
                values = np.frombuffer(b"".join(piece.column("v").to_pylist())).reshape(len(part), dim)
                if not asks[part[0]]:
                    ids.append(piece_ids)
                    cell.append(piece.column("cells").flatten().to_numpy())
                    v.append(values)
                    continue
                if not ids:
                    continue
                if held is None:  # vectors in the order of their cells
                    i, c, w = np.concatenate(ids), np.concatenate(cell), np.concatenate(v)
                    order = np.argsort(c, kind="stable")
                    start = np.flatnonzero(np.append(True, np.diff(c[order]) != 0))
                    held = i[order], w[order], c[order][start], np.append(start, len(c)), float(np.linalg.norm(w, axis=1).max())
                    ids, cell, v = [held[0]], [], []
                hashes = piece.column("h").to_numpy(zero_copy_only=False)
                step = max(1, SCORED // len(held[0]))
                for lo in range(0, len(part), step):
                    yield from answers(piece_ids[lo : lo + step], hashes[lo : lo + step], values[lo : lo + step], piece.column("cells").slice(lo, step), held)

    def answers(query_ids, hashes, q, wanted, held) -> Iterator[pa.RecordBatch]:
        ids, w, own_cells, start, longest = held
        lists = wanted.flatten().to_numpy()
        owner = np.repeat(np.arange(len(query_ids)), np.diff(wanted.offsets.to_numpy()))
        by_cell = np.argsort(lists, kind="stable")
        lists, owner = lists[by_cell], owner[by_cell]
        lo, hi = np.searchsorted(lists, own_cells, "left"), np.searchsorted(lists, own_cells, "right")
        rough = np.full((len(q), len(ids)), -np.inf)  # of the cells that are not walked
        for c in np.flatnonzero(hi > lo).tolist():
            asking, x, y = owner[lo[c] : hi[c]], start[c], start[c + 1]
            rough[asking, x:y] = q[asking] @ w[x:y].T
        rough[query_ids[:, None] == ids[None, :]] = -np.inf
        limit = np.full(len(q), -np.inf)
        if len(ids) > k:  # what the k-th product may hide: the two sums of products differ by their rounding alone
            limit = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
            limit = limit - 4 * dim * np.finfo(float).eps * np.linalg.norm(q, axis=1) * longest
        i, j = np.nonzero(~(rough < limit[:, None]) & (rough != -np.inf))
        if len(i):
            score = scores(q[i], w[j])
            keep = best(i, score, ids[j], k)
            cols = [query_ids[i[keep]], hashes[i[keep]], ids[j[keep]], score[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "query_hash", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, query_hash long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_hash")


def op3_nearest(spark, sf_dir: str) -> DataFrame:
    """Query: the 20 nearest rows found for every row whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
