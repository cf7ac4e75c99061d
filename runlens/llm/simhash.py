"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Two fingerprints link when they
differ in ``tau`` or fewer of 64 bits; linked fingerprints form components.

Search: bits are grouped into m parts, correlated bits together. For every fingerprint q a threshold vector T with
sum(T) = tau - m + 1 (each at least -1) is chosen; whatever lies within tau of q then lies within T[i] of it in some
part i. T is found by dynamic programming over the parts on estimated candidate counts, which come from
histograms of sub-parts of at most 11 bits (fixed size at any number of fingerprints). Every fingerprint is indexed by
its exact value in each part and probes all values in its balls; each hit is verified on all 64 bits.

Nulls, empty texts, ties: a null text counts as empty; a text without words has fingerprint 0, which links like any
other; fewer words than a shingle make one shingle. A bit set in exactly half of the shingles is 0. Rows with a null id
get a component like others; ids are compared without them. Equal rows stay separate rows with equal results. Texts of any length are
taken whole, in pieces of some thousand shingles. Only the id and the text are read, so other columns cannot clash; ``near_dedup`` keeps
all columns, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, discard, free_name, id_text, map_arrow, pieces, raw_texts, stash, vector_sum
from .graph import components

BITS = 64
#: Data rows of one block of a large bucket; probes of the bucket visit each of its blocks.
BLOCK = 2048
#: Pairs compared at once in a task (bounds its memory).
PAIRS = 1 << 20
#: Buckets in which shingles are counted to order them by frequency: one number each at any number of shingles.
SKETCH = 1 << 16
#: Texts that share a shingle and lie together; more are split in pairs of blocks.
SHARED = 512


def shingle_hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 values of a text's lower-case k-word shingles in order, in pieces (fewer words: the whole sequence; none: nothing).

    Words are found as offsets in one buffer, so that a text of millions of words takes little more than its own size.
    """
    joined, xx = b" ".join(text.lower().split()), xxhash.xxh64_digest
    if not joined:
        return
    cut = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(cut) + 2 - k)
    start, end = np.concatenate([[0], cut + 1])[:n], np.concatenate([cut, [len(joined)]])[-n:]
    for lo in range(0, n, 1 << 13):
        digests = [xx(joined[x:y], 42) for x, y in zip(start[lo : lo + (1 << 13)].tolist(), end[lo : lo + (1 << 13)].tolist())]
        yield np.frombuffer(b"".join(digests), ">u8")


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, words_per_shingle):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id long, fp long) of every row; fp holds the 64 bits as a signed number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words_per_shingle) for t in raw_texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, fp long")


# ---------------------------------------------------------------- the plan of parts


def grouped_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """Bits dealt into m parts of near-equal width, each grown greedily by the bit most correlated with it."""
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    free, out = set(range(corr.shape[0])), []
    strength = np.abs(corr) - np.eye(BITS) * np.abs(corr)
    for width in widths:
        seed = max(sorted(free), key=lambda b: strength[b, sorted(free)].sum())
        part = [seed]
        free.discard(seed)
        while len(part) < width:
            best = max(sorted(free), key=lambda b: strength[b, part].sum())
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that the given bits of each fingerprint spell."""
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def subparts(bits: list[int]) -> list[list[int]]:
    n = -(-len(bits) // 11)
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


class Plan:
    """Parts, and the histogram tables from which candidate counts are estimated. Its size is fixed."""

    def __init__(self, parts: list[list[int]], tau: int, n: int):
        self.parts, self.tau, self.n = parts, tau, n
        self.subs = [subparts(p) for p in parts]
        self.near: list[list[np.ndarray]] = []

    def width(self) -> int:
        return sum(1 << len(s) for part in self.subs for s in part)

    def count(self, fp: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(gather(fp, s).astype(np.int64), minlength=1 << len(s)) for p in self.subs for s in p])

    def learn(self, counts: np.ndarray) -> None:
        """Share of fingerprints at distance exactly 0..tau from each value of each sub-part."""
        at = 0
        for part in self.subs:
            tables = []
            for s in part:
                hist = counts[at : at + (1 << len(s))] / max(1, self.n)
                at += 1 << len(s)
                v = np.arange(1 << len(s))
                table = np.zeros((len(v), self.tau + 1))
                for d in range(self.tau + 1):
                    for flips in combinations(range(len(s)), d):
                        table[:, d] += hist[v ^ sum(1 << b for b in flips)]
                tables.append(table)
            self.near.append(tables)

    def allocate(self, fp: np.ndarray) -> np.ndarray:
        """For each fingerprint the thresholds of least estimated cost, by dynamic programming over the parts."""
        n, m, tau = len(fp), len(self.parts), self.tau
        budget = tau - m + 1
        low, states = -m, budget + 2 * m + 1
        best = np.full((n, states), np.inf)
        best[:, -low] = 0
        came = np.zeros((m, n, states), np.int8)
        for i, (part, tables) in enumerate(zip(self.subs, self.near)):
            exact = np.zeros((n, tau + 1))
            exact[:, 0] = 1
            for s, table in zip(part, tables):
                own, joint = table[gather(fp, s).astype(np.int64)], np.zeros((n, tau + 1))
                for a in range(tau + 1):
                    for b in range(tau + 1 - a):
                        joint[:, a + b] += exact[:, a] * own[:, b]
                exact = joint
            cost = self.n * np.cumsum(exact, axis=1) + np.cumsum([comb(len(self.parts[i]), d) for d in range(tau + 1)])
            new = np.full((n, states), np.inf)
            for t in range(-1, tau + 1):
                c = cost[:, t] if t >= 0 else np.zeros(n)
                for s in range(states):
                    if 0 <= s - t < states:
                        total = best[:, s - t] + c
                        less = total < new[:, s]
                        new[less, s] = total[less]
                        came[i, less, s] = t
            best = new
        out, s = np.zeros((n, m), np.int8), np.full(n, budget - low)
        for i in reversed(range(m)):
            out[:, i] = came[i, np.arange(n), s]
            s = s - out[:, i]
        return out


def chosen_parts(tau: int, n: int) -> int:
    """Number of parts of least cost for n fingerprints, where a shuffled probe counts as 100 comparisons; any number gives the same results."""

    def cost(m: int) -> float:
        width, budget = BITS // m, tau - m + 1
        if budget < -m:
            return float("inf")
        t = [budget // m + (i < budget % m) for i in range(m)]
        probes = sum(sum(comb(width, d) for d in range(x + 1)) for x in t)
        return m + probes * (1 + n / 2.0**width / 100)

    return min(range(2, 9), key=cost)


def plan(distinct: DataFrame, tau: int, parts: int | None = None) -> Plan:
    """Bit correlations and histograms over all fingerprints, summed over tasks (4,096 and at most 12,288 numbers)."""

    def fps(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)

    def bits(fp: np.ndarray) -> np.ndarray:
        return np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = bits(fps(batch))
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    total = vector_sum(distinct.select("fp"), moments, 1 + BITS + BITS * BITS)
    n = int(total[0])
    mean = total[1 : 1 + BITS] / max(1, n)
    cov = total[1 + BITS :].reshape(BITS, BITS) / max(1, n) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    out = Plan(grouped_bits(cov / np.outer(sd, sd), parts or chosen_parts(tau, n)), tau, n)
    out.learn(vector_sum(distinct.select("fp"), lambda batch: out.count(fps(batch)), out.width()))
    return out


# ---------------------------------------------------------------- candidates and links


def signatures(distinct: DataFrame, p: Plan) -> DataFrame:
    """(key, fp, probe) rows: each fingerprint under its value in every part, and every value that it probes."""
    masks = [
        [np.array([sum(1 << b for b in c) for c in combinations(range(len(part)), d)], np.uint64) for d in range(p.tau + 1)]
        for part in p.parts
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(every), 4096):
                fp = every[lo : lo + 4096]
                t, keys, owners, probes = p.allocate(fp), [], [], []
                for i, part in enumerate(p.parts):
                    value, tag = gather(fp, part), np.uint64(i) << np.uint64(60)
                    keys.append(value | tag)
                    owners.append(fp)
                    probes.append(np.zeros(len(fp), bool))
                    for d in range(p.tau + 1):
                        who = np.flatnonzero(t[:, i] >= d)
                        if len(who):
                            keys.append(((value[who, None] ^ masks[i][d][None, :]) | tag).ravel())
                            owners.append(np.repeat(fp[who], len(masks[i][d])))
                            probes.append(np.ones(len(keys[-1]), bool))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.concatenate(owners).view(np.int64)),
                        pa.array(np.concatenate(probes)),
                    ],
                    ["key", "fp", "probe"],
                )

    return distinct.select("fp").mapInArrow(run, "key long, fp long, probe boolean")


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the edges (a, b) that reach what all of them reach, fewer than there are nodes.

    Each component takes one edge to a component of a smaller label, until none is left.
    """
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ix[: len(a)], ix[len(a) :]
    label, kept = np.arange(len(nodes)), [np.zeros(0, np.int64)]
    while len(cross := np.flatnonzero(label[x] != label[y])):
        p, q = label[x[cross]], label[y[cross]]
        high, one = np.unique(np.maximum(p, q), return_index=True)
        kept.append(cross[one])
        up = np.arange(len(nodes))
        up[high] = np.minimum(p, q)[one]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    kept_ = np.concatenate(kept)
    return a[kept_], b[kept_]


def links(distinct: DataFrame, tau: int = 3, parts: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within ``tau`` bits, with the same components as all such edges.

    Buckets with over ``BLOCK`` indexed fingerprints are split in blocks, and their probes in as many; each block of the one meets each
    of the other in a task of its own, which holds the indexed block and streams the probes. A task keeps as many of the edges that it
    sees as connect what they connect. No cap applies.
    """
    p = plan(distinct, tau, parts)
    rows = signatures(distinct, p)
    full = signatures_of_data(distinct, p).groupBy("key").count().where(F.col("count") > BLOCK)
    full = stash(full.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "full")
    rows = rows.join(full, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    all_ = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "fp", "probe", own.alias("own"), all_)
    block = F.when(F.col("probe"), F.struct(F.col("other").alias("d"), F.col("own").alias("p"))).otherwise(F.struct(F.col("own").alias("d"), F.col("other").alias("p")))
    rows = rows.select("key", "fp", "probe", (F.shiftleft(block["d"].cast("long"), 32) + block["p"]).alias("block"))
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, block, fp, probe = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "fp", "probe"))
            fp = fp.view(np.uint64)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            n_data = np.add.reduceat(~probe, start).astype(np.int64)
            first = 0
            found: list[tuple[np.ndarray, np.ndarray]] = []
            if held_key == (key[0], block[0]):  # a group that began in an earlier batch
                s, e, d = start[0], stop[0], n_data[0]
                held = np.concatenate([held, fp[s : s + d]])
                found += compared(held, fp[s + d : e], tau)
                first = 1
            # Groups within the batch, all at once: each probe row meets the data rows of its group.
            size = stop - start
            want = np.flatnonzero((n_data > 0) & (size > n_data))
            want = want[want >= first]
            big = want[n_data[want] * (size - n_data)[want] > PAIRS]
            for g in big:
                found += compared(fp[start[g] : start[g] + n_data[g]], fp[start[g] + n_data[g] : stop[g]], tau)
            want = np.setdiff1d(want, big)
            weight = np.cumsum(n_data[want] * (size - n_data)[want])
            for lo, hi in slices(weight, PAIRS):
                found += flat(fp, start[want[lo:hi]], n_data[want[lo:hi]], stop[want[lo:hi]], tau)
            last = len(start) - 1
            if last >= first:
                held_key = (key[-1], block[-1])
                held = fp[start[last] : start[last] + n_data[last]].copy()
            if found:
                a, b = spanning(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def signatures_of_data(distinct: DataFrame, p: Plan) -> DataFrame:
    """(key) of the indexed rows alone, for counting buckets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        keys = [gather(fp, part) | (np.uint64(i) << np.uint64(60)) for i, part in enumerate(p.parts)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], ["key"])

    return map_arrow(distinct.select("fp"), run, "key long")


def slices(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(weight):
        base = weight[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(weight, base + most, "right")))
        yield lo, hi
        lo = hi


def flat(fp: np.ndarray, start: np.ndarray, n_data: np.ndarray, stop: np.ndarray, tau: int):
    """Verified pairs of many small groups, whose rows are data first and then probes."""
    n_probe = stop - start - n_data
    pairs = n_data * n_probe
    g = np.repeat(np.arange(len(start)), pairs)
    k = np.arange(len(g)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    x = fp[start[g] + k % n_data[g]]
    q = fp[start[g] + n_data[g] + k // n_data[g]]
    near = (x != q) & (np.bitwise_count(x ^ q) <= tau)
    return [(q[near], x[near])]


def compared(data: np.ndarray, probes: np.ndarray, tau: int):
    """Verified pairs of one large group, as few as connect them: blocks of probes against all its data rows."""
    out, step = [], max(1, PAIRS // max(1, len(data)))
    if not len(data):
        return out
    for lo in range(0, len(probes), step):
        q = probes[lo : lo + step]
        i, j = np.nonzero(np.bitwise_count(q[:, None] ^ data[None, :]) <= tau)
        a, b = q[i], data[j]
        keep = a != b
        if keep.any():
            out.append(spanning(a[keep], b[keep]))
    return out


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, tau: int = 3, parts: int | None = None
) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links, itself included.

    Copies are one node of the link graph: rows are brought down to distinct fingerprints, combined map-side, before any
    search. An empty table gives an empty result; component_id is null if no row of the component has an id.
    """
    rows = stash(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = components(links(distinct, tau, parts)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = distinct.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(named.join(least, "root").select("fp", "component_id", "root"), "named")
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id", "root")


# ---------------------------------------------------------------- verified groups and deduplication


def word_set_fingerprint(text: bytes) -> int:
    """SimHash of a text's distinct lower-case words: near copies are far closer than in one of long shingles."""
    words = set(text.lower().split())
    if not words:
        return 0
    digests = np.frombuffer(b"".join([xxhash.xxh64_digest(w, 42) for w in words]), np.uint8)
    ones = np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(words)).tobytes(), "big")


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct XXH64 values of k-word shingles (fewer words: the whole sequence; none: the empty set)."""
    made = list(shingle_hashes(text, k))
    return np.unique(np.concatenate(made).astype(np.uint64)) if made else np.zeros(0, np.uint64)


def bucket_counts(shingles: np.ndarray) -> bytes:
    """How many of a set's values each bucket has; nothing if some bucket has over 255."""
    n = np.bincount((shingles % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def may_share(x: bytes, y: bytes, similarity: float) -> bool:
    """False if the counts of two sets leave no room for the similarity: they share at most the lesser of each bucket."""
    if not x or not y:
        return True
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = int(np.minimum(a, b).sum(dtype=np.int64))
    return n >= similarity * (int(a.sum(dtype=np.int64)) + int(b.sum(dtype=np.int64)) - n) - 1e-9


def shingle_ranks(texts: DataFrame, k: int) -> np.ndarray:
    """Twice the binary logarithm of the number of shingles in each bucket, over all texts."""

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        sets = np.concatenate([shingle_set(t, k) for t in raw_texts(batch)])
        return np.bincount((sets % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)

    return (2 * np.log2(np.maximum(vector_sum(texts, counts, SKETCH), 1))).astype(np.uint8)


#: How often chains are tried before all pairs, the least hashes that order a chain, and how many of them neighbours share.
TURNS, MINS, ALIKE = 4, 5, 3
#: Shingles of over ``SHARED`` texts that a text brings along when it meets others under them, and from how many, the largest, they come.
BROUGHT, HOTTEST = 32, 1 << 16
#: Buckets of a set's counts, which bound what two sets share.
BUCKETS = 512
#: Odd factors that permute 64-bit hashes: one for each least hash.
FACTORS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1 | 1 for i in range(TURNS * MINS)], np.uint64)


def first_shingles(texts: DataFrame, k: int, least: float) -> DataFrame:
    """(th, size, shingles, mins) of texts(th, text): the size of each set, its first shingles, rare ones first, and its least hashes.

    All sets are ordered alike, by the counts of the shingles' buckets, then by value. Of n shingles that the smaller set of a similar
    pair has, ``least * n`` are shared at least, so the first shared one is among the first n - ceil(least * n) + 1 of each set: these
    are kept. The order decides only how many sets meet under a shingle. A least hash of two sets is equal as often as they are similar.
    """
    ranks = shingle_ranks(texts, k)

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, made, mins = [], [], []
        for t in raw_texts(batch):
            s = shingle_set(t, k)
            mins.append(b"".join([int((s * f).min()).to_bytes(8, "big") for f in FACTORS]) if len(s) else b"")
            s = s[np.argsort(ranks[(s % np.uint64(SKETCH)).astype(np.int64)], kind="stable")]
            size.append(len(s))
            made.append(s[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1].tobytes())
        cols = [batch.column("th"), pa.array(size, pa.int32()), pa.array(made, pa.binary()), pa.array(mins, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["th", "size", "shingles", "mins"])

    return map_arrow(texts, first, "th long, size int, shingles binary, mins binary")


def shingle_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    every = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
    return np.concatenate(every), np.array([len(x) for x in every], np.int64)


def with_roots(made: DataFrame, roots: DataFrame, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = "") -> DataFrame:
    """``made``, or what ``then`` makes of it, with the root of each text ``th``, itself for texts that ``roots`` does not have; most rows
    stay where they are."""
    known = Bitmap.of(roots.select("th"), "th")

    def part(held: bool) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            may = known.may_hold(batch.column("th").to_numpy(zero_copy_only=False))
            return batch.filter(pa.array(may if held else ~may))

        out = map_arrow(made, run, made.schema)
        return map_arrow(out, then, schema) if then else out

    return part(False).withColumn("root", F.col("th")).unionByName(part(True).join(roots, "th", "left").withColumn("root", F.coalesce("root", "th")))


def common_keys(made: DataFrame) -> DataFrame:
    """(key, n) of first shingles of more than ``SHARED`` texts."""

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shingle_keys(batch)[0])], ["key"])

    return map_arrow(made, told, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SHARED)


def chains(made: DataFrame, roots: DataFrame, keys: DataFrame, least: float, turn: int) -> DataFrame:
    """Pairs (a, b) of texts of different roots that follow each other under a common shingle, in the order of the turn's least hashes.

    Texts whose least hashes are equal, as far as they are, are neighbours, and likely to be similar if ``ALIKE`` are; there are as many
    pairs as texts under a shingle, not their square. A shingle's texts are dealt to groups by the first of the hashes. In a large
    group of near copies this makes most roots one before all pairs are tried.
    """
    common = Bitmap.of(keys, "key")
    width = 8 * MINS

    def exploded(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, n = shingle_keys(batch)
        stay = common.may_hold(key)
        at = np.repeat(np.arange(len(n)), n)[stay]
        order = pa.array([m[turn * width : (turn + 1) * width] for m in batch.column("mins").to_pylist()], pa.binary()).take(pa.array(at))
        cols = [pa.array(key[stay]), *(batch.column(c).take(pa.array(at)) for c in ("th", "size")), order]
        return pa.RecordBatch.from_arrays(cols, ["key", "th", "size", "order"])

    rows = with_roots(made, roots, exploded, "key long, th long, size int, order binary").join(keys, "key")
    group = F.pmod(F.xxhash64(F.substring("order", 1, 8)), F.ceil(F.col("n") / SHARED))
    r = F.struct("root", "size", "th", "order").alias("r")
    before = F.lag(F.struct("root", "size", "th", "order")).over(Window.partitionBy("key", group).orderBy("order", "th"))
    pairs = rows.select(before.alias("p"), r).where(F.col("p").isNotNull() & (F.col("p.root") != F.col("r.root")))
    pairs = pairs.where(F.least("p.size", "r.size") >= least * F.greatest("p.size", "r.size") - 1e-9)
    same = [(F.substring("p.order", 1 + 8 * i, 8) == F.substring("r.order", 1 + 8 * i, 8)).cast("int") for i in range(MINS)]
    pairs = pairs.where(sum(same[1:], same[0]) >= ALIKE)
    return pairs.select(F.least("p.th", "r.th").alias("a"), F.greatest("p.th", "r.th").alias("b")).distinct()


def may_be_similar(made: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of ``first_shingles`` with different roots, among them every pair with Jaccard similarity ``least`` or more.

    Texts meet under their first shingles, and pairs stay if sizes, positions and the number of meetings allow the similarity (what a
    pair shares beyond them is among the last shingles of one set). A shingle that texts of one root alone have is found by the least
    and the greatest of its roots, which combine map-side, and its rows stay where they are. One of over ``SHARED`` texts is split in
    pairs of blocks. To these hot shingles (the ``HOTTEST`` largest) each text brings the ``BROUGHT`` least of its own: a pair meets once
    for all that both bring, under the least of them, and only if these and what else the two may share are enough.
    """
    named = stash(with_roots(made, roots), "named-first")

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, n = shingle_keys(batch)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(batch.column("root").to_numpy(zero_copy_only=False), n))], ["key", "root"])

    met_ = map_arrow(named, told, "key long, root long").groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"))
    several = stash(met_.where("x <> y").select("key", "n"), "several")
    common = Bitmap.of(several, "key")
    full = stash(several.where(F.col("n") > SHARED).select("key", F.ceil(F.col("n") / SHARED).cast("int").alias("blocks")), "full")
    hottest = np.sort(np.array([r["key"] for r in full.orderBy(F.desc("blocks"), "key").limit(HOTTEST).collect()], np.int64))

    def exploded(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, n = shingle_keys(batch)
        stay = common.may_hold(key)
        th, root, size = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)[stay] for c in ("th", "root", "size"))
        span = size.astype(np.int64) << 32 | (np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n))[stay]
        warm, start = np.isin(key, hottest), np.cumsum(n) - n
        brought = pa.array([np.sort(key[a : a + m][warm[a : a + m]])[:BROUGHT].tobytes() for a, m in zip(start.tolist(), n.tolist())], pa.binary())
        at = np.where(warm, np.repeat(np.arange(len(n)), n), -1)[stay]
        brought = brought.take(pa.array(at, mask=at < 0)).fill_null(b"")
        cols = [*(pa.array(x) for x in (key[stay], th, root, span)), brought]
        return pa.RecordBatch.from_arrays(cols, ["key", "th", "root", "span", "brought"])

    # A shingle of 8 bytes becomes a row of up to 300, with what its text brings.
    rows = map_arrow(named, exploded, "key long, th long, root long, span long, brought binary", 1 << 19)
    rows = rows.join(full, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.hash("th"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(x == y, 2).otherwise((F.col("own") == y).cast("int"))
    block = x.cast("long") * F.col("blocks") + y
    rows = rows.select("key", block.alias("block"), side.cast("int").alias("side"), "th", "root", "span", "brought")
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "root", "th")

    def made_of(a, b, need, fits, many) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, need.astype(np.int32), fits, many.astype(np.int32))], ["a", "b", "need", "fits", "many"])

    def met_hot(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Meetings of one group of a hot shingle: of pairs that both bring it, those to which it is the least that both bring."""
        key, _, side, th, root, span, own = cols
        size, at, n = span >> 32, span & 0xFFFFFFFF, len(th)
        lists = [np.frombuffer(x, np.int64) for x in own]
        many = np.array([len(x) for x in lists], np.int64)
        every, col, texts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        pos, two = np.cumsum(texts > 1) - 1, (texts > 1)[col]  # what one text alone brings is shared by none
        every, col = every[texts > 1], pos[col[two]]
        table = np.zeros((n, len(every)), np.float32)
        table[np.repeat(np.arange(n), many)[two], col] = 1
        least_col = int(np.searchsorted(every, key[0]))
        brings = table[:, least_col] > 0 if least_col < len(every) and every[least_col] == key[0] else np.zeros(n, bool)  # not beyond the ``BROUGHT``
        below = table[:, :least_col]
        rest = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1 - many  # first shingles that are not brought
        for lo in range(0, n, 256):
            i = np.arange(lo, min(n, lo + 256))[:, None]
            j = np.arange(n)[None, :]
            ok = (i < j) & (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] == 2))
            ok &= np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9
            both = brings[i] & brings[j]
            ok &= ~both | (below[lo : lo + 256] @ below.T < 0.5)
            shared = table[lo : lo + 256] @ table.T
            x, y = np.nonzero(ok)
            both, shared = both[x, y], np.rint(shared[x, y]).astype(np.int64)
            x = x + lo
            need = np.ceil(least / (1 + least) * (size[x] + size[y]) - 1e-9)
            # All first shingles together; of those that both bring, the first may lie before this one.
            short = (many[x] < BROUGHT) & (many[y] < BROUGHT)
            else_ = np.where(short, np.minimum(rest[x], rest[y]), rest[x] + rest[y])
            beyond = np.ceil(least * np.maximum(size[x], size[y]) - 1e-9) - 1
            fits = both | (np.minimum(size[x] - at[x], size[y] - at[y]) >= need)
            stay = shared + else_ >= need - beyond
            x, y, both, shared, need, beyond, fits = (v[stay] for v in (x, y, both, shared, need, beyond, fits))
            if len(x):
                yield made_of(np.minimum(th[x], th[y]), np.maximum(th[x], th[y]), need - beyond, fits, np.where(both, shared, 1))

    def met(cols: list[np.ndarray], start: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Meetings in groups, whose rows begin at ``start``, of rows with different roots: each with those after its own root's."""
        _, _, side, th, root, span, own = cols
        size, at, n = span >> 32, span & 0xFFFFFFFF, len(th)
        group = np.zeros(n, np.int64)
        group[start[1:]] = 1
        group = np.cumsum(group)
        end = np.append(start[1:], n)[group]
        new = np.append(np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (root[1:] != root[:-1]))), n)
        after = np.repeat(new[1:], np.diff(new))
        many = end - after
        hot_row = np.array([len(x) > 0 for x in own], bool)[start][group]
        many[hot_row] = 0
        for lo, hi in slices(np.cumsum(many), PAIRS):
            i = np.repeat(np.arange(lo, hi), many[lo:hi])
            j = np.arange(len(i)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi]) + after[i]
            ok = (side[i] != side[j]) | (side[i] == 2)
            ok &= np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9
            i, j = i[ok], j[ok]
            need = np.ceil(least / (1 + least) * (size[i] + size[j]) - 1e-9)
            fits = np.minimum(size[i] - at[i], size[j] - at[j]) >= need
            beyond = np.ceil(least * np.maximum(size[i], size[j]) - 1e-9) - 1
            if len(i):
                yield made_of(np.minimum(th[i], th[j]), np.maximum(th[i], th[j]), need - beyond, fits, np.ones(len(i)))
        for g in np.flatnonzero(hot_row[start]):
            yield from met_hot([c[start[g] : end[start[g]]] for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ("key", "block", "side", "th", "root", "span", "brought"), None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:  # a group that began in an earlier batch
                cols = [np.concatenate(c) for c in zip(held, cols)]
            new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            once = new | np.append(True, cols[3][1:] != cols[3][:-1])  # equal texts are one
            cols, start = [c[once] for c in cols], np.flatnonzero(new[once])
            last = start[-1]
            held = [c[last:].copy() for c in cols]
            if last:
                yield from met([c[:last] for c in cols], start[:-1])
        if held is not None:
            yield from met(held, np.zeros(1, np.int64))

    pairs = dealt.mapInArrow(run, "a long, b long, need int, fits boolean, many int").groupBy("a", "b")
    pairs = pairs.agg(F.sum("many").alias("n"), F.max("need").alias("need"), F.max("fits").alias("fits"))
    pairs = stash(pairs.where("fits and n >= need").select("a", "b"), "pairs")
    discard(named, several, full)
    return pairs


def second_hash(text: Column) -> Column:
    return F.xxhash64(F.lit("second"), text)


def node_of(text: Column, text_hash: Callable[[Column], Column], clashing: list[int]) -> Column:
    """The number of a text: its hash, or where texts are known to share that, a second one."""
    h = text_hash(text).cast("long")
    return F.when(h.isin(clashing), second_hash(text)).otherwise(h) if clashing else h


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8, tau: int = 5,
    text_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """(doc_id, text_hash, second_hash, component_id, root) of every row: groups linked by Jaccard similarity of word shingles.

    The first candidates are texts whose word-set fingerprints lie within ``tau`` bits (GPH search as above): as many of these pairs as
    connect them are held against the exact similarity of their shingle sets. Texts that follow each other under a common first shingle are
    tried next, in orders that bring similar ones together. What this leaves apart and may be similar is found by the first shingles of the sets and verified alike, so that no similar pair is missed at any distance of fingerprints; ``tau``
    decides the work, not the result. Equal texts are one node throughout, known by two independent 64-bit hashes: texts that share
    the first alone are told apart by the second.
    """
    base = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([word_set_fingerprint(t) for t in raw_texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(fp)], ["doc_id", "h1", "h2", "fp"])

    hashes = base.select("doc_id", text_hash(F.col("text")).cast("long").alias("h1"), second_hash(F.col("text")).alias("h2"), "text")
    rows = stash(map_arrow(hashes, run, "doc_id long, h1 long, h2 long, fp long"), "texts")
    apart = rows.groupBy("h1").agg(F.min("h2").alias("x"), F.max("h2").alias("y")).where("x <> y").select("h1")
    clashing = [r["h1"] for r in apart.collect()]  # n * n / 2 ** 65 of n texts
    hashed = base.withColumn("th", node_of(F.col("text"), text_hash, clashing))
    th = F.when(F.col("h1").isin(clashing), F.col("h2")).otherwise(F.col("h1")) if clashing else F.col("h1")
    rows = rows.withColumn("th", th)
    each_id = rows.groupBy("th", "doc_id").agg(F.min("fp").alias("fp"), F.count("*").alias("n"))
    least = F.min(F.struct("doc_id", "n"))["n"]
    nodes = each_id.groupBy("th").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least"), F.sum("n").alias("n"), F.coalesce(F.min_by("n", "doc_id"), least).alias("again"))
    nodes = stash(nodes, "nodes")
    repeated = not nodes.where("again > 1").isEmpty()  # rows that repeat an id and its text

    def fetched(wanted: DataFrame) -> DataFrame:
        """One row (th, text) of each of the wanted nodes (th, least)."""
        wanted = wanted.select(F.col("th").alias("wth"), F.col("least").alias("wid"))
        known = Bitmap.of(wanted.select("wth"), "wth")

        def likely(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(known.may_hold(batch.column("th").to_numpy(zero_copy_only=False))))

        some = map_arrow(hashed, likely, hashed.schema)
        wanted = wanted.hint("merge")  # a broadcast would leave two Python processes to each task of what follows
        return some.join(wanted, (F.col("th") == F.col("wth")) & F.col("doc_id").eqNullSafe(F.col("wid"))).select("th", "text")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """Those of the pairs (a, b) of nodes that are similar: by their sets' counts in buckets, and what these allow by whole sets."""
        ends = pairs.select(F.col("a").alias("th")).unionByName(pairs.select(F.col("b").alias("th"))).distinct()
        ends = stash(ends.join(nodes, "th").select("th", "least"), "ends")

        def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [shingle_set(t, words_per_shingle) for t in raw_texts(batch)]
            cols = [pa.array([f(x) for x in made], pa.binary()) for f in (np.ndarray.tobytes, bucket_counts)]
            return pa.RecordBatch.from_arrays([batch.column("th"), *cols], ["th", "shingles", "counts"])

        full = map_arrow(fetched(ends), whole, "th long, shingles binary, counts binary")
        full = stash(full.dropDuplicates(["th"]) if repeated else full, "sets")

        def joined(some: DataFrame, column: str) -> DataFrame:
            for end in "ab":
                some = some.join(full.select(F.col("th").alias(end), F.col(column).alias(f"s{end}")), end)
            return some.select("a", "b", "sa", "sb")

        def room(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = [may_share(x, y, similarity) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        likely = stash(map_arrow(joined(pairs, "counts"), room, "a long, b long"), "likely")

        def similar(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(n >= similarity * (len(x) + len(y) - n) - 1e-9)
            return batch.select(["a", "b"]).filter(pa.array(keep))

        out = stash(map_arrow(joined(likely, "shingles"), similar, "a long, b long"), label)
        discard(ends, full, likely)
        return out

    def grouped_by(edges: DataFrame) -> DataFrame:
        return components(edges).select(F.col("node").alias("th"), F.col("component").alias("root"))

    heads = stash(nodes.groupBy("fp").agg(F.min("th").alias("head")), "heads")
    near = links(heads.select("fp"), tau)
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    alike = nodes.join(heads, "fp").where("th <> head").select(F.col("head").alias("a"), F.col("th").alias("b"))
    near = stash(near.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(alike), "near")
    edges = verified(near, "edges")
    discard(near)

    # One row of each text: of texts with copies, the others are left out where bitmaps can tell. A text without copies that the first
    # bitmap takes for one with them has its row in the second.
    copied = Bitmap.of(nodes.where("n > 1").select("th"), "th")

    def doubtful(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(copied.may_hold(batch.column("th").to_numpy(zero_copy_only=False))))

    several = nodes.select("th", F.xxhash64("th", "least").alias("one"))
    ones = Bitmap.of(map_arrow(several, doubtful, "th long, one long"), "one")

    def single(batch: pa.RecordBatch) -> pa.RecordBatch:
        th, one = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("th", "one"))
        return batch.filter(pa.array(~copied.may_hold(th) | ones.may_hold(one)))

    each = hashed.select("th", F.xxhash64("th", "doc_id").alias("one"), "text")
    each = map_arrow(each, single, each.schema)
    made = stash(first_shingles(each, words_per_shingle, similarity), "first")
    common = stash(common_keys(made), "common")
    roots = stash(grouped_by(edges), "roots")
    for turn in range(0 if common.isEmpty() else TURNS):
        near = stash(chains(made, roots, common, similarity, turn), "chains")
        found = verified(near, "chain-edges")
        edges, old = stash(edges.unionByName(found), "edges"), (edges, near, found, roots)
        roots = stash(grouped_by(edges), "roots")
        discard(*old)
    pairs = may_be_similar(made, roots, similarity)
    more = verified(pairs, "more-edges")
    comp = grouped_by(edges.unionByName(more))
    named = nodes.join(comp, "th", "left").withColumn("root", F.coalesce("root", "th"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(named.join(least, "root").select("th", "component_id", "root"), "named")
    discard(heads, edges, more, pairs, roots, nodes, made, common)
    return rows.join(named, "th", "left").select("doc_id", F.col("th").alias("text_hash"), F.col("h2").alias("second_hash"), "component_id", "root")


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8, tau: int = 5,
    text_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each similar group does: that of the smallest id.

    Of equal rows that repeat the kept id one stays; rows that share it but differ in text all stay. A group
    without any id keeps one row.
    """
    near_id, near_hash = free_name(docs, "near_id"), free_name(docs, "near_hash")
    groups = stash(similar_groups(docs, id_col, text_col, words_per_shingle, similarity, tau, text_hash), "groups")
    own = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(near_id)).agg(F.count("*").alias("n"))
    own = stash(own, "kept")
    gone = groups.where("doc_id is not null").select(F.col("doc_id").alias(near_id)).distinct()
    gone = stash(gone.join(own, near_id, "left_anti"), "gone")
    # Texts whose id cannot be among those that go stay where they are; the others are joined.
    known = Bitmap.of(gone.select(F.xxhash64(near_id).alias("h")), "h")
    named = docs.where(F.col(id_col).isNotNull()).withColumn(near_hash, F.xxhash64(F.col(id_col).cast("long")))

    def part(held: bool) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            may = known.may_hold(batch.column(near_hash).to_numpy(zero_copy_only=False))
            return batch.filter(pa.array(may if held else ~may))

        return map_arrow(named, run, named.schema).drop(near_hash)

    kept = part(False).unionByName(part(True).join(gone, F.col(id_col).cast("long") == F.col(near_id), "left_anti"))
    if not own.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, text_col])
    nameless = groups.where("component_id is null").groupBy("root").agg(F.min("second_hash").alias(near_id))
    if not nameless.isEmpty():
        lost = docs.where(F.col(id_col).isNull())
        own_hash = second_hash(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        lost = lost.withColumn(near_hash, own_hash).join(nameless.select(near_id), F.col(near_hash) == F.col(near_id), "left_semi")
        kept = kept.unionByName(lost.dropDuplicates([near_hash]).drop(near_hash))
    return kept


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprint and component of every document."""
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
