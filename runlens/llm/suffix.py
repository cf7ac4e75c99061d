"""Removal of repeated substrings by a distributed, hash-compared suffix sort.

Two suffixes share ``window`` bytes only if their first windows are equal, and equal windows have equal minimisers: the
leftmost least hash among the ``gram``-byte strings that start in the window. So suffixes are dealt out by the hash
of their window's minimiser (its anchor) and each part is sorted on its own.

1. A pass over the texts finds anchors. An anchor stands for the run of neighbouring windows that it is the minimiser of and for
   the bytes that they cover. Runs with equal bytes in one task are repeats at once, and one of them goes on.
2. Runs meet by anchor hash. An anchor that occurs once is done. Of the others, those go on whose run hash occurs again, and one of each
   run hash where these differ.
3. Their bytes are fetched, and meet by anchor hash again. Runs of equal bytes are repeats. Of differing ones, windows whose polynomial
   hash occurs once are dropped; the suffixes at the others are mergesorted, comparing by the longest common extension, which binary
   search over prefix polynomial hashes finds in log(window) steps. Neighbours in that order with a common extension of a whole window
   are compared byte by byte, and are repeats if equal.
4. An anchor of more than ``HOT`` runs is not one group: its runs are counted by their bytes, which combines map-side, so that no task
   gathers what one anchor has. What it has of distinct runs meets as above; if these are over ``HOT`` still, they are cut to windows,
   which are counted in the same way.
5. Covered bytes are merged to spans for each document and cut out.

No byte goes on the word of a hash alone. A row is known by its id and a 64-bit hash of its text, so rows with null or repeated ids are
documents of their own, and repeated rows are repeats of each other. Null
and empty texts have no bytes. Strings never cross documents; texts of any length are taken whole, in overlapping buffers. An empty
table gives an empty result. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, discard, id_text, map_arrow, pieces, raw_texts, stash

GRAM = 64
#: Bytes of one numpy buffer; longer texts are taken in pieces that overlap by a window.
BUFFER = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
POSITION = np.uint64((1 << 24) - 1)


@functools.lru_cache(maxsize=1)
def powers() -> np.ndarray:
    """BASE ** i modulo 2 ** 64, for every position of a buffer and some more."""
    out = np.full(4 * BUFFER, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of the GRAM bytes from each position, by doubling."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:
        h = h[:-width] * powers()[width] + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def runs(data: np.ndarray, stops: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor hash) of each run in a buffer of texts that end at ``stops``."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data)
    m = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    span, width = window - GRAM + 1, 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = span - width
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    anchor = (m & POSITION).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for stop in stops[:-1]:  # windows that would cross the end of a text
        valid[max(0, stop - window + 1) : stop] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    new = np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    return first, last, anchor[first], h[anchor[first]]


def buffers(raw: list[bytes], window: int) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """Texts packed in buffers: (bytes, numbers of the texts, their starts in the buffer, offsets within the text)."""
    held, who, begin, offset, size = [], [], [], [], 0
    for i, t in enumerate(raw):
        if len(t) < window:
            continue
        for lo in range(0, max(1, len(t) - window + 1), BUFFER - window):
            piece = t[lo : lo + BUFFER - 1] if len(t) > BUFFER else t
            if size + len(piece) > BUFFER and held:
                yield b"".join(held), who, begin, offset
                held, who, begin, offset, size = [], [], [], [], 0
            held.append(piece)
            who.append(i)
            begin.append(size)
            offset.append(lo)
            size += len(piece)
            if len(t) <= BUFFER:
                break
    if held:
        yield b"".join(held), who, begin, offset


def merged(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each key joined where they touch or overlap."""
    if not len(key):
        return key, start, stop
    order = np.lexsort((start, key))
    k, s, e = key[order], start[order], stop[order]
    top = int(e.max()) + 1
    reach = np.maximum.accumulate(k * top + e)  # keys are small row numbers
    new = np.concatenate([[True], k[1:] * top + s[1:] > reach[:-1]]) if len(k) > 1 else np.array([True])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:] - 1, [len(k) - 1]])
    return k[head], s[head], reach[tail] - k[head] * top


ANCHORS = "kind int, khash long, uhash long, doc_id long, th long, s int, len int, off int, multi boolean"


def equal_runs(piece: Callable[[int], bytes], order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which neighbours in ``order``, alike by their hashes (``same``), have equal bytes; where hashes collide, order follows bytes."""
    differ = [i for i in np.flatnonzero(same).tolist() if piece(order[i]) != piece(order[i + 1])]
    if differ:
        group = np.cumsum(np.concatenate([[0], ~same]))
        for g in np.unique(group[differ]):
            lo, hi = np.searchsorted(group, [g, g + 1])
            order[lo:hi] = sorted(order[lo:hi].tolist(), key=piece)
            same[lo : hi - 1] = [piece(order[i]) == piece(order[i + 1]) for i in range(lo, hi - 1)]
    return order, same


def anchors(docs: DataFrame, window: int, run_hash: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """Kind 0: runs (s, len: the bytes that they cover); kind 1: spans known as repeats in the task itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield one(batch)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = raw_texts(batch)
        row, s, size, off, khash, uhash = [], [], [], [], [], []
        for data, who, begin, offset in buffers(raw, window):
            begins = np.array(begin)
            stops = np.concatenate([begins[1:], [len(data)]])
            first, last, at, h = runs(np.frombuffer(data, np.uint8), stops, window)
            which = np.searchsorted(begins, first, "right") - 1
            end = last + window
            uhash += [run_hash(data[a:b]) for a, b in zip(first.tolist(), end.tolist())]
            row.append(np.array(who)[which])
            s.append(first - begins[which] + np.array(offset)[which])
            size.append(end - first)
            off.append(at - first)
            khash.append(h)
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        row, s, size, off, k, u = *(cat(x, np.int64) for x in (row, s, size, off)), cat(khash, np.uint64), np.array(uhash, np.uint64)
        order = np.lexsort((u, k))
        same = (k[order][1:] == k[order][:-1]) & (u[order][1:] == u[order][:-1]) if len(k) > 1 else np.zeros(0, bool)
        order, same = equal_runs(lambda i: raw[row[i]][s[i] : s[i] + size[i]], order, same)
        head = np.concatenate([[True], ~same])[: len(k)]
        more = np.concatenate([same, [False]])[: len(k)]
        local = order[~head | more]
        keep = order[head]
        r, a, b = merged(row[local], s[local], s[local] + size[local])
        n0, n1 = len(keep), len(r)
        at = np.concatenate([row[keep], r])
        zero = np.zeros(n1, np.int64)
        ids, ths = batch.column("doc_id").take(pa.array(at)), batch.column("th").take(pa.array(at))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([0, 1], [n0, n1]).astype(np.int32)),
                pa.array(np.concatenate([k[keep].view(np.int64), zero])),
                pa.array(np.concatenate([u[keep].view(np.int64), zero])),
                ids,
                ths,
                pa.array(np.concatenate([s[keep], a]).astype(np.int32)),
                pa.array(np.concatenate([size[keep], b - a]).astype(np.int32)),
                pa.array(np.concatenate([off[keep], zero]).astype(np.int32)),
                pa.array(np.concatenate([more[head], np.ones(n1, bool)])),
            ],
            [c.split()[0] for c in ANCHORS.split(", ")],
        )

    return docs.mapInArrow(run, ANCHORS)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Sorted batches recut so that no group of equal keys is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(k != k[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and k[0] != held[-1].column(key)[held[-1].num_rows - 1].as_py() and not cut:
            yield together(held)
            held = []
        if cut:
            held.append(batch.slice(0, cut))
            yield together(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield together(held)


def together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


#: Runs of one anchor that meet in one task; anchors of more are taken by their windows.
HOT = 2048


def met(rows: DataFrame) -> DataFrame:
    """Of runs that met by anchor hash, those whose bytes must be seen: all of a run hash that occurs again, and one of each
    run hash if an anchor has several and not all of them are known as repeats."""
    dealt = rows.repartition("khash").sortWithinPartitions("khash", "uhash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "khash"):
            k, u, multi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("khash", "uhash", "multi"))
            new_k = np.concatenate([[True], k[1:] != k[:-1]])
            new_u = new_k | np.concatenate([[True], u[1:] != u[:-1]])
            head = np.flatnonzero(new_u)
            count = np.diff(np.concatenate([head, [len(k)]]))
            solved = (count > 1) | np.logical_or.reduceat(multi, head)
            group = np.cumsum(new_k)[head] - 1
            kinds, open_ = np.bincount(group), np.bincount(group, weights=~solved)
            differing = (kinds[group] > 1) & (open_[group] > 0)
            again = np.repeat(count > 1, count)
            again[head[differing]] = True
            if again.any():
                yield batch.filter(pa.array(again))

    return dealt.mapInArrow(run, rows.schema)


# ---------------------------------------------------------------- the suffix sort


class Suffixes:
    """Suffixes of pieces of text in one buffer, compared up to ``window`` bytes by hashes of prefixes."""

    def __init__(self, data: bytes, window: int):
        self.bytes, self.window = np.frombuffer(data, np.uint8), window
        need = len(data) + 1
        table = powers()
        if need > len(table):
            table = np.full(need, BASE, np.uint64)
            table[0] = 1
            table = np.multiply.accumulate(table)
        self.power = table
        self.inverse = pow(BASE, -1, 1 << 64)
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * table[: len(data)])])

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the hashes of ``size`` bytes from a and from b agree (scaled to the larger start)."""
        x = (self.prefix[a + size] - self.prefix[a]) * self.power[np.maximum(b - a, 0)]
        y = (self.prefix[b + size] - self.prefix[b]) * self.power[np.maximum(a - b, 0)]
        return x == y

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Longest common extension of up to ``most`` bytes to the right (or left) of a and b, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo] + 1) >> 1
            x, y = (a[todo] - mid, b[todo] - mid) if back else (a[todo], b[todo])
            ok = self.same(x, y, mid)
            low[todo] = np.where(ok, mid, low[todo])
            high[todo] = np.where(ok, high[todo], mid - 1)
        return low

    def before(self, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
        """Whether the suffix at a sorts before that at b: by the byte after their common extension, then length, then place."""
        most = np.minimum(a_size, b_size)
        common = self.extension(a, b, most)
        at = np.minimum(common, most - 1)
        tie = (a_size < b_size) | ((a_size == b_size) & (a < b))
        return np.where(common == most, tie, self.bytes[a + at] < self.bytes[b + at])

    def sort(self, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within their groups (given contiguous): bottom-up mergesort.

        All merges of a level run at once; each element finds its rank in the sibling run by binary search.
        """
        n = len(starts)
        order = np.arange(n)
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else order
        count = np.diff(np.concatenate([head, [n]]))
        first, total = np.repeat(head, count), np.repeat(count, count)
        rel, width = np.arange(n) - first, 1
        while n and width < count.max():
            base = np.minimum(((rel // width) ^ 1) * width, total)
            size = np.minimum(base + width, total) - base
            low, high = np.zeros(n, np.int64), size.copy()
            while (todo := np.flatnonzero(low < high)).size:
                mid = (low[todo] + high[todo]) >> 1
                x, y = order[(first + base)[todo] + mid], order[todo]
                smaller = self.before(starts[x], sizes[x], starts[y], sizes[y])
                low[todo] = np.where(smaller, mid + 1, low[todo])
                high[todo] = np.where(smaller, high[todo], mid)
            out = np.empty_like(order)
            out[first + (rel // (2 * width)) * 2 * width + rel % width + low] = order
            order, width = out, 2 * width
        return order

    def window_hashes(self, starts: np.ndarray) -> np.ndarray:
        h = (self.prefix[starts + self.window] - self.prefix[starts]) * self.inverses()[starts]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)

    def inverses(self) -> np.ndarray:
        out = np.full(len(self.prefix), self.inverse, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def repeated(self, starts: np.ndarray) -> np.ndarray:
        """Which of the suffixes share a whole window with another one: mergesort, then bytes of neighbours."""
        flag = np.zeros(len(starts), bool)
        if len(starts) < 2:
            return flag
        h = self.window_hashes(starts)
        order = np.argsort(h, kind="stable")
        twin = h[order][1:] == h[order][:-1]
        may = np.zeros(len(starts), bool)
        may[order[1:][twin]] = True
        may[order[:-1][twin]] = True
        some = np.flatnonzero(may)
        if not len(some):
            return flag
        size = np.full(len(some), self.window)
        sorted_ = starts[some][self.sort(starts[some], size, np.zeros(len(some)))]
        a, b = sorted_[:-1], sorted_[1:]
        pair = np.flatnonzero(self.extension(a, b, size[1:]) == self.window)
        hit = []
        for lo in range(0, len(pair), 1 << 14):
            x, y = a[pair[lo : lo + (1 << 14)]], b[pair[lo : lo + (1 << 14)]]
            steps = np.arange(self.window)
            equal = (self.bytes[x[:, None] + steps] == self.bytes[y[:, None] + steps]).all(axis=1)
            hit += [x[equal], y[equal]]
        return np.isin(starts, np.concatenate(hit)) if hit else flag


#: Runs of one anchor that are held against each other; more are taken by their windows.
FEW = 64


def among_few(x: Suffixes, pieces: list[bytes], begin: np.ndarray, size: np.ndarray, off: np.ndarray, group: np.ndarray, done: np.ndarray):
    """(row, start, stop) of repeats among the runs of each anchor.

    Suffixes at the anchors are sorted; the common extension to the right of two of them is the least of those of
    neighbours between them, that to the left is searched. Both together span a window or more where runs share one.
    """
    anchor, rest = begin + off, size - off
    order = x.sort(anchor, rest, group)
    n = len(order)
    reach = np.zeros(max(0, n - 1), np.int64)
    twin = np.flatnonzero(group[order][1:] == group[order][:-1])
    a, b = order[twin], order[twin + 1]
    reach[twin] = x.extension(anchor[a], anchor[b], np.minimum(rest[a], rest[b]))
    rows, starts, stops = [], [], []
    at, right = np.arange(max(0, n - 1)), reach.copy()
    for step in range(1, FEW):
        a, b = order[at], order[at + step]
        alive = (group[a] == group[b]) & (right >= GRAM)
        at, right, a, b = at[alive], right[alive], a[alive], b[alive]
        if not len(at):
            break
        may = np.flatnonzero((right + np.minimum(off[a], off[b]) >= x.window) & ~(done[a] & done[b]))
        p, q, r = a[may], b[may], right[may]
        left = x.extension(anchor[p], anchor[q], np.minimum(off[p], off[q]), back=True)
        for i, j, lo, hi in zip(*(v[left + r >= x.window].tolist() for v in (p, q, left, r))):
            oi, oj = int(off[i]), int(off[j])
            if pieces[i][oi - lo : oi + hi] == pieces[j][oj - lo : oj + hi]:
                rows += [i, j]
                starts += [oi - lo, oj - lo]
                stops += [oi + hi, oj + hi]
        inside = at + step < n - 1
        at, right = at[inside], right[inside]
        right = np.minimum(right, reach[at + step])
    return np.array(rows, np.int64), np.array(starts, np.int64), np.array(stops, np.int64)


def among_many(x: Suffixes, begin: np.ndarray, size: np.ndarray):
    """The same by windows: those of a hash that occurs once are dropped, the others sorted; no pairs are made."""
    n = size - x.window + 1
    owner = np.repeat(np.arange(len(begin)), n)
    local = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    hit = x.repeated(begin[owner] + local)
    return owner[hit], local[hit], local[hit] + x.window


def likely(docs: DataFrame, rows: DataFrame, held: bool = True) -> DataFrame:
    """The documents whose text hash may be among those of ``rows`` (or the others): texts that a join would drop stay where they are."""
    known = Bitmap.of(rows.select("th").distinct(), "th")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        may = known.may_hold(batch.column("th").to_numpy(zero_copy_only=False))
        return batch.filter(pa.array(may if held else ~may))

    return map_arrow(docs, run, docs.schema)


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(khash, doc_id, th, s, off, multi, u) of wanted runs with their bytes, from documents (doc_id, text, th)."""
    by_row = wanted.groupBy(F.col("doc_id").alias("wid"), F.col("th").alias("wth")).agg(
        F.collect_list(F.struct("khash", "s", "len", "off", "multi")).alias("runs")
    )
    joined = likely(docs, wanted).join(by_row, F.col("doc_id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            raw, listed = raw_texts(batch), batch.column("runs")
            flat = listed.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
            s, size = flat.field("s").to_pylist(), flat.field("len").to_pylist()
            runs_ = [raw[o][a : a + n] for o, a, n in zip(owner.tolist(), s, size)]
            at = pa.array(owner)
            cols = [flat.field("khash"), batch.column("doc_id").take(at), batch.column("th").take(at), flat.field("s"), flat.field("off"), flat.field("multi"), pa.array(runs_, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["khash", "doc_id", "th", "s", "off", "multi", "u"])

    return joined.select("doc_id", "th", "text", "runs").mapInArrow(fetch, "khash long, doc_id long, th long, s int, off int, multi boolean, u binary")


SPANS = "doc_id long, th long, s int, len int"


def compared(fetched_runs: DataFrame, window: int) -> DataFrame:
    """Spans (doc_id, th, s, len) of repeats among the runs of an anchor, by their bytes."""
    rows = fetched_runs.repartition("khash").sortWithinPartitions("khash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "khash"):
            key, off, row_s, multi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("khash", "off", "s", "multi"))
            off, row_s = off.astype(np.int64), row_s.astype(np.int64)
            number: dict[tuple[int, bytes], int] = {}
            own = np.array([number.setdefault(x, len(number)) for x in zip(key.tolist(), batch.column("u").to_pylist())])
            _, one, count = np.unique(own, return_index=True, return_counts=True)
            # From here on there is one row of each distinct run; ``done`` runs are repeats as a whole.
            bits = [u for _, u in number]
            size = np.array([len(x) for x in bits])
            done = (count > 1) | (np.bincount(own, weights=multi) > 0)
            whole = np.flatnonzero((count > 1)[own] & ~multi)
            begin, key1, off1 = np.cumsum(size) - size, key[one], off[one]
            suffixes = Suffixes(b"".join(bits), window)
            _, group, kinds = np.unique(key1, return_inverse=True, return_counts=True)
            open_ = np.bincount(group, weights=~done)
            live = (kinds[group] > 1) & (open_[group] > 0)
            few, many = np.flatnonzero(live & (kinds[group] <= FEW)), np.flatnonzero(live & (kinds[group] > FEW))
            r0, a0, b0 = among_few(suffixes, [bits[i] for i in few], begin[few], size[few], off1[few], group[few], done[few])
            r1, a1, b1 = among_many(suffixes, begin[many], size[many])
            r, a, b = np.concatenate([few[r0], many[r1]]), np.concatenate([a0, a1]), np.concatenate([b0, b1])
            fresh = ~done[r]
            r, a, b = one[r[fresh]], a[fresh], b[fresh]
            r, a, b = np.concatenate([r, whole]), np.concatenate([row_s[r] + a, row_s[whole]]), np.concatenate([row_s[r] + b, row_s[whole] + size[own[whole]]])
            r, a, b = merged(r, a, b)
            at = pa.array(r)
            cols = [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(a.astype(np.int32)), pa.array((b - a).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "s", "len"])

    return rows.mapInArrow(run, SPANS)


def counted_runs(docs: DataFrame, wanted: DataFrame, window: int, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """Spans of repeats among the runs of hot anchors, and what was written for them.

    Runs are counted by their bytes. A distinct run that occurs once is a row of its own; one that occurs again is a repeat as a whole,
    and stands for all its rows when the distinct runs of an anchor are held against each other.
    """
    runs_ = stash(fetched(docs, wanted), "hot-runs")
    one = [F.min(c).alias(c) for c in ("doc_id", "th", "s", "off")]
    distinct = runs_.groupBy("khash", "u").agg(F.count("*").alias("n"), F.max("multi").alias("multi"), *one)
    distinct = stash(distinct.withColumn("multi", F.col("multi") | (F.col("n") > 1)), "distinct-runs")
    whole = runs_.where("not multi").join(distinct.where("n > 1").select("khash", "u"), ["khash", "u"], "left_semi")
    out = whole.select("doc_id", "th", "s", F.length("u").alias("len"))
    kinds = distinct.groupBy("khash").agg(F.count("*").alias("kinds"), F.bool_and("multi").alias("solved"))
    kinds = stash(kinds.where("kinds > 1 and not solved").select("khash", (F.col("kinds") > hot).alias("many")), "kinds")
    columns = ["khash", "doc_id", "th", "s", "off", "multi", "u"]
    few, many = (distinct.join(kinds.where(F.col("many") == x), "khash", "left_semi").select(columns) for x in (False, True))
    out = out.unionByName(compared(few, window))
    written = [runs_, distinct, kinds]
    if not kinds.where("many").isEmpty():
        more, windows = counted_windows(many, window)
        out, written = out.unionByName(more), [*written, *windows]
    return out, written


def counted_windows(distinct: DataFrame, window: int) -> tuple[DataFrame, list[DataFrame]]:
    """Spans of repeats among distinct runs, and what was written for them: a window's bytes are a key, counted map-side first.

    Windows whose hash occurs once, or in runs alone that are repeats as a whole, are left out by a filter before bytes are cut.
    """

    def places_of(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        runs_ = batch.column("u").to_pylist()
        n = np.array([len(x) - window + 1 for x in runs_])
        owner = np.repeat(np.arange(len(runs_)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        h = [xxhash.xxh3_64_intdigest(u[j : j + window]) for u, m in zip(runs_, n.tolist()) for j in range(m)]
        return runs_, owner, at, np.array(h, np.uint64).view(np.int64)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, owner, _, h = places_of(batch)
        return pa.RecordBatch.from_arrays([pa.array(h), batch.column("multi").take(pa.array(owner))], ["h", "multi"])

    n = F.sum(F.when(F.col("multi"), 2).otherwise(1)).alias("n")
    twice = map_arrow(distinct, hashed, "h long, multi boolean", 1 << 18).groupBy("h").agg(n, F.bool_and("multi").alias("solved"))
    twice = stash(twice.where("n > 1 and not solved").select("h"), "twice")
    known = Bitmap.of(twice, "h")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs_, owner, at, h = places_of(batch)
        may = known.may_hold(h)
        owner, at = owner[may], at[may]
        w = pa.array([runs_[i][j : j + window] for i, j in zip(owner.tolist(), at.tolist())], pa.binary())
        s = batch.column("s").to_numpy(zero_copy_only=False).astype(np.int64)[owner] + at
        cols = [batch.column(c).take(pa.array(owner)) for c in ("doc_id", "th", "multi")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(s.astype(np.int32)), w], ["doc_id", "th", "multi", "s", "w"])

    windows = stash(map_arrow(distinct, cut, "doc_id long, th long, multi boolean, s int, w binary", 1 << 18), "windows")
    repeated = windows.groupBy("w").agg(n).where("n > 1").select("w")
    spans = windows.where("not multi").join(repeated, "w", "left_semi").select("doc_id", "th", "s", F.lit(window).alias("len"))
    return spans, [twice, windows]


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, hot: int = HOT, run_hash: Callable[[bytes], int] = xxhash.xxh3_64_intdigest
) -> DataFrame:
    """(doc_id, th, s, len): byte spans, overlapping ones included, covered by strings that start elsewhere too."""
    return _spans(id_text(docs, id_col, text_col), window, hot, run_hash)[0]


def _spans(docs: DataFrame, window: int, hot: int, run_hash: Callable[[bytes], int]) -> tuple[DataFrame, list[DataFrame]]:
    """The spans, and what was written for them."""
    if window < GRAM:
        raise ValueError(f"windows have {GRAM} bytes at least")
    base = docs.withColumn("th", F.xxhash64("text"))
    found = stash(anchors(base, window, run_hash), "anchors")
    rows = found.where("kind = 0").drop("kind")
    often = stash(rows.groupBy("khash").count().where(F.col("count") > hot).select("khash"), "hot")
    if often.isEmpty():
        wanted = stash(met(rows), "met")
        more, written = None, []
    else:  # runs of hot anchors are told apart by a join of anchors alone
        wanted = stash(met(rows.join(often, "khash", "left_anti").select(rows.columns)), "met")
        more, written = counted_runs(base, rows.join(often, "khash", "left_semi").select(rows.columns), window, hot)
    spans = found.where("kind = 1").select("doc_id", "th", "s", "len").unionByName(compared(fetched(base, wanted), window))
    return spans if more is None else spans.unionByName(more), [found, often, wanted, *written]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, hot: int = HOT, run_hash: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row; texts without repeats are not shuffled."""
    found, written = _spans(id_text(docs, id_col, text_col), window, hot, run_hash)
    spans = stash(found, "spans")
    discard(*written)
    by_row = spans.groupBy(F.col("doc_id").alias("wid"), F.col("th").alias("wth")).agg(F.collect_list(F.struct("s", "len")).alias("spans"))
    base = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    joined = likely(base, spans).join(by_row, F.col("doc_id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")), "left").select("doc_id", "text", "spans")
    rest = likely(base, spans, False).select("doc_id", "text", F.lit(None).cast("array<struct<s:int,len:int>>").alias("spans"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, removed, count, kept = [], [], [], []
        for raw, spans_ in zip(raw_texts(batch), batch.column("spans").to_pylist()):
            out, at, gone, n = [], 0, 0, 0
            begin = stop = -1
            for a, b in sorted((x["s"], x["s"] + x["len"]) for x in spans_ or ()):
                if a > stop:
                    if stop >= 0:
                        out.append(raw[at:begin])
                        at, gone, n = stop, gone + stop - begin, n + 1
                    begin, stop = a, b
                else:
                    stop = max(stop, b)
            if stop >= 0:
                out.append(raw[at:begin])
                at, gone, n = stop, gone + stop - begin, n + 1
            out.append(raw[at:])
            size.append(len(raw))
            removed.append(gone)
            count.append(n)
            kept.append(b"".join(out))
        cols = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (size, removed, count)], pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_arrow(joined.unionByName(rest), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: what stays of every document when repeated 200-byte strings go."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
