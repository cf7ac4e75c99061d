"""Token ids in binary shards, with Elias-Fano document boundaries.

A shard is one file: a header, the Elias-Fano code of its document ids, that of its document boundaries (positions in
the id array, first 0, last the number of ids), and all ids concatenated, each in 2 bytes if the vocabulary allows and else
in 4. An Elias-Fano code of n values up to u takes n * (2 + log2(u / n)) bits plus a 32-bit select sample for each 64
values. Shards hold documents in ascending order of id (null ids first, ties by text) and follow each other in it;
``manifest.json`` lists each with its number of documents and ids and the ids before it. A shard ends with the document that takes it
over ``SHARD`` bytes of ids, which is what a writer or reader holds; a longer document has a shard to itself.

Null texts count as empty and get the end id alone; repeated rows are written as often as they occur; texts of any length are encoded
whole; an empty table makes an empty manifest. Only the id and the text are read, so other columns cannot clash. Shards are written
under a temporary name and renamed, so that a task that runs again replaces its own.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, parts, pieces, run_dir

MAGIC = b"RLIDSEF1"
SAMPLE = 64
#: Bytes of ids after which a shard ends, and characters of text that a task is to write.
SHARD, RANGE = 64 << 20, 64 << 20


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    HEAD = struct.Struct("<QBQQQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        bits = max(0, int(int(v[-1]) // n).bit_length() - 1)
        digits = (v[:, None] >> np.arange(bits, dtype=np.uint64)[None, :]) & np.uint64(1)
        low = np.packbits(digits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Position of the i-th one of the unary part: from its sample on, by counts of bytes."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, skip = at // 8, at % 8
        while True:
            word = self.high[byte : byte + 64]
            counts = np.bitwise_count(word).astype(np.int64)
            if skip:
                counts[0] = int(word[0] >> skip).bit_count()
            total = np.cumsum(counts)
            k = int(np.searchsorted(total, left + 1))
            if k < len(word):
                left -= int(total[k - 1]) if k else 0
                ones = np.flatnonzero(np.unpackbits(word[k : k + 1], bitorder="little"))
                ones = ones[ones >= skip] if not k else ones
                return (byte + k) * 8 + int(ones[left])
            left, byte, skip = left - int(total[-1]), byte + len(word), 0

    def get(self, i: int) -> int:
        """The i-th value, in constant space."""
        high, low, start = self.select(i) - i, 0, i * self.low_bits
        for b in range(self.low_bits):
            low |= (int(self.low[(start + b) >> 3]) >> ((start + b) & 7) & 1) << b
        return high << self.low_bits | low

    def values(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        digits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (digits.astype(np.int64) << np.arange(self.low_bits)[None, :]).sum(axis=1)
        return (high.astype(np.int64) << self.low_bits) | low

    def dump(self) -> bytes:
        body = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]
        return self.HEAD.pack(self.n, self.low_bits, *map(len, body)) + b"".join(body)

    @classmethod
    def load(cls, raw, at: int) -> tuple[EliasFano, int]:
        n, bits, *sizes = cls.HEAD.unpack_from(raw, at)
        at += cls.HEAD.size
        views = []
        for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4")):
            views.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, bits, *views), at


# ---------------------------------------------------------------- encoding with a tokenizer file


class Table:
    """Ids of known words by a 64-bit hash, with the words' bytes, which every hit is held against."""

    SLOTS = 1 << 21

    def __init__(self, kind: str):
        self.keys, self.at = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int64)
        self.n = 0
        self.ids, self.bytes = np.zeros(1 << 16, kind), np.zeros(1 << 16, np.uint8)
        self.id_end, self.byte_end = np.zeros(1 + self.SLOTS // 2, np.int64), np.zeros(1 + self.SLOTS // 2, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the word of each hash, or -1."""
        out, slot, todo = np.full(len(h), -1), (h >> np.uint64(40)).astype(np.int64) % self.SLOTS, np.arange(len(h))
        while len(todo):
            key = self.keys[slot[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (key != 0)]
            slot[todo] = (slot[todo] + 1) % self.SLOTS
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, id_sizes: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> None:
        """Words of distinct new hashes, with their ids and bytes one after the other."""
        first = self.n
        self.id_end[first + 1 : first + 1 + len(h)] = self.id_end[first] + np.cumsum(id_sizes)
        self.byte_end[first + 1 : first + 1 + len(h)] = self.byte_end[first] + np.cumsum(sizes)
        self.n += len(h)
        for name, new, ends in (("ids", ids, self.id_end), ("bytes", raw, self.byte_end)):
            old = getattr(self, name)
            if ends[self.n] > len(old):
                setattr(self, name, old := np.concatenate([old, np.zeros(max(len(old), len(new)), old.dtype)]))
            old[ends[first] : ends[self.n]] = new
        slot, todo = (h >> np.uint64(40)).astype(np.int64) % self.SLOTS, np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            self.keys[slot[free[one]]] = h[free[one]]
            self.at[slot[free[one]]] = first + free[one]
            todo = np.setdiff1d(todo, free[one], assume_unique=True)
            slot[todo] = (slot[todo] + 1) % self.SLOTS


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)


def cuts_at_words(said: dict) -> bool:
    """Whether a tokenizer file says byte-level BPE with its own splitting pattern and nothing that looks across words."""
    splitter, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space", True)
    parts_ = ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "unk_token")
    return plain and not said.get("normalizer") and not said.get("truncation") and not said.get("padding") and not any(model.get(x) for x in parts_)


class Words:
    """Ids of texts by the ``tokenizers`` library, one call for all words of a buffer that the process does not know.

    Texts are cut where no match of a byte-level tokenizer's splitting pattern can go on: before a space, tab or line
    break that follows a non-space, and before a comma or full stop that follows an ASCII letter or digit. Ids of the parts joined
    are those of the text. Unknown words are encoded as one text, cut by the same rules, and told apart by the bytes that ids
    stand for. Texts with other white space or with an added token, which the library finds before it splits, and all texts under
    other tokenizers, are encoded whole.
    """

    ODD = re.compile(r"[^\S \n\t\r]")
    BUFFER = 1 << 20
    BASE = 0x9E3779B97F4A7C15

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if max(self.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
        said = json.loads(self.tokenizer.to_str())
        self.by_bytes = cuts_at_words(said)
        added = [t["content"] for t in said.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocab = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each id: byte-level tokens have a character a byte
        for token, i in vocab.items():
            self.size[i] = len(token)
        self.table = Table(self.kind)
        byte = np.arange(256)
        self.space = np.isin(byte, [32, 9, 10, 13])
        self.stop = np.isin(byte, [ord(","), ord(".")])
        self.alnum = np.array([chr(c).isascii() and chr(c).isalnum() for c in byte])
        self.power = np.full(self.BUFFER + 1, self.BASE, np.uint64)
        self.inverse = np.full(self.BUFFER + 1, pow(self.BASE, -1, 1 << 64), np.uint64)
        for x in (self.power, self.inverse):
            x[0] = 1
            np.multiply.accumulate(x, out=x)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, in the byte width of the file."""
        out: list[bytes] = [b""] * len(batch)
        group, size = [], 0
        for i, text in enumerate(batch):
            raw = text.encode()
            if not self.by_bytes or len(raw) > self.BUFFER or self.ODD.search(text) or self.added and self.added.search(text):
                out[i] = self.whole(text).tobytes()
            elif raw:
                if size + len(raw) > self.BUFFER:
                    self.buffer(group, out)
                    group, size = [], 0
                group.append((i, raw))
                size += len(raw)
        if group:
            self.buffer(group, out)
        return out

    def buffer(self, group: list[tuple[int, bytes]], out: list[bytes]) -> None:
        data = b"".join([raw for _, raw in group])
        b = np.frombuffer(data, np.uint8)
        sizes = np.array([len(raw) for _, raw in group])
        doc_start = np.cumsum(sizes) - sizes
        space = self.space[b]
        cut = np.zeros(len(b), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (self.stop[b[1:]] & self.alnum[b[:-1]])
        cut[doc_start] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.concatenate([start, [len(b)]]))
        prefix = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.power[: len(b)], out=prefix[1:])
        h = (prefix[start + size] - prefix[start]) * self.inverse[start] + size.astype(np.uint64)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
        word = self.known(data, b, start, size, h)
        if word is None:
            for i, raw in group:
                out[i] = self.whole(raw.decode()).tobytes()
            return
        n = self.table.id_end[word + 1] - self.table.id_end[word]
        ids = self.table.ids[spread(self.table.id_end[word], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        first = np.concatenate([np.searchsorted(start, doc_start), [len(start)]])
        for k, (i, _) in enumerate(group):
            out[i] = ids[ends[first[k]] : ends[first[k + 1]]].tobytes()

    def known(self, data: bytes, b: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray | None:
        """Numbers of all words of a buffer in the table, learning those that it lacks; none if two words share a hash."""
        table = self.table
        word = table.find(h)
        if (word < 0).any():
            if table.n + int((word < 0).sum()) > table.SLOTS // 2:
                table = self.table = Table(self.kind)
                word[:] = -1
            new = np.flatnonzero(word < 0)
            _, one = np.unique(h[new], return_index=True)
            self.learn([data[x:y] for x, y in zip(start[new[one]].tolist(), (start + size)[new[one]].tolist())], h[new[one]])
            word[new] = table.find(h[new])
        same = table.byte_end[word + 1] - table.byte_end[word] == size
        if not same.all() or (table.bytes[spread(table.byte_end[word], size)] != b[spread(start, size)]).any():
            return None
        return word

    def learn(self, words: list[bytes], h: np.ndarray) -> None:
        lead = [i for i, w in enumerate(words) if w[0] in b" \n\t\r" and w[-1] not in b" \n\t\r"]
        ids: list[np.ndarray] = [None] * len(words)
        if lead:
            got = np.array(self.tokenizer.encode_batch_fast([b"".join([words[i] for i in lead]).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.size[got]), np.cumsum([len(words[i]) for i in lead])) + 1
            for i, piece in zip(lead, np.split(got, ends[:-1])):
                ids[i] = piece
        rest = [i for i in range(len(words)) if ids[i] is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False)):
            ids[i] = np.array(e.ids, np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        self.table.add(h, np.concatenate(ids), np.array([len(x) for x in ids]), raw, np.array([len(w) for w in words]))


@functools.lru_cache(maxsize=4)
def words(path: str, end_id: int) -> Words:
    return Words(path, end_id)


# ---------------------------------------------------------------- files


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: list[bytes], kind: str) -> Iterator[bytes]:
    """The parts of a shard, in order; documents are sorted, null ids first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    yield MAGIC + struct.pack("<BQQq", np.dtype(kind).itemsize, len(doc_ids), len(doc_ids) - len(known), base)
    yield EliasFano.of((known - base).astype(np.uint64)).dump()
    yield EliasFano.of(bounds).dump()
    yield from ids


class Shard:
    """A shard's bytes, opened for reading: documents in order or one at a time."""

    def __init__(self, raw):
        assert bytes(raw[:8]) == MAGIC, "not a token shard"
        self.step, self.n, self.nulls, self.base = struct.unpack_from("<BQQq", raw, 8)
        self.docs, at = EliasFano.load(raw, 8 + struct.calcsize("<BQQq"))
        self.bounds, at = EliasFano.load(raw, at)
        self.raw, self.at = raw, at

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.docs.values() + self.base).tolist()

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.raw, f"<u{self.step}", stop - start, self.at + start * self.step)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by two selects."""
        return self.ids(self.bounds.get(i), self.bounds.get(i + 1))


def write(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, most: int = SHARD
) -> list[dict]:
    """Encode every row, append ``end_id`` and write the shards and manifest to ``folder`` (a URI that all nodes share).

    Ranges of ids, whose number follows the size of all texts, are written by a task each, in shards of about ``most`` bytes of ids.
    """
    spark = docs.sparkSession
    by = F.col("doc_id").asc_nulls_first()
    rows = id_text(docs, id_col, text_col)
    if ranges is None:
        ranges = max(parts(spark), (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // RANGE)
    ranged = rows.repartitionByRange(ranges, by).sortWithinPartitions(by, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = words(tokenizer_path, end_id)
        end = np.array([end_id], coder.kind).tobytes()
        number, part = TaskContext.get().partitionId(), 0
        doc_ids, chunks, lengths, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            fs, where = pafs.FileSystem.from_uri(folder)
            name, trial = f"shard-{number:06d}-{part:06d}.ids", f".{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{where}/{trial}") as out:
                for piece in pack(doc_ids, np.array(lengths, np.int64), chunks, coder.kind):
                    out.write(piece)
            fs.move(f"{where}/{trial}", f"{where}/{name}")
            return pa.RecordBatch.from_pydict({"shard": [number], "part": [part], "name": [name], "docs": [len(doc_ids)], "ids": [sum(lengths)]})

        for batch in pieces(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode([t or "" for t in batch.column("text").to_pylist()])):
                doc_ids.append(doc_id)
                chunks += [ids, end]
                lengths.append(len(ids) // len(end) + 1)
                size += len(ids) + len(end)
                if size > most:
                    yield closed()
                    doc_ids, chunks, lengths, size, part = [], [], [], 0, part + 1
        if doc_ids:
            yield closed()

    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)
    done = ranged.mapInArrow(run, "shard long, part long, name string, docs long, ids long").collect()
    manifest, before = [], 0
    for row in sorted(done, key=lambda r: (r["shard"], r["part"])):
        manifest.append(row.asDict() | {"before": before})
        before += row["ids"]
    fs, where = pafs.FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{where}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; shards are read in parallel."""
    fs, where = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{where}/manifest.json") as f:
        manifest = json.loads(f.read())
    listing = spark.createDataFrame([(m["name"], m["before"]) for m in manifest], "name string, before long")
    listing = listing.repartition(max(1, len(manifest)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist()):
                with fs.open_input_file(f"{where}/{name}") as f:
                    shard = Shard(f.read_buffer())
                bounds = shard.bounds.values()
                crc = [zlib.crc32(shard.ids(a, b).astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids(), pa.int64()), pa.array(bounds[:-1] + before), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return listing.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_file(spark, sf_dir: str) -> DataFrame:
    """Query: every document written to the file format, and what the files say of it."""
    import public_tokenizers

    folder = f"{run_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read(spark, folder)
