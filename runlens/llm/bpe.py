"""Byte-level BPE encoding and decoding as a monoid over halves of a text.

Encoding: halves are encoded recursively and neighbours joined. A join re-encodes a window round the seam that grows until
its ends are cuts which no match of the splitting pattern can span: a non-space character followed by a space, tab or
line break. No alternative of the pattern continues from a non-space to white space, and none that ends there looks beyond,
so tokens outside the window are those of the whole text. That is shown for ``public_tokenizers.PATTERN`` alone: other patterns are
refused. The leaves of the tree, ``LEAF`` characters or fewer, and the windows are encoded by the library. A window of over ``LONG``
characters is one run of that length without a cut, where the library's engine of patterns needs stack for every character: the
``regex`` module splits it by the same pattern, and the library encodes the pieces. Decoding concatenates byte strings up the same tree.

Nulls and empty texts give no ids; texts of any length are taken whole. Rows are independent: repeated rows give equal results. Only the
id and the text are read, so other columns cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import id_text, map_arrow, texts

LEAF = 512
LONG = 1 << 16
CUT = re.compile(r"\S(?=[ \n\t])")


class Codec:
    """Ids for text under a rank file and a splitting pattern, and back."""

    def __init__(self, ranks_path: str, pattern: str):
        import public_tokenizers

        if pattern != public_tokenizers.PATTERN:
            raise ValueError("the cuts of the reduction are shown for public_tokenizers.PATTERN only")
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def leaf(self, text: str) -> np.ndarray:
        if len(text) <= LONG:
            return np.array(self.encoding.encode_ordinary(text), np.uint32)
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.encoding._encode_single_piece(piece)
        return np.array(out, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LEAF:
            return self.leaf(text)
        mid = len(text) // 2
        return self.join(text[:mid], self.encode(text[:mid]), text[mid:], self.encode(text[mid:]))

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """Ids of ``left + right`` from those of both."""
        if CUT.match(left[-1] + right[0]):
            return np.concatenate([left_ids, right_ids])
        a, b = last_cut(left), first_cut(right)
        keep = len(left_ids) - len(self.leaf(left[a:]))
        drop = len(self.leaf(right[:b]))
        return np.concatenate([left_ids[:keep], self.leaf(left[a:] + right[:b]), right_ids[drop:]])

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= 8 * LEAF:
            return b"".join([self.table[i] for i in ids.tolist()])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def last_cut(text: str) -> int:
    """Start of the last part of ``text`` after a cut, looked for in windows that double; 0 without one."""
    size = 64
    while True:
        at = max(0, len(text) - size)
        found = None
        for found in CUT.finditer(text, at):
            pass
        if found:
            return found.end()
        if not at:
            return 0
        size *= 2


def first_cut(text: str) -> int:
    """End of the first part of ``text`` before a cut; its length without one."""
    size = 64
    while True:
        found = CUT.search(text[: size + 1])
        if found:
            return found.end()
        if size >= len(text):
            return len(text)
        size *= 2


@functools.lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a process for each rank file."""
    return Codec(ranks_path, pattern)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids binary) of every row; ids are little-endian unsigned 32-bit integers."""
    own_path, own_pattern = default_ranks()
    path, pat = ranks_path or own_path, pattern or own_pattern

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pat)
        ids = [c.encode(t) for t in texts(batch)]
        n, raw = [len(x) for x in ids], [x.astype("<u4").tobytes() for x in ids]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids binary")


def decode(rows: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes binary) of rows as ``encode`` gives them; null ids decode to no bytes."""
    own_path, own_pattern = default_ranks()
    path, pat = ranks_path or own_path, pattern or own_pattern

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pat)
        raw = [c.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return map_arrow(rows.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, without moving the ids."""
    own_path, own_pattern = default_ranks()
    path, pat = ranks_path or own_path, pattern or own_pattern

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, n, ids_hex, back_hex = codec(path, pat), [], [], []
        for text in texts(batch):
            ids = c.encode(text)
            n.append(len(ids))
            ids_hex.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            back_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
        cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(back_hex, pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, text_sha256, decoded_sha256) of every row: ids that can be stored, and proof that they decode."""
    own_path, own_pattern = default_ranks()
    path, pat = ranks_path or own_path, pattern or own_pattern

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, n, raw, sha, back = codec(path, pat), [], [], [], []
        for text in texts(batch):
            ids = c.encode(text)
            n.append(len(ids))
            raw.append(ids.astype("<u4").tobytes())
            sha.append(hashlib.sha256(text.encode()).hexdigest())
            back.append(hashlib.sha256(c.decode(ids)).hexdigest())
        cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(raw, pa.binary()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "text_sha256", "decoded_sha256"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids binary, text_sha256 string, decoded_sha256 string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Query: ids and their decoding, as digests, of every document."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
