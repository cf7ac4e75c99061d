"""Exact fingerprints of canonical texts.

The canonical text is NFKC, case-folded, NFKC again, with runs of white space folded to one space and none at the ends. Its
fingerprint is the 128-bit XXH3 of its UTF-8 bytes. Rows with equal fingerprints are held against each other byte by byte, and against
edited texts of that fingerprint by SHA-256; in a bucket that holds different texts each fingerprint, of a document or of an edited
text, gets a suffix that tells them apart.

A null text counts as empty; texts of any length are taken whole. Two fingerprints are alike (1.0) or not (0.0); equal canonical texts always are. The next
document of the last in descending id order is the first; a table of one row is its own next. Null ids come last in the
order; equal ids are ordered by text; repeated rows keep a row each. An empty table gives an empty result. Only the id and the text
are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_text, map_arrow, parts, pieces, stash, texts


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], str] = digest) -> DataFrame:
    """(doc_id, fp, size) of every row, before buckets are verified; size is the text's in bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_ = texts(batch)
        fp = [digest(canonical(t)) for t in all_]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.string()), pa.array([len(t) for t in all_], pa.int64())], ["doc_id", "fp", "size"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, fp string, size long")


ROW = (
    "kind int, part int, doc_id long, text string, n_chars long, edited_sha256 string, fp string, edited_fp string, near_edited double, near_next double, "
    "canon binary, canon_sha binary, edited_canon_sha binary"
)
#: Characters of one range of ids.
RANGE = 64 << 20


def pair_row(doc_id, text: str, nxt: str, marked: set[str], digest: Callable[[bytes], str]) -> tuple:
    """What a document and its next one give."""
    n = len(text)
    half = n // 2
    edited = text[: n - half] + nxt[:half]
    own, other, following = canonical(text), canonical(edited), canonical(nxt)
    fp = digest(own)
    sha = [hashlib.sha256(x) for x in (edited.encode(), own, other)]
    return (0, 0, doc_id, None, n, sha[0].hexdigest(), fp, digest(other), float(own == other), float(own == following), own if fp in marked else None, sha[1].digest(), sha[2].digest())


def exact_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], str] = digest) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Texts are shuffled once, to ranges of ids whose number follows their size, where neighbours meet. The last row of a range waits for
    the first of the next, in a second step over two rows a range. Canonical bytes are kept for rows of shared buckets alone, and
    compared there by minimum and maximum, which combine map-side at any bucket size.
    """
    spark = docs.sparkSession
    base = id_text(docs, id_col, text_col)
    narrow = stash(fingerprints(docs, id_col, text_col, digest), "digests")
    shared = stash(narrow.groupBy("fp").count().where("count > 1").select("fp"), "shared")
    marks = narrow.join(shared, "fp", "left_semi").select("doc_id", F.col("fp").alias("text"), F.lit(1).alias("mark")).distinct()
    rows = base.select("doc_id", "text", F.lit(0).alias("mark")).unionByName(marks)
    by = F.col("doc_id").desc_nulls_last()
    chars = narrow.agg(F.sum("size")).first()[0] or 0
    rows = rows.repartitionByRange(max(parts(spark), chars // RANGE), by).sortWithinPartitions(by, F.desc("mark"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        held, marked_id, marked, first = None, None, set(), True
        for batch in pieces(batches):
            out = []
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "text", "mark")]
            for doc_id, text, mark in zip(*cols):
                if mark:
                    if marked_id != (doc_id,):
                        marked_id, marked = (doc_id,), set()
                    marked.add(text)
                    continue
                text = text or ""
                if first:
                    out.append((2, number, doc_id, text, *[None] * 9))
                    first = False
                if held is not None:
                    out.append(pair_row(held[0], held[1], text, held[2], digest))
                held = (doc_id, text, marked if marked_id == (doc_id,) else set())
            if out:
                yield as_batch(out)
        if held is not None:
            fp = digest(canonical(held[1]))
            yield as_batch([(1, number, held[0], held[1], *[None] * 6, b"1" if fp in held[2] else None, None, None)])

    made = stash(rows.mapInArrow(run, ROW), "pairs")
    discard(narrow, shared)
    done = made.where("kind = 0")
    ranges = sorted(r["part"] for r in made.where("kind = 2").select("part").collect())
    if ranges:
        follow = spark.createDataFrame([(a, b) for a, b in zip(ranges, ranges[1:] + ranges[:1])], "part int, heir int")
        heads = made.where("kind = 2").select(F.col("part").alias("heir"), F.col("text").alias("next_text"))
        open_rows = made.where("kind = 1").select("part", "doc_id", "text", "canon").join(follow, "part").join(heads, "heir")

        def close(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text", "canon")]
            return as_batch([pair_row(d, t, x, {digest(canonical(t))} if c else set(), digest) for d, t, x, c in zip(*cols)])

        done = done.unionByName(stash(map_arrow(open_rows.select("doc_id", "text", "next_text", "canon"), close, ROW), "range-ends"))
    kinds = done.select("fp", "canon", F.col("canon_sha").alias("sha")).unionByName(done.select(F.col("edited_fp").alias("fp"), F.lit(None).cast("binary").alias("canon"), F.col("edited_canon_sha").alias("sha")))
    bounds = [f(c).alias(n) for f, c, n in ((F.min, "canon", "a"), (F.max, "canon", "b"), (F.min, "sha", "c"), (F.max, "sha", "d"))]
    collided = stash(kinds.groupBy("fp").agg(*bounds).where("a <> b or c <> d").select("fp"), "collided")
    out = done
    if not collided.isEmpty():
        for fp, sha in (("fp", "canon_sha"), ("edited_fp", "edited_canon_sha")):
            out = out.join(collided.select(F.col("fp").alias("__hit")), F.col(fp) == F.col("__hit"), "left")
            out = out.withColumn(fp, F.when(F.col("__hit").isNotNull(), F.concat(fp, F.lit("-"), F.lower(F.hex(sha)))).otherwise(F.col(fp))).drop("__hit")
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(col), kind) for col, kind in zip(zip(*rows), kinds)], names)


def op8_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprints of every document and of its edited text."""
    return exact_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
