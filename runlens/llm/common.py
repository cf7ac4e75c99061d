"""Shared plumbing: lineage cuts in the shared folder, Arrow batch mapping, sums over tasks, key filters."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python function sees at once: whole texts are wide.
ROWS = 2000
#: Bytes of an Arrow batch that Spark fills for one: its default of 64 MB, in buffers that double as they grow, is too much for each task.
BYTES = 8 << 20


@functools.lru_cache(maxsize=1)
def own_dir() -> str:
    where = tempfile.mkdtemp(prefix="runlens-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    return "file://" + where


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, local mode takes a temporary folder, which goes when the driver ends; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return own_dir()


_run_dirs: dict[tuple[str, str], str] = {}


def run_dir(spark: SparkSession) -> str:
    """One folder of this application below the shared one; the JVM removes it when the application ends."""
    key = spark.sparkContext.applicationId, shared_dir(spark)
    if key not in _run_dirs:
        path = f"{key[1]}/runlens-{key[0]}-{uuid.uuid4().hex}"
        fs, at = _hadoop(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _run_dirs[key] = path
    return _run_dirs[key]


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the time of one job; what was set before is set again after it."""
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    try:
        for k, n in names.items():
            spark.conf.set(n, values[k])
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the run's folder and reread it: a lineage cut that survives lost executors.

    Spark drops the shuffle files of the job when it ends, so that the peak disk is that of one phase.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxRecordsPerBatch=str(ROWS), spark__sql__execution__arrow__maxBytesPerBatch=str(BYTES)):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Remove what ``stash`` wrote, once nothing that is still to run reads it."""
    for df in stashed:
        fs, at = _hadoop(df.sparkSession, df.stash_path)
        fs.delete(at, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``rows`` rows, and to about ``size`` bytes, at most; empty ones are left out."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, min(rows, int(size * batch.num_rows / max(1, batch.nbytes))))
            for lo in range(0, batch.num_rows, step):
                yield batch.slice(lo, step)
            pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in the session's Arrow batches than Spark's default, which suits narrow rows: whole texts are wide.

    Operators leave the session as it is; queries and the pipeline, whose results are written by others, ask for this.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ROWS:
        spark.conf.set(name, ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int = BYTES) -> DataFrame:
    """``mapInArrow`` of a function from one batch, of about ``size`` bytes at most, to one batch.

    Of a result of this function itself both run in one Python process: each that a task has at once is one that its executor keeps.
    """
    source, steps = vars(df).get("map_steps", (df, ()))
    steps = (*steps, (fn, size))
    out = source.mapInArrow(lambda batches: stepped(batches, steps), schema)
    out.map_steps = source, steps
    return out


def stepped(batches: Iterator[pa.RecordBatch], steps: tuple) -> Iterator[pa.RecordBatch]:
    """What the functions of ``steps`` make of the batches, one after the other."""
    for fn, size in steps:
        batches = map(fn, pieces(batches, size=size))
    return iter(batches)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as strings; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    col = batch.column(name)
    return [t or b"" for t in col.cast(pa.binary()).to_pylist()]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators need, as (doc_id long, text string); all others are pruned from the scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


# ---------------------------------------------------------------- vectors added up over tasks

#: Numbers in one row of a partial sum, and tasks that add up partial sums.
CHUNK, SLOTS = 512, 16


def _merged(rows: DataFrame, kind: str, add, width: int) -> np.ndarray:
    """Combine rows (chunk, pid, v) in few tasks, each in the order of the tasks that made them; the driver combines what these give.

    A task holds one vector and streams its sorted rows, however many tasks made them.
    """
    size = CHUNK * 8 // np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, any_ = np.zeros(width, kind), False
        for batch in batches:
            for chunk, v in zip(batch.column("chunk").to_pylist(), batch.column("v").to_pylist()):
                part, any_ = total[chunk * size : (chunk + 1) * size], True
                add(part, np.frombuffer(v, kind), out=part)
        if any_:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    slots = SLOTS if width * np.dtype(kind).itemsize <= 1 << 20 else SLOTS // 4  # the driver gets 64 MB at most
    dealt = rows.repartition(slots).sortWithinPartitions("pid", "chunk").select("chunk", "v")
    out = np.zeros(width, kind)
    for r in sorted(dealt.mapInArrow(run, "slot int, v binary").collect(), key=lambda r: r["slot"]):
        add(out, np.frombuffer(r["v"], kind), out=out)
    return out


def vector_sum(df: DataFrame, fn, width: int) -> np.ndarray:
    """Sum over all rows of ``fn(batch) -> float64 vector of a fixed width``, as one numpy vector on the driver.

    Each task adds up its batches; the tasks' vectors are cut in chunks and dealt to 16 tasks, which add them up in the order of tasks, so
    that a rerun adds in the same order. The driver receives ``16 * width`` numbers at any input size.
    """
    source, steps = vars(df).get("map_steps", (df, ()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(width)
        for batch in pieces(stepped(batches, steps)):
            total += fn(batch)
        pid = TaskContext.get().partitionId()
        made = [total[lo : lo + CHUNK].tobytes() for lo in range(0, width, CHUNK)]
        n = len(made)
        cols = [pa.array(range(n), pa.int32()), pa.array([pid] * n, pa.int64()), pa.array(made, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["chunk", "pid", "v"])

    return _merged(source.mapInArrow(partial, "chunk int, pid long, v binary"), "f8", np.add, width)


class Bitmap:
    """Which 64-bit hashes may be among given ones: a Bloom filter of two bits a hash, sized by their number.

    It lets rows that a join would drop stay where they are: at ``EACH`` bits a hash some two in a hundred others pass. ``MOST`` bits
    (16 MB) bound what a worker holds: beyond some ten million hashes more rows pass, and the join decides as before.
    """

    EACH, LEAST, MOST = 12, 1 << 16, 1 << 27

    def __init__(self, packed: bytes):
        self.packed, self.bits = packed, 8 * len(packed)

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Bitmap:
        """The filter of a column of hashes; each task sends the chunks that it sets bits in, and chunks are combined apart.

        Of a result of ``map_arrow`` both run in one Python process, as there.
        """
        source, steps = vars(df).get("map_steps", (df.select(column), ()))
        count, bits = df.select(column).count(), cls.LEAST
        while bits < min(cls.MOST, cls.EACH * count):
            bits *= 2
        size = CHUNK * 8

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            flags = np.zeros(bits // 8, np.uint8)
            for batch in pieces(stepped(batches, steps), 1 << 16):
                h = batch.column(column).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
                for at in places(h, bits):
                    np.bitwise_or.at(flags, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            chunks = flags.reshape(-1, size)
            some = np.flatnonzero(chunks.any(axis=1))
            pid, n = TaskContext.get().partitionId(), len(some)
            cols = [pa.array(some.astype(np.int32)), pa.array([pid] * n, pa.int64()), pa.array([chunks[i].tobytes() for i in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["chunk", "pid", "v"])

        rows = source.mapInArrow(partial, "chunk int, pid long, v binary")
        return cls(_merged(rows, "u1", np.bitwise_or, bits // 8).tobytes())

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        packed = np.frombuffer(self.packed, np.uint8)
        hit = [packed[at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in places(hashes.view(np.uint64), self.bits)]
        return (hit[0] & hit[1]).astype(bool)


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % np.uint64(bits)).astype(np.int64), ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)).astype(np.int64)
