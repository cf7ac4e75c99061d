"""Scans that built-in expressions cannot state, in Arrow batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import diffs


@F.pandas_udf(StringType())
def fnv1a(values: pd.Series) -> pd.Series:
    """FNV-1a of 64 bits, which wraps, as 16 hexadecimal digits; null stays null.

    All texts of a batch advance together, byte by byte: the longest first, so that those that still have a byte are the first ones.
    """
    known = values.notna().to_numpy()
    raw = [t.encode() for t in values[known]]
    size = np.array([len(t) for t in raw], np.int64)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, live = (np.cumsum(size) - size)[order], np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    for at, n in enumerate(live.tolist()):
        h[:n] = (h[:n] ^ data[start[:n] + at]) * np.uint64(0x100000001B3)
    out = np.full(len(values), None, object)
    back = np.empty_like(h)
    back[order] = h
    out[known] = [f"{x:016x}" for x in back.tolist()]
    return pd.Series(out, index=values.index)


@F.pandas_udf(StringType())
def _shell_code(values: pd.Series) -> pd.Series:
    return values.map(lambda c: None if c is None else diffs.shell_code(c))


def shell_code(command: Column) -> Column:
    return _shell_code(command)


def without_recent_repeats(rows: DataFrame, key: str, order: str, value: str, back: int = 8, count_all: bool = False) -> DataFrame:
    """Rows whose value is not among the last ``back`` rows kept of their key: each decision depends on the ones before.

    Rows are dealt by key and sorted; a task streams them and holds ``back`` values, whatever a key's size. Rows without a value are
    always kept; with ``count_all`` they take a place among the last rows like others.
    """
    dealt = rows.repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = object(), deque(maxlen=back)
        for batch in batches:
            keep = []
            for k, v in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist()):
                if k != held:
                    held, kept = k, deque(maxlen=back)
                fresh = v is None or v not in kept
                if fresh and (count_all or v is not None):
                    kept.append(v)
                keep.append(fresh)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, rows.schema)
