"""Queries of the operators, and SQL for those that DuckDB can express."""

from __future__ import annotations

from . import ann, bpe, chat, fingerprint, mixing, pii, quality, simhash, suffix, tokenfile
from .common import small_batches


def whole_tables(fn):
    """A query whose session takes whole texts in small batches."""

    def run(spark, sf_dir):
        small_batches(spark)
        return fn(spark, sf_dir)

    run.__doc__, run.__name__ = fn.__doc__, fn.__name__
    return run


_ALL = (
    simhash.op1_simhash, bpe.op2_bpe, ann.op3_nearest, mixing.op4_mixing, pii.op5_pii, chat.op6_chat, quality.op7_quality, fingerprint.op8_fingerprint,
    tokenfile.op9_token_file, suffix.op10_suffix_dedup,
)
QUERIES = {fn.__name__: whole_tables(fn) for fn in _ALL}

ORACLES = {"op6_chat": chat.OP6_SQL}
