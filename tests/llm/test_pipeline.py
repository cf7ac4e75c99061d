"""The pipeline against its stages done plainly in memory."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from runlens.llm import bpe, mixing, pii, quality  # noqa: E402

from .test_search import groups, shingle_set  # noqa: E402


def test_run_equals_plain_stages(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect() if score[r["doc_id"]] >= 0.5}
    sets = {i: shingle_set(t) for i, t in text.items()}
    comp = groups(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    p = pii.Pseudonyms(pii.session_key(spark))
    kept = {i: p.replace(t)[0] for i, t in text.items() if comp[i] == i}
    frame = spark.createDataFrame([(i, kept[i]) for i in kept], "doc_id long, text string").join(docs.select("doc_id", "lang"), "doc_id")
    rates = mixing.mixed(frame, mixing.labelled_languages(frame, labels), mixing.WEIGHTS)
    copies = {r["doc_id"]: r["copies"] for r in rates.collect()}
    c = bpe.codec(*bpe.default_ranks())
    want = []
    for i, t in kept.items():
        ids = c.encoding.encode_ordinary(t)
        sha = hashlib.sha256(t.encode()).hexdigest()
        want += [(i, len(ids), np.array(ids, "<u4").tobytes(), sha, sha)] * copies[i]
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["text_sha256"], r["decoded_sha256"]) for r in pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("own")).withColumn("fp", F.lit(1)).withColumn("near_id", F.lit(2)).withColumn("Mix_Rate", F.lit(3)).withColumn("th", F.lit(4))
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_copies", "private", "mixing", "tokens"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
