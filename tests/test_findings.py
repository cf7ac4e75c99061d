"""Cases of the review's findings, held against the queries' own SQL."""

import os
import random
from datetime import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from runlens.llm import ann, common, simhash, suffix
from runlens.operators import events, joins, sets
from runlens.plans import registry


def same_as_sql(spark, folder, name):
    """The rows of a query over the tables in ``folder``, which its SQL gives too."""
    db = duckdb.connect()
    for f in folder.iterdir():
        db.execute(f"create view {f.stem} as select * from read_parquet('{f}/*.parquet')")
    df = registry.QUERIES[name](spark, str(folder))
    got = sorted(map(tuple, df.collect()), key=str)
    want = db.execute("select " + ", ".join(f'"{c}"' for c in df.columns) + f" from ({registry.ORACLES[name]})").fetchall()
    assert got == sorted(want, key=str)
    return got


def stored(spark, folder, rows):
    df = spark.createDataFrame([(i, *r, 0.0, '{"k": 1}') for i, r in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(str(folder / "events.parquet"))


@pytest.mark.parametrize("name", ["rule_scores", "run_latency"])
def test_message_before_the_click_of_its_second(spark, tmp_path, name):
    at = lambda m, s, us=0: datetime(2024, 1, 1, 0, m, s, us)
    stored(spark, tmp_path, [(at(0, 5, 100_000), 7, "purchase"), (at(0, 5, 900_000), 7, "click"), (at(9, 0), 7, "purchase"), (at(0, 1, 999_999), 9, "click"), (at(0, 2), 9, "purchase")])
    got = same_as_sql(spark, tmp_path, name)
    assert name == "rule_scores" or got == [(2, 2, 535, 535, 535)]


@pytest.mark.parametrize("name", ["rule_scores", "run_latency"])
def test_run_without_a_message(spark, tmp_path, name):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    stored(spark, tmp_path, [(at(0), 7, "click"), (at(40), 7, "view"), (at(0), 8, "click"), (at(3), 8, "purchase"), (at(0), 9, "purchase"), (at(1), 9, "click"), (at(0), None, "click")])
    same_as_sql(spark, tmp_path, name)


def trials_stored(spark, folder, rows):
    """rows: (return flag, supplier, status); the other columns are filled."""
    cols = "l_returnflag string, l_suppkey long, l_linestatus string"
    df = spark.createDataFrame(rows, cols).selectExpr(
        "1L as l_orderkey", "1L as l_partkey", "l_suppkey", "1 as l_linenumber", "1D as l_quantity", "1D as l_extendedprice", "0D as l_discount", "0D as l_tax", "l_returnflag", "l_linestatus", "timestamp_ntz'2024-01-01' as l_shipdate")
    df.coalesce(1).write.parquet(str(folder / "lineitem.parquet"))


def test_wins_of_tasks_with_one_trial(spark, tmp_path):
    job = lambda task, a, r: [("A", task, x) for x in a] + [("R", task, x) for x in r]
    rows = job(1, "F", "F") + job(2, "F", "FF") + job(3, "FF", "F") + job(4, "O", "FO") + job(5, "FO", "O") + job(6, "FO", "OF") + job(7, "FFO", "FOO") + job(8, "O", "OO")
    trials_stored(spark, tmp_path, rows)
    assert same_as_sql(spark, tmp_path, "win_tie_loss") == [(2, 1, 2)]


@pytest.mark.parametrize("tasks, want", [
    ([("FO", [None]), ([None, None], "F"), ([None], [None]), (["F", None, "O"], "FFO"), ("FO", "O")], (2, 0, 1)),
    ([("F", "F"), ("FO", [None])], (1, None, 0)), ([("F", "F"), ([None], "O")], (0, None, None)), ([("F", "")], (None, None, None)),
])
def test_wins_of_tasks_without_rewards(spark, tmp_path, tasks, want):
    trials_stored(spark, tmp_path, [(job, t, x) for t, both in enumerate(tasks) for job, trials in zip("AR", both) for x in trials])
    assert same_as_sql(spark, tmp_path, "win_tie_loss") == [want]


def test_equal_tasks_tie_in_any_order(spark, tmp_path):
    """Welford's sums give 1.0000000000000002 times the spread in some orders; the counts of 0 and 1 are equal."""
    rows = [("A", t, "F" if i % 3 else "O") for t in range(40) for i in range(3 * (t + 5))]
    rows += [("R", t, "F" if i >= t + 5 else "O") for t in range(40) for i in range(3 * (t + 5))]
    trials_stored(spark, tmp_path, rows)
    got = registry.QUERIES["win_tie_loss"](spark, str(tmp_path)).first()
    assert tuple(got) == (0, 40, 0)


def hot_texts():
    """Texts that have one line in common, half of it or all, among them some near copies of each other."""
    rng, line = random.Random(3), [f"l{i}" for i in range(14)]
    rows = [line[: 14 - i % 3] + [f"x{rng.randrange(10**6)}" for _ in range(i % 4 + 1)] for i in range(40)]
    rows += [[*rows[i][:-1], "end"] for i in range(20)] + [line + [f"y{rng.randrange(10**6)}" for _ in range(60)] for _ in range(20)]
    return [" ".join(r) for r in rows]


@pytest.mark.parametrize("brought", [32, 3])
def test_texts_under_hot_shingles_meet_as_by_brute_force(spark, monkeypatch, brought):
    for name, value in (("SHARED", 4), ("BROUGHT", brought), ("HOTTEST", 6 if brought == 3 else 1 << 16)):
        monkeypatch.setattr(simhash, name, value)
    texts = dict(enumerate(hot_texts()))
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in texts.items()}
    made = simhash.first_shingles(spark.createDataFrame(list(texts.items()), "th long, text string"), 5, 0.8)
    roots = spark.createDataFrame([(0, 0)], "th long, root long")
    got = {(r["a"], r["b"]) for r in simhash.may_be_similar(made, roots, 0.8).collect()}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want and want <= got


def test_chains_leave_unlike_texts_alone(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARED", 4)
    line = [f"l{i}" for i in range(12)]
    texts = {i: " ".join([f"x{i}-{j}" for j in range(8)] + line) for i in range(30)}
    made = simhash.first_shingles(spark.createDataFrame(list(texts.items()), "th long, text string"), 5, 0.1)
    keys = simhash.common_keys(made)
    assert keys.count() > 0
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in texts.items()}
    near = simhash.chains(made, spark.createDataFrame([(0, 0)], "th long, root long"), keys, 0.1, 0).collect()
    assert len(near) < 10, [len(sets[r["a"]] & sets[r["b"]]) for r in near]


def test_counts_in_buckets_bound_what_sets_share():
    rng = np.random.default_rng(1)
    for n in (1, 30, 3000):
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y, z = np.unique(np.append(x[n // 10 :], rng.integers(0, 1 << 62, n // 20).astype(np.uint64))), np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        a, b, c = map(simhash.bucket_counts, (x, y, z))
        assert simhash.may_share(a, b, 0.8) and (n == 1 or not simhash.may_share(a, c, 0.8))
    assert simhash.bucket_counts(np.arange(300, dtype=np.uint64) * np.uint64(simhash.BUCKETS)) == b""


@pytest.mark.parametrize("want", [1, 40, 10**6])
def test_walk_takes_cells_of_equal_sums_together(want):
    rng = np.random.default_rng(want)
    a, b = rng.integers(-9, 9, 16) / 2, rng.integers(-9, 9, 8) / 2
    counts = rng.integers(0, 4, 128)
    full = np.flatnonzero(counts)
    sums = {c: a[c // 8] + b[c % 8] for c in full.tolist()}
    least = min(t for t in sums.values() if sum(counts[c] for c in sums if sums[c] > t) < want)
    assert ann.walk(a, b, full, counts[full], want).tolist() == [c for c in sums if sums[c] >= least]


def test_batches_of_wide_rows_are_cut_by_bytes_before_python_sees_them(spark, tmp_path):
    def told(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    wide = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    assert max(r["n"] for r in common.stash(wide.mapInArrow(told, "n long"), "told").collect()) <= common.BYTES + 200_000


def test_pairs_of_one_key_are_made_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(events, "BLOCK", 8, raising=False)
    rng = random.Random(5)
    rows = [("k", i, lo, lo + rng.randrange(60)) for i in range(150) for lo in [rng.randrange(30)]] + [("z", i, 10 * i, 10 * i + 10) for i in range(20)]
    out = events.overlaps(spark.createDataFrame(rows, "key string, who long, lo long, hi long"), "key", "who", 0)
    want = sorted((k, a, b, max(x, u), min(y, v)) for k, a, x, y in rows for m, b, u, v in rows if k == m and a < b and x <= v and u <= y)
    assert sorted(map(tuple, out.collect())) == want
    assert out.where("key = 'k'").select(F.spark_partition_id()).distinct().count() > 4


def test_sets_that_share_a_few_words_are_no_candidates(spark):
    rng = random.Random(9)
    made = [rng.sample(range(400), rng.randrange(20, 60)) for _ in range(120)]
    made += [[*m[: len(m) * 4 // 5], *rng.sample(range(400, 800), len(m) // 5)] for m in made[:40]]
    sets = {i: set(m) for i, m in enumerate(made)}
    likeness = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    got = {tuple(r) for r in joins.candidate_pairs(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, ws array<long>"), 0.5).collect()}
    want = {p for p, x in likeness.items() if x >= 0.5}
    assert len(want) > 30 and want <= got and len(got) < len(likeness) // 20


def test_functions_that_follow_each_other_share_a_python_process(spark):
    def pid(batch):
        return pa.RecordBatch.from_arrays([pa.array([os.getpid()] * batch.num_rows), batch.column(0)], ["first", "id"])

    def both(batch):
        return pa.RecordBatch.from_arrays([batch.column("first"), pa.array([os.getpid()] * batch.num_rows), batch.column("id")], ["first", "second", "id"])

    made = common.map_arrow(common.map_arrow(spark.range(0, 10, 1, 1), pid, "first long, id long"), both, "first long, second long, id long")
    got = made.collect()
    assert all(r["first"] == r["second"] for r in got) and [r["id"] for r in got] == list(range(10))
    odd = common.map_arrow(spark.range(0, 10, 1, 1), lambda b: b.filter(pa.compute.equal(pa.compute.bit_wise_and(b.column("id"), 1), 1)), "id long")
    assert common.vector_sum(odd, lambda b: np.array([b.num_rows, sum(b.column("id").to_pylist())], float), 2).tolist() == [5, 25]


def test_copies_under_a_hot_anchor_are_not_cut_to_windows(spark, monkeypatch):
    def never(*_):
        raise AssertionError("windows were made")

    rng = random.Random(5)
    text = "".join(rng.choices("abcdefgh ", k=1500))
    texts = {**{i: text for i in range(8)}, 8: text[:700] + "#" * 30 + text[900:], 9: None}
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(texts.items()), len(texts)), "doc_id long, text string")
    monkeypatch.setattr(suffix, "counted_windows", never)
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix.remove_repeats(docs, hot=2).collect()}
    assert got == {**{i: (1500, b"") for i in range(8)}, 8: (1300, b"#" * 30), 9: (0, b"")}


def shuffled(spark):
    """Bytes that all stages of the session have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    jvm = spark.sparkContext._jvm
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_similar_pairs_shuffle_few_bytes_a_word(spark):
    rng = random.Random(5)
    made = [[f"w{int(4000 * rng.random() ** 2)}" for _ in range(200)] for _ in range(1000)] + [[f"c{i}" for i in range(200)]] * 100
    before = shuffled(spark)
    got = joins.similar_pairs(spark.createDataFrame(list(enumerate(made)), "id long, ws array<string>"), "id", F.col("ws")).count()
    words = sum(len(set(m)) for m in made)
    assert got == 100 * 99 // 2 and shuffled(spark) - before < 8 * words


@pytest.mark.parametrize("size, numbered", [(1 << 19, 1 << 20), (4000, 50), (2000, 0)])
def test_similar_sets_in_any_blocks_as_by_brute_force(spark, monkeypatch, size, numbered):
    for name, value in (("BLOCK", size), ("LEAST_BLOCK", size), ("NUMBERED", numbered)):
        monkeypatch.setattr(sets, name, value)
    rng = random.Random(6)
    made = [sorted({int(300 * rng.random() ** 3) - 150 for _ in range(rng.randrange(1, 60))}) for _ in range(80)]
    made += [m[: len(m) * 3 // 4 + 1] for m in made[:30]] + made[:10] + made[:5] + [[7] * 1, [7], [2**63 - 1, -(2**63)], []]
    ids = rng.sample(range(10**12), len(made))
    rows = dict(zip(ids, map(set, made)))
    got = sorted(map(tuple, sets.similar_sets(spark.createDataFrame(list(zip(ids, made)), "id long, ws array<long>"), 0.5).collect()))
    want = [(a, b, len(rows[a] & rows[b]) / len(rows[a] | rows[b])) for a in sorted(ids) for b in sorted(ids) if a < b and rows[a] and rows[b]]
    assert got == [w for w in want if w[2] >= 0.5] and len(got) > 40
