"""Hard negatives against brute force: the scan alone, whole searches over many blocks, odd tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.llm import bond


def block(n, dims, labels=3, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    v = np.floor(256 * rng.normal(size=(n, dims)) * spread ** np.arange(dims)).astype(np.int64)
    return bond.Columns(rng.permutation(n), rng.integers(0, labels, n), v), v


@pytest.mark.parametrize("spread", [1.0, 0.8])
def test_scan_keeps_all_that_counts(spread):
    columns, _ = block(3000, 40, spread=spread)
    rng = np.random.default_rng(5)
    for _ in range(20):
        anchor = np.floor(256 * rng.normal(size=40) * spread ** np.arange(40)).astype(np.int64)
        scores = anchor @ columns.dims
        alive = columns.labels == 1
        ids, got = columns.first(*columns.scan(anchor, alive, bond.highest(5)), 5)
        want = sorted(zip(-scores[alive], columns.ids[alive]))[:5]
        assert list(zip(-got, ids)) == want
        tops = sorted({-w[0] for w in want if w[0] < 0})
        ranges = [(-(-80 * t // 100), int(t)) for t in tops]
        at, score = columns.scan(anchor, ~alive, bond.windows(ranges, 5))
        for a, b in ranges:
            inside = (score >= a) & (score <= b)
            ids, got = columns.first(at[inside], score[inside], 5)
            fits = ~alive & (scores >= a) & (scores <= b)
            assert list(zip(-got, ids)) == sorted(zip(-scores[fits], columns.ids[fits]))[:5]


def test_scan_reads_fewer_and_fewer_candidates():
    columns, _ = block(20_000, 64, spread=0.85)
    anchor = columns.dims[:, 7].copy()
    left = []

    def watched(low, high, narrow=bond.highest(5)):
        keep = narrow(low, high)
        left.append(int(keep.sum()))
        return keep

    columns.scan(anchor, np.ones(20_000, dtype=bool), watched)
    assert left == sorted(left, reverse=True)
    assert left[1] < 10_000 and left[3] < 500


def brute(rows):
    """The contract; of rows with one id the least by label, then vector."""
    one = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        one[i] = min(one.get(i, own), own)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in one.items():
        if a % 100:
            continue
        scored = sorted((-dot(v, w), i, other == label) for i, (other, w) in one.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fits = [(i, -t) for t, i, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, rank + 1, i, -s, t) for rank, (i, t) in enumerate(fits)]
    return sorted(out)


def found(spark, rows, folder, schema="vec_id long, embedding array<float>, label int, block string, v string, rank int"):
    spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema).write.parquet(f"{folder}/embeddings.parquet")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in bond.op13_hard_negatives(spark, str(folder)).select(*names).collect())


def vectors(n, dims=6, labels=4):
    rng = np.random.default_rng(n)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=dims)], int(rng.integers(0, labels))) for i in range(n)]


def test_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bond, "ROW_BYTES", 2048)
    monkeypatch.setattr(bond, "ANCHOR_BYTES", 128)
    rows = vectors(900)
    assert found(spark, rows, tmp_path) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = vectors(250, dims=3)
    rows += [(300, [0.5, 0.5, 0.5], 1)] + [(1000 + i, [0.4, 0.4, 0.4], 1) for i in range(40)] + [(2000 + i, [0.4, 0.4, 0.4], 2) for i in range(40)]  # ties in any number
    rows += [(400, None, 1), (401, [], 1), (402, [0.1], 2), (500, [0.1, None, 0.2], 1), (600, [0.1, float("nan"), 0.2], 1), (601, [float("inf"), 0.0, 0.0], 1), (700, [0.3, 0.2, 0.1], None), (None, [0.3, 0.2, 0.1], 1)]
    rows += [(800, [0.0, 0.0, 0.0], 3), (-100, [-0.3, 0.2, 0.1], -4), rows[3], rows[3], (100, [9.0, 9.0, 9.0], 3), (900, [0.25], 9)]
    want = brute(rows)
    assert len(want) > 60
    assert found(spark, rows, tmp_path) == want


@pytest.mark.parametrize("rows", [[], [(100, [0.5], 1)], [(1, [0.5], 1), (2, [0.4], 2)], [(100, [0.5], 1), (1, [0.5], 1)]], ids=["empty", "one", "no anchor", "one label"])
def test_few_rows(spark, tmp_path, rows):
    assert found(spark, rows, tmp_path) == []


def test_given_vectors_equal_sql(spark):
    folder = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = bond.op13_hard_negatives(spark, folder)
    want = con.sql(bond.SQL)
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_negative_scores_have_no_window(spark):
    rows = spark.createDataFrame([(0, 1, [256]), (1, 1, [-256]), (2, 2, [-256]), (3, 2, [-250])], "vec_id long, label long, v array<long>")
    assert bond.hard_negatives(rows, rows.where(F.col("vec_id") == 0)).collect() == []
