"""Vector searches past one block of queries, and distances without a window."""

import numpy as np

from photolake.operators import vectors
from photolake.plans import registry


def test_more_queries_than_a_block_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1300, 6))
    v[700:760] = v[5]
    df = spark.createDataFrame([(int(i), [float(y) for y in x]) for i, x in enumerate(v)], "id long, embedding array<double>")
    got = {(r.query, r["rank"]): r.id for r in vectors.nearest(df.where("id < 1150"), df, 4, block=500).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.round(1 - u[:1150] @ u.T, 12)
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    plain = [i for i in range(1150) if i != 5 and not 700 <= i < 760]
    assert len(got) == 4 * 1150
    assert all([got[i, r + 1] for r in range(4)] == order[i].tolist() for i in plain if not set(order[i].tolist()) & {5, *range(700, 760)})
    assert all({got[i, r + 1] for r in range(4)} <= {5, *range(700, 760)} for i in (5, 700, 759))


def test_distances_to_one_vector_need_no_window(spark):
    plan = registry.queries()["fn_cosine"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan


def clustered(rng, n=900, dim=8):
    centres = rng.normal(size=(30, dim))
    v = centres[rng.integers(0, 30, n)] + rng.normal(0, 0.15, (n, dim))
    v[100:160] = v[3]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_neighbours_in_small_tiles_equal_brute_force(spark):
    v = clustered(np.random.default_rng(5))
    df = spark.createDataFrame([(int(i), int(i % 2), [float(y) for y in x]) for i, x in enumerate(v)], "id long, owner_id long, embedding array<double>")
    d = 1 - v @ v.T
    for reach in (0.01, 0.1, 0.5):
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= reach)) if i != j and i % 2 == j % 2}
        got = {(r.id, r.other) for r in vectors.neighbours(df, reach, keys=("owner_id",), block=40).collect()}
        assert got == want


def test_near_searches_leave_cells_out(spark):
    v = clustered(np.random.default_rng(6))
    df = spark.createDataFrame([(int(i), [float(y) for y in x]) for i, x in enumerate(v)], "id long, embedding array<double>")
    near, far = vectors._tiles(df, 0.01, (), 4096, 4096), vectors._tiles(df, 0.5, (), 4096, 4096)
    assert near.select("cell").distinct().count() > 20 and near.where("asks").count() < 0.25 * 900 * 30
    # at a distance that reaches most cells there is one cell, and no copies
    assert far.where("asks").count() == 900


def test_faces_in_small_tiles_equal_brute_force(spark, monkeypatch):
    v = clustered(np.random.default_rng(7), 500)
    df = spark.createDataFrame([(int(i), [float(y) for y in x]) for i, x in enumerate(v)], "id long, embedding array<double>")
    tiles = vectors._tiles
    monkeypatch.setattr(vectors, "_tiles", lambda *a: tiles(*a[:4], 50))
    d = 1 - v @ v.T
    near = d <= 0.03
    core = near.sum(axis=1) >= 6
    low = list(range(500))
    for _ in range(500):
        new = [min(low[j] for j in np.flatnonzero(near[i] & core)) if core[i] else low[i] for i in range(500)]
        if new == low:
            break
        low = new
    want = {}
    for i in range(500):
        others = np.flatnonzero(near[i] & core)
        want[i] = low[i] if core[i] else low[others[np.lexsort((others, d[i, others]))[0]]] if len(others) else None
    assert {r.id: r.person for r in vectors.cluster_faces(df, 0.03, 6).collect()} == want
    assert len({x for x in want.values() if x is not None}) > 5 and None in want.values()


def test_faces_are_only_found_by_photos_since_their_birth(spark):
    rows = [(1, [1.0, 0.0], None, 5.0), (2, [1.0, 0.1], 3.0, 2.0), (3, [1.0, 0.2], 9.0, None), (4, None, None, 5.0), (5, [0.0, 1.0], 1.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, born double, taken double")
    found = vectors.neighbours(df, 0.1, k=2, with_self=True, since="born", until="taken")
    assert sorted((r.id, r.other, r["rank"]) for r in found.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (3, 1, 1), (5, 5, 1)]


def test_only_faces_on_the_timeline_make_a_person(spark):
    rows = [(i, [1.0, i / 1000], i != 2) for i in range(4)] + [(i, [0.0, 1.0], False) for i in range(10, 14)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, shown boolean")
    got = {r.id: r.person for r in vectors.cluster_faces(df, 0.01, 3, may_be_core="shown").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, **{i: None for i in range(10, 14)}}


def _frame(spark, v):
    return spark.createDataFrame([(int(i), [float(y) for y in x]) for i, x in enumerate(v)], "id long, embedding array<double>")


def test_index_reaches_its_recall(spark):
    """Measured against the exact search, on data with clusters and without."""
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(3000, 10))
    for v, reach, most in ((clustered(rng, 3000), 0.5, 0.35), (plain / np.linalg.norm(plain, axis=1, keepdims=True), 0.35, 0.75)):
        df = _frame(spark, v)
        index = vectors.fit_cells(df, reach, 20)
        assert len(index.centres) == vectors.lists(3000) == 64 and index.recall >= 0.9
        d = 1 - v @ v.T
        np.fill_diagonal(d, 9)
        order = np.argsort(d, axis=1, kind="stable")[:, :20]
        want = {(i, int(j)) for i in range(len(v)) for j in order[i] if d[i, j] <= reach}
        got = {(r.id, r.other) for r in vectors.neighbours(df, reach, k=20, block=500, index=index).collect()}
        assert len(want & got) >= 0.88 * len(want)
        # an asker meets its probes' members: this share of all pairs
        home, asked = index.asked(v)
        sizes = np.bincount(home, minlength=64)
        assert (asked * sizes).sum() < most * len(v) ** 2


def test_work_of_the_index_grows_below_a_power(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(400, 16))
    work = []
    for n in (1000, 16_000):
        v = centres[rng.integers(0, n // 40, n)] + rng.normal(0, 0.1, (n, 16))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        index = vectors.fit_cells(_frame(spark, v), 0.1, 10)
        home, asked = index.asked(v)
        work.append((asked * np.bincount(home, minlength=len(index.centres))).sum())
        assert index.recall >= 0.9
    assert np.log(work[1] / work[0]) / np.log(16) < 1.5


def test_index_of_nothing(spark):
    empty = _frame(spark, np.zeros((0, 3)))
    index = vectors.fit_cells(empty, 0.5, 5)
    assert index.probes == 1 and vectors.neighbours(empty, 0.5, k=5, index=index).count() == 0
