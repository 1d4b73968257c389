"""Updates within shares, over many ranges of ids and a hot album; backfill that resumes and completes."""

import random

import pytest

from photolake.streaming import scope


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("per_range", [10**6, 40])
def test_during_equals_all_pairs(spark, monkeypatch, per_range):
    monkeypatch.setattr(scope, "RANGE_ROWS", per_range)
    rng = random.Random(per_range)
    stamp = lambda: None if rng.random() < 0.03 else f"{rng.randrange(1000):04d}"
    # one album has most of the events
    events = [(i, 7 if rng.random() < 0.7 else rng.randrange(6), stamp()) for i in range(900)]
    spans = [(u, rng.choice([7, 7, 1, 2, 3]), stamp(), rng.choice([None, stamp()])) for u in range(60)]
    found = scope.during(spark.createDataFrame(events, "e long, album_id long, update_id string"), spark.createDataFrame(spans, "u long, album_id long, create_id string, delete_id string"), "album_id")
    want = sorted((e, u) for e, a, s in events for u, b, c, d in spans if a == b and s and c and s > c and (d is None or s < d))
    assert rows(found.select("e", "u")) == want and len(want) > 1000


def test_a_hot_album_is_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(scope, "RANGE_ROWS", 100)
    events = spark.createDataFrame([(7, f"{i:04d}") for i in range(2000)], "album_id long, update_id string")
    bounds = scope._bounds(events, "update_id")
    sizes = [r[1] for r in events.groupBy(scope._range(events["update_id"], bounds)).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 400


def test_updates_of_what_a_member_knows(spark):
    assets = spark.createDataFrame([(1, 10, "20", True), (2, 11, "25", True), (3, 10, "30", False)], "id long, owner_id long, update_id string, is_favorite boolean")
    given = spark.createDataFrame([(5, 1, "11"), (5, 2, "12"), (5, 3, "26"), (6, 1, "11")], "album_id long, asset_id long, update_id string")
    shares = [(5, 11, "10", None), (5, 12, "22", None), (5, 13, "10", "22"), (5, 14, "10", "15"), (5, 14, "24", None), (5, 15, "10", None), (5, 16, "10", None)]
    acks = [(11, "12", None), (12, "99", None), (13, "99", None), (14, "99", None), (15, None, None), (16, "99", "25")]
    found = scope.member_updates(assets, given, spark.createDataFrame(shares, "album_id long, user_id long, create_id string, delete_id string"), spark.createDataFrame(acks, "user_id long, members string, updates string"))
    assert rows(found) == [
        (11, 5, 1, "20", False), (11, 5, 2, "25", True),  # 3 has come in, but this member was not given it
        (12, 5, 2, "25", False), (12, 5, 3, "30", False),  # 1 was updated before the share
        (13, 5, 1, "20", False),  # the others were updated after it ended
        (14, 5, 2, "25", False), (14, 5, 3, "30", False),  # 1 was updated between two shares
        (16, 5, 3, "30", False),
    ]


def test_backfill_resumes_and_completes(spark):
    shares = spark.createDataFrame([(5, 1, "10"), (6, 1, "20"), (7, 1, "30"), (5, 2, "15"), (5, 3, "15"), (8, 4, "99"), (5, 5, "10"), (6, 5, "20")], "album_id long, user_id long, create_id string")
    history = spark.createDataFrame([(a, f"0{i}", 100 * a + i) for a in (5, 6, 7) for i in (1, 2, 3)] + [(5, "60", 9)], "album_id long, update_id string, asset_id long")
    acks = spark.createDataFrame([(1, "50", "20", "01"), (2, "02", None, None), (3, None, None, None), (4, "50", None, None), (5, "50", "20", "complete")], "user_id long, upto string, at string, resume string")
    found = scope.backfill(shares, history, acks, "90").select("user_id", "create_id", "update_id", "asset_id")
    assert sorted(map(str, rows_of(found))) == sorted(
        map(
            str,
            # share 10 is done, 20 goes on behind 01, 30 is new; member 2 has all up to 02; 3 has no feed yet; 4's share waits; 5 is done
            [(1, "20", "02", 602), (1, "20", "03", 603), (1, "20", "complete", None), (1, "30", "01", 701), (1, "30", "02", 702), (1, "30", "03", 703), (1, "30", "complete", None), (2, "15", "01", 501), (2, "15", "02", 502), (2, "15", "complete", None)],
        )
    )


def rows_of(df):
    return [tuple(r) for r in df.collect()]
