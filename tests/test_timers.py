"""Settled files and debounced notices: against a fold over all events, over several batches, with nothing left behind."""

import datetime
import random

import duckdb

from photolake.plans import registry
from photolake.streaming import timers

EPOCH = datetime.datetime(2024, 1, 1)
FIRST = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp() * 1000)
SCHEMA = "at timestamp, lib long, path string, event string, size long"


def event(ms, lib, path, kind, size):
    return (EPOCH + datetime.timedelta(milliseconds=ms), lib, path, kind, size)


def stream(spark, tmp_path, build, batches):
    """Rows of all batches, one trigger each, and the last state of the operator."""
    folder = tmp_path / "in"
    folder.mkdir()
    source = spark.readStream.schema(SCHEMA).parquet(str(folder))
    rows = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        query = build(source).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).foreachBatch(lambda df, n: rows.extend(tuple(r) for r in df.collect())).start()
        query.awaitTermination()
    return rows, query.recentProgress[-1].stateOperators[0].numRowsTotal


def fold(events, gap, rearm, now):
    """What comes out of one key's events up to ``now``."""
    out, burst = [], None
    for ms, kind, size in sorted((e for e in events if e[0] <= now), key=lambda e: (e[0], e[1] == "unlink", e[2] or 0)):
        if burst and ms >= burst[1] + gap:
            out.append(("sync", burst[0], burst[1] + gap, burst[2], burst[3]))
            burst = None
        if kind == "unlink" and not rearm:
            burst = None
            out.append(("remove", ms, ms, size, 1))
        elif burst is None:
            burst = [ms, ms, size, 1]
        else:
            burst = [burst[0], ms if rearm or size != burst[2] else burst[1], size, burst[3] + 1]
    if burst and burst[1] + gap <= now:
        out.append(("sync", burst[0], burst[1] + gap, burst[2], burst[3]))
    return out


def test_a_file_settles_once(spark, tmp_path):
    growing = [event(1000 * s, 1, "a", "change", 10 * s) for s in range(8)]
    touched = [event(8000, 1, "a", "change", 70), event(11_000, 1, "a", "change", 70)]
    cancelled = [event(0, 1, "b", "add", 5), event(3000, 1, "b", "unlink", None)]
    other = [event(2000, 2, "a", "add", 1)]
    end = [event(100_000, 9, "z", "unlink", None), event(100_001, 9, "z", "unlink", None)]
    build = lambda s: timers.settled(s, "at", "lib", "path", late="0 seconds")
    rows, left = stream(spark, tmp_path, build, [growing[:4] + cancelled + other, growing[4:] + touched, end])
    rows = sorted((lib, path, action, start - FIRST, at - FIRST, size, n) for lib, path, action, start, at, size, n in rows)
    # the size is 70 from second 7 on; events that leave it so do not start the clock anew
    assert rows == [(1, "a", "sync", 0, 12_000, 70, 10), (1, "b", "remove", 3000, 3000, None, 1), (2, "a", "sync", 2000, 7000, 1, 1), (9, "z", "remove", 100_000, 100_000, None, 1), (9, "z", "remove", 100_001, 100_001, None, 1)]
    assert left == 0


def test_nothing_comes_while_a_file_changes(spark, tmp_path):
    build = lambda s: timers.settled(s, "at", "lib", "path", late="0 seconds")
    rows, _ = stream(spark, tmp_path, build, [[event(4000 * s, 1, "a", "change", s) for s in range(k, k + 3)] for k in (0, 3, 6)])
    assert rows == []


def batches_of(rng, n, late):
    """Events in batches whose order of arrival differs from that in time by less than ``late``."""
    events = [event(rng.randrange(200_000), rng.randrange(3), rng.choice("ab"), rng.choice(["add", "change", "change", "unlink"]), rng.randrange(3)) for _ in range(n)]
    events.sort(key=lambda e: e[0] + datetime.timedelta(milliseconds=rng.randrange(late)))
    return [events[i : i + n // 4 + 1] for i in range(0, n, n // 4 + 1)]


def check(spark, tmp_path, rearm, build, gap, late):
    batches = batches_of(random.Random(5), 160, late)
    end = [event(10_000_000, 8, "z", "change", 0)]
    rows, left = stream(spark, tmp_path, build, [*batches, end])
    now = 10_000_000 - late
    want = []
    for lib in range(3):
        for path in "ab":
            own = [(int((e[0] - EPOCH).total_seconds() * 1000 + 0.5), e[3], e[4]) for b in batches for e in b if (e[1], e[2]) == (lib, path)]
            want += [(lib, path, *r) for r in fold(own, gap, rearm, now)]
    return rows, want, left


def test_settled_equals_a_fold_whatever_the_batches(spark, tmp_path):
    build = lambda s: timers.settled(s, "at", "lib", "path", late="30 seconds")
    rows, want, left = check(spark, tmp_path, False, build, 5_000, 30_000)
    got = [(lib, path, action, start - FIRST, at - FIRST, size, n) for lib, path, action, start, at, size, n in rows]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 60
    # the last event alone waits: one row in the list, its timer
    assert left <= 4


def test_debounced_equals_a_fold(spark, tmp_path):
    build = lambda s: timers.debounced(s, "at", 3_000, "lib", "path", late="30 seconds")
    rows, want, _ = check(spark, tmp_path, True, build, 3_000, 30_000)
    got = [(lib, path, start - FIRST, sent - FIRST, n) for lib, path, start, sent, n in rows]
    assert sorted(got) == sorted((lib, path, start, at, n) for lib, path, _, start, at, _, n in want) and len(want) > 60


def to_the_digit(spark, name, folder):
    """Rows of a query and of its SQL, with all digits of whole numbers."""
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(folder)).select(*want.columns)
    return sorted(map(tuple, got.collect()), key=str), sorted(want.fetchall(), key=str)


def test_debounced_milliseconds_equal_the_sql(spark):
    got, want = to_the_digit(spark, "st_debounce", "/root/testdata/sf0.001")
    assert got == want and len(want) > 500


def test_milliseconds_are_the_nearest(spark, tmp_path):
    at = lambda us: (EPOCH + datetime.timedelta(microseconds=us), 1, "a", "change", 1)
    build = lambda s: timers.debounced(s, "at", 3_000, "lib", "path", late="0 seconds")
    # the second comes just 3,000 milliseconds after the first when both are rounded; the watermark is rounded as well
    rows, _ = stream(spark, tmp_path, build, [[at(499), at(2_999_500), at(5_999_499 + 500)]])
    assert [(start - FIRST, sent - FIRST, n) for _, _, start, sent, n in rows] == [(0, 3000, 1), (3000, 6000, 1)]


def test_settled_milliseconds_equal_the_sql(spark):
    got, want = to_the_digit(spark, "st_watch", "/root/testdata/sf0.001")
    assert got == want and len(want) > 500


def test_settled_null_and_negative_sizes_equal_the_sql(spark, tmp_path):
    rng = random.Random(3)
    # hours apart and often at one time, so that order and clock hang on the size
    rows = [(i, EPOCH + datetime.timedelta(hours=rng.randrange(400), microseconds=rng.choice((0, 499, 500))), rng.choice((1, 2, 3, None)), rng.choice(("a", "b", None)), rng.choice((None, -1.5, -0.5, 1.0, 2.0, 3.0))) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("part-*.parquet")).rename(tmp_path / "events.parquet")
    got, want = to_the_digit(spark, "st_watch", tmp_path)
    assert got == want and len(want) > 150
