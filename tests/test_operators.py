"""Operators on small hand-made frames: golden cases, nulls, ties and brute force."""

import datetime
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.functions import scalar
from photolake.operators import filters, geo, groups, search, tables, timeline, vectors
from photolake.operators.graph import connected_components
from photolake.streaming import feeds, runner


def values(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def one(spark, expression, **columns):
    names = ", ".join(columns)
    del names
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))
    return df.select(expression.alias("x")).first()["x"]


def test_month_buckets(spark):
    df = spark.createDataFrame([(d,) for d in ("1970-01-01", "1970-02-10", "1970-02-11", "1970-02-11")], "d string").select(F.col("d").cast("timestamp").alias("local_date_time"))
    assert [(str(a), b) for a, b in values(timeline.time_buckets(df))] == [("1970-01-01", 1), ("1970-02-01", 3)]


def page_frames(spark, rows):
    shape = "id long, owner_id long, local string, taken string, is_favorite boolean, width int, height int, thumbhash string"
    assets = spark.createDataFrame(rows, shape).withColumn("local_date_time", F.col("local").cast("timestamp")).withColumn("file_created_at", F.col("taken").cast("timestamp"))
    return assets, spark.createDataFrame([], "asset_id long, city string, country string")


def test_page_orders_by_local_day_then_taken(spark):
    rows = [(1, 1, "2023-03-08 22:30:00", "2023-03-09 00:30:00", True, 4, 3, None), (2, 1, "2023-03-09 01:30:00", "2023-03-08 23:30:00", False, 0, 3, "ff"), (3, 1, "2023-03-09 01:45:00", "2023-03-08 23:45:00", False, None, 3, None)]
    page = timeline.bucket_page(*page_frames(spark, rows)).first()
    assert page["id"] == [3, 2, 1] and page["thumbhash"] == [None, "/w==", None]
    assert page["ratio"] == [1.0, 1.0, 1.333] and page["offset"] == [2.0, 2.0, -2.0] and page["city"] == [None] * 3
    parts = timeline.bucket_page(*page_frames(spark, rows), viewer=F.lit(9), most=2).orderBy("page").collect()
    assert [p["id"] for p in parts] == [[3, 2], [1]] and parts[1]["is_favorite"] == [False]
    assert timeline.bucket_page(*page_frames(spark, [])).count() == 0


GLOBS = {"**/Raw/**": "%/Raw/%", "**/abc/*.tif": "%/abc/%.tif", "**/*.jp?": "%/%.jp_", "**/@eaDir/**": "%/@eaDir/%", "/absolute/path/**": "/absolute/path/%", "a_b{}": r"a\_b"}


@pytest.mark.parametrize("glob,like", GLOBS.items())
def test_globs(glob, like):
    assert scalar.glob_to_like(glob) == like


def test_scalars(spark):
    assert one(spark, scalar.tokens(F.col("a")), a="ab 日本語 x日y") == ["ab", "日本", "本語", "x", "日", "y"]
    assert one(spark, scalar.unaccent(F.col("a")), a="Ärger ção Łódź") == "Arger cao Łodz"
    assert one(spark, scalar.stem(F.col("a")), a="DSC.01.ARW") == "dsc.01" and one(spark, scalar.stem(F.col("a")), a=".hidden") == ".hidden"
    assert one(spark, scalar.aspect_ratio(F.col("a"), F.col("b")), a=4000, b=3000) == 1.333
    assert one(spark, scalar.uuid7_ms(F.col("a")), a="018cc251-f400-7000-8000-000000000000") == 1704067200000
    assert one(spark, scalar.bits_per_sample(F.col("a")), a=24) == 8 and one(spark, scalar.rating(F.col("a")), a=0) is None
    assert one(spark, scalar.is_srgb(F.col("a"), F.col("b"), F.col("c")), a=None, b=None, c=16) is False


def test_bbox_wraps_the_antimeridian(spark):
    df = spark.createDataFrame([(1, 0.0, 179.0), (2, 0.0, -179.0), (3, 0.0, 0.0), (4, None, 179.0), (5, 80.0, 179.0)], "id long, latitude double, longitude double")
    assert values(df.where(filters.in_bbox(170, -10, -170, 10)).select("id")) == [(1,), (2,)]


def test_null_tests(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    assert values(df.where(filters.compare(F.col("x"), eq=None)).select("id")) == [(2,)]
    assert values(df.where(filters.compare(F.col("x"), ne="b")).select("id")) == [(1,)]
    assert values(df.where(filters.pattern(F.col("x"), not_like="q")).select("id")) == [(1,)]


def test_repeated_ids_of_an_all_filter_count_once(spark):
    df, bridge = spark.range(4), spark.createDataFrame([(0, 7), (0, 8), (0, 8), (1, 7)], "asset_id long, tag long")
    assert values(filters.with_ids(df, bridge, "tag", all_of=[7, 8, 8])) == [(0,)]
    assert values(filters.with_ids(df, bridge, "tag", none_of=[7])) == [(2,), (3,)]


def test_recurring_window_passes_new_year(spark):
    df = spark.createDataFrame([("2020-12-30",), ("2021-01-02",), ("2021-02-01",), ("2020-02-29",)], "d string").select(F.col("d").cast("date").alias("d"))
    assert df.where(filters.in_date_window(F.col("d"), "1999-12-24", "2000-01-06", True)).count() == 2
    assert df.where(filters.in_date_window(F.col("d"), "2020-02-28", "2020-02-29")).count() == 1


def test_leap_day_memories(spark):
    assets = spark.createDataFrame([(1, 1, "2020-02-29 10:00:00"), (2, 1, "2021-02-28 10:00:00")], "id long, owner_id long, t string").select("id", "owner_id", F.col("t").cast("timestamp").alias("local_date_time"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit("timeline").alias("visibility"))
    files = spark.createDataFrame([(1, "preview"), (2, "preview")], "asset_id long, type string")
    assert [r.id for r in timeline.on_this_day(assets, files, ["2024-02-29"]).collect()] == [1]


def test_archives_close_once_over_the_target(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 5, 1, 20, 1, None])] + [(2, 9, 3)], "owner_id long, id long, file_size long")
    assert [r[2] for r in values(timeline.split_archives(df, 10))] == [0, 0, 0, 1, 2, 2, 0]


def test_archives_of_small_blocks_equal_a_plain_walk(spark):
    rng = random.Random(4)
    for target in (0, 7, 40):
        rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, 0, 0, 1, 3, 9, 30])) for i in range(600)]
        df = spark.createDataFrame(rows, "owner_id long, id long, file_size long")
        want, state = {}, {}
        for owner, i, size in rows:
            used, archive = state.get(owner, (0, 0))
            used, archive = (0, archive + 1) if used > target else (used, archive)
            state[owner] = used + (size or 0), archive
            want[owner, i] = archive
        found = timeline.split_archives(df, target, block=12)
        assert {(r.owner_id, r.id): r.archive for r in found.collect()} == want
    assert timeline.split_archives(df.where("false"), 5).collect() == []


KEEP = [([1000, 5000, 3000], [1, 1, 1], 1), ([5, 5, 3], [1, 4, 9], 1), ([5, 5], [2, 2], 1), ([None, None], [0, 1], 1), ([7, None], [0, 9], 0)]


@pytest.mark.parametrize("sizes,fields,keep", KEEP)
def test_keep_hint(spark, sizes, fields, keep):
    df = spark.createDataFrame([(1, i, s, f, i) for i, (s, f) in enumerate(zip(sizes, fields))], "duplicate_id long, id long, file_size long, fields int, position long")
    assert values(groups.suggest_keep(df)) == [(1, keep)]


def test_pairs(spark):
    rows = [(1, 1, "A.JPG", "s"), (2, 1, "a.ARW", "s"), (3, 1, "b.jpg", "s"), (4, 1, "b.jpeg", "s"), (5, 1, "b.arw", "s"), (6, 1, "c.jpg", "s"), (7, 1, "d.jpg", None), (8, 1, "d.arw", None), (9, 1, "e.txt", "s")]
    found = groups.pair_jpg_raw(spark.createDataFrame(rows, "id long, owner_id long, name string, second string"))
    assert values(found.select("stem", "status", "reasons")) == [("a", "CANDIDATE", "RULES_MATCH"), ("b", "AMBIGUOUS", "DUPLICATE_JPG"), ("c", "REJECTED", "MISSING_RAW"), ("d", "UNVERIFIED", "TIME_UNVERIFIED")]


def test_locks(spark):
    df = spark.createDataFrame([(["a"],), (None,)], "x array<string>")
    assert sorted(map(str, (r[0] for r in df.select(tables.lock("x", ["b", "a"])).collect()))) == ["['a', 'b']", "['a', 'b']"]
    assert [r[0] for r in df.select(tables.unlock("x", ["a"])).collect()] == [None, None]


def test_camera_upserts_respect_locks(spark):
    base = spark.createDataFrame([(1, "old", 3, ["text"]), (2, "old", None, None)], "id long, text string, rating int, locked array<string>")
    delta = spark.createDataFrame([(1, "new", 5), (3, "new", 1)], "id long, text string, rating int")
    assert values(tables.upsert_camera(base, delta, "id", "skip")) == [(1, "old", 5, ["text"]), (2, "old", None, None), (3, "new", 1, None)]
    named = delta.withColumn("locked", F.array(F.lit("rating")))
    assert values(tables.upsert_camera(base, named, "id", "append"))[0] == (1, "new", 5, ["rating", "text"])
    assert values(tables.upsert_camera(base, delta, "id", "override"))[0] == (1, "new", 5, ["text"])


def test_upsert_keeps_or_takes(spark):
    base, delta = spark.createDataFrame([(1, "a", None), (2, "b", 2)], "id long, x string, y int"), spark.createDataFrame([(2, None, 9), (3, "c", 3)], "id long, x string, y int")
    assert values(tables.upsert(base, delta, ["id"])) == [(1, "a", None), (2, None, 9), (3, "c", 3)]
    assert values(tables.upsert(base, delta, ["id"], ["y"])) == [(1, "a", None), (2, "b", 9), (3, "c", 3)]
    assert values(tables.upsert(base, delta, ["id"], keep=True)) == [(1, "a", None), (2, "b", 2), (3, "c", 3)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3)]
    found = dict(values(connected_components(spark.createDataFrame(edges, "src long, dst long"))))
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 140)} == {100} and found[200] == 200
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_duplicate_groups_merge_whole(spark):
    assets = spark.createDataFrame([(1, 50), (2, 50), (3, 40), (4, None), (5, None), (6, 7)], "id long, duplicate_id long")
    pairs = spark.createDataFrame([(2, 3), (4, 5)], "src long, dst long")
    assert values(groups.assign_duplicates(pairs, assets)) == [(1, 40), (2, 40), (3, 40), (4, 4), (5, 4), (6, 7)]


@pytest.mark.parametrize("cells,block", [(1, 4096), (16, 40)])
def test_neighbours_equal_brute_force(spark, cells, block):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(900, 12))
    v[300:600] = v[:300] + rng.normal(scale=0.05, size=(300, 12))
    v[600:640] = v[0]
    v[899] = 0
    df = spark.createDataFrame([(int(i % 2), int(i), [float(x) for x in r]) for i, r in enumerate(v)], "owner_id long, id long, embedding array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    d = 1 - u @ u.T
    want = {(i, j) for i in range(900) for j in np.flatnonzero(d[i] <= 0.02) if i != j and i % 2 == j % 2}
    found = vectors.neighbours(df, 0.02, keys=("owner_id",), cells=cells, block=block)
    assert {(r.id, r.other) for r in found.collect()} == want
    best = {(r.id, r.other) for r in vectors.neighbours(df, 0.02, k=3, keys=("owner_id",), cells=cells, block=block).collect()}
    assert len({j for i, j in best if i == 0}) == 3 and best <= want


def test_faces_cluster_by_density(spark):
    points = [(0, 1.0, 0.0), (1, 0.99, 0.05), (2, 0.98, -0.05), (3, 0.9, 0.42), (4, -1.0, 0.0), (5, 0.0, 1.0)]
    df = spark.createDataFrame([(i, [x, y]) for i, x, y in points], "id long, embedding array<double>")
    assert dict(values(vectors.cluster_faces(df, 0.09, 3))) == {0: 0, 1: 0, 2: 0, 3: 0, 4: None, 5: None}


def test_geocode_equals_brute_force(spark):
    rng = random.Random(4)
    places = [(i, f"p{i}", None, "c", rng.choice([rng.uniform(-90, 90), 89.9, -89.9]), rng.choice([rng.uniform(-180, 180), 179.95, -179.95])) for i in range(400)]
    points = [(i, places[i][4] + rng.uniform(-0.3, 0.3), places[i][5] + rng.uniform(-0.3, 0.3)) for i in range(300)] + [(900, None, None)]
    a = spark.createDataFrame(points, "id long, latitude double, longitude double")
    b = spark.createDataFrame(places, "id long, name string, admin1_name string, country_code string, latitude double, longitude double")

    def xyz(lat, lon):
        lat, lon = np.radians(lat), np.radians(lon)
        return 6378168.0 * np.array([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])

    half, want = 2 * 6378168.0 * np.sin(25_000 / (2 * 6378168.0)), {}
    for i, lat, lon in points[:-1]:
        near = [(np.linalg.norm(xyz(lat, lon) - xyz(*p[4:])), p[0]) for p in places if (abs(xyz(lat, lon) - xyz(*p[4:])) <= half).all()]
        if near:
            want[i] = min(near)[1]
    assert {r.id: r.place_id for r in geo.reverse_geocode(a, b).collect()} == want


def test_polygons(spark):
    ring = [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (15.0, 10.0), (0.0, 30.0)]
    polygons = spark.createDataFrame([("A", ring)], "country string, ring array<struct<lon: double, lat: double>>")
    points = spark.createDataFrame([(1, 5.0, 15.0), (2, 25.0, 15.0), (3, 25.0, 29.0), (4, -1.0, 1.0), (5, None, None)], "id long, latitude double, longitude double")
    assert values(geo.countries(points, polygons)) == [(1, "A"), (3, "A")]


TAGS = [("a",), ("a/b",), ("a/b/c",), ("ab",), ("/x//y/",)]


def test_tag_prefixes(spark):
    found = values(groups.tag_paths(spark.createDataFrame(TAGS, "value string")))
    assert [f[0] for f in found] == ["a", "a/b", "a/b/c", "ab", "x", "x/y"] and found[1][1:] == ("b", "a")


def test_resolution_needs_one_to_keep(spark):
    shape = "duplicate_id long, id long, action string, is_favorite boolean, visibility string, rating int, description string, latitude double, longitude double, albums array<bigint>, tags array<bigint>"
    rows = [(1, 1, "keep", False, "timeline", None, "one\ntwo", 1.0, 2.0, [3], None), (1, 2, "trash", True, "archive", 4, "two\n three ", None, None, [1, 3], [9]), (2, 3, "keep", False, "hidden", 0, None, 1.0, 2.0, None, None)]
    got = {r.duplicate_id: r for r in groups.resolve(spark.createDataFrame(rows, shape)).collect()}
    assert (got[1].status, got[1].keeper, got[1].is_favorite, got[1].visibility, got[1].rating, got[1].description, got[1].latitude, got[1].albums, got[1].tags) == ("ok", 1, True, "archive", 4, "one\ntwo\nthree", 1.0, [1, 3], [9])
    assert (got[2].status, got[2].rating, got[2].visibility) == ("nothing to trash", None, "hidden")


def test_search_tree_with_branches(spark):
    df = spark.createDataFrame([(1, "IMAGE", 5), (2, "VIDEO", None), (3, "IMAGE", None)], "id long, type string, rating int")
    tree = {"type": {"ne": "OTHER"}, "or": [{"rating": {"gte": 4}}, {"rating": {"eq": None}, "type": {"eq": "VIDEO"}}]}
    assert values(df.where(search.condition(tree)).select("id")) == [(1,), (2,)]
    assert df.where(search.condition({})).count() == 3


def test_feed_is_bounded_on_both_sides(spark):
    rows = spark.createDataFrame([(i, 1, f"{i:03d}") for i in range(10)] + [(20, 2, "001")], "id long, owner_id long, update_id string")
    acks = spark.createDataFrame([(1, "T", "004")], "user_id long, type string, ack string")
    assert [r[3] for r in values(feeds.upserts(rows, acks, "008", "T"))] == [5, 6, 7, 20]


def test_feed_replays(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    feed = spark.createDataFrame([(1, "x", "1", False), (1, "y", "2", False), (2, None, "3", True), (3, "z", "4", False)], "id long, name string, update_id string, is_delete boolean")
    once = feeds.apply_feed(table, feed, "id")
    assert values(once) == [(1, "y"), (3, "z")] and values(feeds.apply_feed(once, feed, "id")) == values(once)


def test_child_deletions_only_while_the_parent_lives(spark):
    old, new = spark.createDataFrame([(1, 10), (2, 20)], "id long, parent long"), spark.createDataFrame([], "id long, parent long")
    parents = spark.createDataFrame([(20,)], "pid long")
    assert values(feeds.deletions(old, new, "id", (parents, "parent", "pid")).select("id")) == [(2,)]


def test_changed_tells_null_from_empty(spark):
    old, new = spark.createDataFrame([(1, None), (2, "a")], "id long, x string"), spark.createDataFrame([(1, ""), (2, "a"), (3, None)], "id long, x string")
    assert values(feeds.changed(old, new, "id")) == [(1,), (3,)]


def test_streams_resume_from_files(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:00", 1, 1.0), ("2024-01-01 00:03:00", 1, 2.0), ("2024-01-01 01:00:00", 1, 4.0)], "t string, user_id long, value double").select(F.col("t").cast("timestamp").alias("ts"), "user_id", "value").write.parquet(f"{tmp_path}/events.parquet")
    stream = runner.read_stream(spark, str(tmp_path), "events")
    days = runner.run(feeds.windows(stream, "ts", "1 day", None, "user_id"), ["start", "user_id"], "update").collect()
    assert [(r.n, r.value) for r in days] == [(3, 7.0)]
    assert runner.run(feeds.unique_uploads(stream, "ts", ["user_id"])).count() == 1


def test_acks_replace_each_other_and_deletes_are_acknowledged_apart(spark):
    from photolake.streaming import feeds

    store = spark.createDataFrame([(1, "AssetsV1", "05"), (2, "PeopleV1", "03")], "session_id long, type string, ack string")
    acks = spark.createDataFrame([(1, "AssetsV1|09", 1), (1, "AssetsV1|07|more", 2), (3, "StacksV1|01", 1), (2, "nothing", 5)], "session_id long, line string, at long")
    stored = feeds.ack_store(store, acks)
    assert {tuple(r) for r in stored.collect()} == {(1, "AssetsV1", "07|more"), (2, "PeopleV1", "03"), (3, "StacksV1", "01")}
    changes = spark.createDataFrame([(1, "AssetsV1", "04", 1, False), (1, "AssetsV1", "08", 2, False), (1, "AssetsV1", "04", 3, True), (1, "AssetEditsV1", "99", 4, False), (1, "Other", "01", 5, False), (2, "PeopleV1", "03", 6, False)], "user_id long, type string, update_id string, id long, is_delete boolean")
    assert [(r.position, r.id) for r in feeds.change_feed(changes, store, "50").orderBy("id").collect()] == [(4, 2), (4, 3)]
    assert len(feeds.REQUESTS) == 27


def test_dates_of_tags_and_zones(spark):
    from photolake.functions import scalar

    rows = [("2024:03:01 10:00:00", "Europe/Berlin"), ("2024:07:01 10:00:00.5", "Europe/Berlin"), ("2024:03:01 10:00:00Z", None), ("2024:03:01 10:00:00+02:00", None), ("2024:03:01 10:00:00-05:30", "UTC+1"), ("rubbish", "UTC+1"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, zone string")
    files = [F.lit(x).cast("timestamp_ntz") for x in ("2023-01-03", "2023-01-02", None)]
    got = df.select("i", scalar.taken_dates(F.col("raw"), F.col("zone"), *files).alias("d")).orderBy("i").select("d.zone", F.col("d.original").cast("string"), F.col("d.local").cast("string")).collect()
    assert [tuple(r) for r in got] == [
        ("Europe/Berlin", "2024-03-01 10:00:00", "2024-03-01 11:00:00"),
        ("Europe/Berlin", "2024-07-01 10:00:00", "2024-07-01 12:00:00"),
        ("UTC+0", "2024-03-01 10:00:00", "2024-03-01 10:00:00"),
        (None, "2024-03-01 08:00:00", "2024-03-01 08:00:00"),
        ("UTC+1", "2024-03-01 15:30:00", "2024-03-01 16:30:00"),
        ("UTC+1", "2023-01-02 00:00:00", "2023-01-02 00:00:00"),
        (None, "2023-01-02 00:00:00", "2023-01-02 00:00:00"),
    ]


def test_listing_below_a_hidden_folder(spark, tmp_path):
    from photolake.sources import files

    root = tmp_path / ".above" / "lib's"
    for name in ("a.jpg", "sub/b.JPG", ".hid/c.jpg", "sub/.d.jpg", "skip/e.tmp"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    for given in (str(root), f"file://{root}"):
        found = files.file_listing(spark, [given], ["**/*.TMP"])
        assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.jpg", "b.JPG"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from photolake.session import shared_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=sc))
