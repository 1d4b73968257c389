"""Owner and library keys of reconciliation: each case fails if the key is left out."""

from photolake.operators import reconcile

ASSET = "id long, owner_id long, type string, visibility string, deleted_at string, live_photo_video_id long, checksum string, original_path string, library_id long, is_external boolean"


def assets(spark, *rows):
    base = dict(id=None, owner_id=1, type="IMAGE", visibility="timeline", deleted_at=None, live_photo_video_id=None, checksum=None, original_path=None, library_id=None, is_external=False)
    names = [f.split()[0] for f in ASSET.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], ASSET)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_live_photos_of_two_owners(spark):
    given = assets(spark, dict(id=1), dict(id=2, type="VIDEO"), dict(id=3, owner_id=2), dict(id=4, owner_id=2, type="VIDEO"), dict(id=5, owner_id=3), dict(id=6, type="VIDEO"), dict(id=7, owner_id=4), dict(id=8, owner_id=None), dict(id=9, owner_id=None, type="VIDEO"))
    exif = spark.createDataFrame([(i, "c") for i in (1, 2, 3, 4, 5, 6, 8, 9)] + [(7, None)], "asset_id long, live_photo_cid string")
    assert rows(reconcile.live_photos(given, exif)) == [(1, 1, 2), (2, 3, 4)]
    members = spark.createDataFrame([(10, 1), (10, 2), (11, 4), (11, 6)], "album_id long, asset_id long")
    linked = reconcile.link_live_photos(given, exif, members)
    assert rows(linked["assets"].where("id < 7"), "id", "visibility") == [(1, "timeline"), (2, "hidden"), (3, "timeline"), (4, "hidden"), (5, "timeline"), (6, "timeline")]
    assert rows(linked["assets"].where("live_photo_video_id IS NOT NULL"), "id", "live_photo_video_id") == [(1, 2), (3, 4)]
    assert rows(linked["album_assets"]) == [(10, 1), (11, 6)]
    assert linked["assets"].columns == given.columns and linked["assets"].count() == 9


def test_a_path_of_another_library_is_new(spark):
    held = assets(spark, dict(id=1, original_path="/a", library_id=7, is_external=True), dict(id=2, original_path="/b", library_id=7), dict(id=3, original_path="/c", is_external=True))
    listing = spark.createDataFrame([(7, "/a"), (8, "/a"), (7, "/b"), (7, "/c"), (7, "/d"), (7, "/d")], "library_id long, path string")
    assert rows(reconcile.new_paths(listing, held)) == [(7, "/b"), (7, "/c"), (7, "/d"), (8, "/a")]


def test_another_users_copy_is_no_backup(spark):
    remote = assets(spark, dict(id=1, owner_id=1, checksum="x"), dict(id=2, owner_id=2, checksum="y"), dict(id=3, owner_id=3, checksum="z"), dict(id=4, owner_id=1))
    local = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 1, "z"), (4, 1, None), (5, 2, "x")], "id long, owner_id long, checksum string")
    partners = spark.createDataFrame([(2, 1, True), (3, 1, False)], "shared_by long, shared_with long, in_timeline boolean")
    assert [r[0] for r in rows(reconcile.not_on_server(local, remote))] == [2, 3, 4, 5]
    assert [r[0] for r in rows(reconcile.not_on_server(local, remote, partners))] == [3, 4, 5]


def test_trash_of_one_owner(spark):
    remote = assets(spark, dict(id=1, owner_id=1, checksum="x", deleted_at="d"), dict(id=2, owner_id=2, checksum="y", deleted_at="d"), dict(id=3, owner_id=1, checksum="z"), dict(id=4, owner_id=2, checksum="w"))
    local = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 1, "z"), (4, 1, None)], "id long, owner_id long, checksum string")
    trashed = spark.createDataFrame([(11, 1, "z", 5, "remote_sync"), (12, 1, "z", 5, "local_user"), (13, 1, "z", 6, "remote_sync"), (14, 1, "w", 5, "remote_sync"), (15, 1, "x", 5, "remote_sync")], "id long, owner_id long, checksum string, album_id long, source string")
    albums = spark.createDataFrame([(5, 0), (6, 1), (7, 2)], "id long, backup_selection int")
    members = spark.createDataFrame([(5, 1), (5, 2), (5, 3), (6, 1), (5, 4), (5, 1)], "album_id long, asset_id long")
    found = reconcile.trash_sync(local, trashed, remote, albums, members)
    assert rows(found["to_trash"]) == [(5, [1])] and rows(found["to_restore"]) == [(5, [11])]


def test_access(spark):
    given = assets(
        spark, dict(id=1), dict(id=2, visibility="locked"), dict(id=3, owner_id=2, live_photo_video_id=30), dict(id=4, owner_id=2, deleted_at="d"), dict(id=5, owner_id=2, visibility="archive"),
        dict(id=6, owner_id=3, visibility="locked"), dict(id=7, owner_id=3, live_photo_video_id=70), dict(id=8, owner_id=4),
    )
    albums = spark.createDataFrame([(50, False), (51, True)], "id long, is_deleted boolean")
    album_users = spark.createDataFrame([(50, 1), (51, 1), (50, 9)], "album_id long, user_id long")
    members = spark.createDataFrame([(50, 3), (50, 4), (51, 8), (50, 3)], "album_id long, asset_id long")
    users = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True), (9, True)], "id long, is_deleted boolean")
    partners = spark.createDataFrame([(2, 3), (4, 3)], "shared_by long, shared_with long")
    links = spark.createDataFrame([(100, None), (101, 50), (102, 51)], "id long, album_id long")
    link_assets = spark.createDataFrame([(100, 7), (100, 4), (999, 1)], "link_id long, asset_id long")
    sessions = spark.createDataFrame([(3, True), (1, False)], "user_id long, elevated boolean")
    found = rows(reconcile.accessible(given, albums, album_users, members, users, partners, links, link_assets, sessions))
    assert found == sorted(
        [("user", 1, 1), ("user", 1, 3), ("user", 1, 30), ("user", 2, 3), ("user", 2, 4), ("user", 2, 5), ("user", 3, 3), ("user", 3, 6), ("user", 3, 7), ("user", 4, 8)]
        + [("link", 100, 7), ("link", 100, 70), ("link", 101, 3), ("link", 101, 30)]
    )


def test_cloud_hashes_need_every_stamp(spark):
    schema = "id long, cloud_id string, latitude double, longitude double, adjusted long, created long, checksum string"
    remote = spark.createDataFrame([(0, "c", 1.0, 2.0, None, 9, "sum"), (0, "c", 1.0, 2.0, None, 9, "tum"), (0, "d", None, None, None, None, "none"), (0, "e", 1.0, 2.0, 3, 4, None)], schema).drop("id")
    local = [(1, "c", 1.0, 2.0, None, 9, None), (2, "c", 1.0, 2.5, None, 9, None), (3, "c", 1.0, 2.0, 5, 9, None), (4, "c", 1.0, 2.0, None, 8, None), (5, "c", None, 2.0, None, 9, None), (6, "d", None, None, None, None, None), (7, "c", 1.0, 2.0, None, 9, "own"), (8, None, 1.0, 2.0, None, 9, None), (9, "e", 1.0, 2.0, 3, 4, None)]
    assert rows(reconcile.cloud_hashes(spark.createDataFrame(local, schema), remote)) == [(1, "sum"), (6, "none")]


def test_files_and_usage_of_deleted_assets(spark):
    from photolake.operators import tables

    held = assets(spark, dict(id=1, original_path="/1", library_id=None), dict(id=2, original_path="/2", library_id=5), dict(id=3, original_path="/3"), dict(id=4, owner_id=2, original_path="/4")).selectExpr("*", "id = 2 AS is_offline")
    files = spark.createDataFrame([(1, "preview", "/p1"), (1, "sidecar", "/s1"), (2, "sidecar", "/s2"), (2, "thumbnail", "/t2"), (3, "preview", "/p3")], "asset_id long, type string, path string")
    gone = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    # asset 2 is offline: its original and sidecar stay
    assert rows(tables.deleted_files(gone, held, files)) == [(1, "/1"), (1, "/p1"), (1, "/s1"), (2, "/t2"), (4, "/4")]
    assert rows(tables.deleted_files(gone, held, files, on_disk=False)) == [(1, "/p1"), (2, "/t2")]
    exif = spark.createDataFrame([(1, 100), (2, 200), (3, 400)], "asset_id long, file_size long")
    assert rows(tables.usage_freed(gone, held, exif)) == [(1, 100), (2, 0)]


def test_pages_of_stacks(spark):
    from pyspark.sql import functions as F

    from photolake.operators import timeline

    schema = "id long, owner_id long, stack_id long, visibility string, deleted_at string, status string, is_favorite boolean, width int, height int, thumbhash string, local_date_time timestamp_ntz, file_created_at timestamp_ntz"
    at = F.lit("2024-01-02").cast("timestamp_ntz")
    given = [(1, None, "timeline", None), (2, 9, "timeline", None), (3, 9, "timeline", None), (4, 9, "archive", None), (5, 9, "timeline", "d"), (6, 8, "archive", None), (7, 7, "timeline", None)]
    held = spark.createDataFrame([(i, 1, s, v, d, "active", i % 2 == 0, 4, 3, None) for i, s, v, d in given], schema.rsplit(", ", 2)[0]).withColumns({"local_date_time": at, "file_created_at": at})
    stacks = spark.createDataFrame([(9, 2), (8, 6), (7, 99)], "id long, primary_asset_id long")
    exif = spark.createDataFrame([], "asset_id long, city string, country string")
    page = timeline.bucket_page(timeline.stacked(timeline.timeline_assets(held), stacks, held), exif).first()
    assert page.id == [6, 2, 1] and page["stack"] == [None, ["9", "2"], None]
    assert rows(timeline.timeline_assets(held, is_favorite={"eq": True}).select("id")) == [(2,), (4,), (6,)]


def test_places_by_name_and_containers(spark):
    from photolake.operators import filters

    here = spark.createDataFrame([(1, "DE", "BY", "Ulm", 48.1, 11.6), (2, "DE", None, None, None, None), (3, "FR", "BY", "Ulm", 48.1, 11.6)], "id long, country string, state string, city string, latitude double, longitude double")
    found = lambda **o: [r[0] for r in rows(here.where(filters.located(**o)).select("id"))]
    assert found(country="DE") == [1, 2] and found(country="DE", state="BY") == [1] and found(city="Ulm") == [1, 3] and found() == [1, 2, 3]
    assert found(country="DE", latitude=48.0, longitude=11.6, radius_km=20) == [1] and found(latitude=40.0, longitude=11.6, radius_km=20) == []
    videos = spark.createDataFrame([(1, "mp4", None), (2, "mov,mp4", "QuickTime / MOV"), (3, "matroska,webm", "Matroska / WebM"), (4, "avi", "other"), (5, None, None)], "id long, format_name string, format_long_name string")
    remux = lambda *o: [r[0] for r in rows(videos.where(filters.remux_required(*o)).select("id"))]
    assert remux("optimal", ("mov",)) == [3, 4, 5] and remux("disabled", ()) == []
