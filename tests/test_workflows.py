"""Ordered steps: filters stop the rest, later steps see earlier changes, one workflow goes behind the other."""

import datetime

import pytest
from pyspark.sql import functions as F

from photolake.operators import workflows

ASSET = "id long, owner_id long, type string, visibility string, is_favorite boolean, original_file_name string, local_date_time timestamp_ntz, time_zone string, make string, iso int, f_number double, country string, state string, city string, latitude double, longitude double"
NEW_YEAR = datetime.datetime(2024, 1, 5)


def outcome(spark, *flows, trigger="AssetCreate", source=None, **asset):
    base = dict(id=1, owner_id=5, type="IMAGE", visibility="timeline", is_favorite=False, original_file_name="IMG_1.jpg", local_date_time=NEW_YEAR, time_zone="UTC+1", make="Canon", iso=100, f_number=2.0, country="DE", state="BY", city=None, latitude=48.0, longitude=11.0) | asset
    assets = spark.createDataFrame([tuple(base[f.split()[0]] for f in ASSET.split(", "))], ASSET)
    events = spark.createDataFrame([(9, 1, trigger, source)], "event_id long, asset_id long, trigger string, source string")
    rows = [spark.range(1).select(F.lit(k).alias("id"), F.lit(5).alias("owner_id"), F.lit("AssetCreate").alias("trigger"), F.lit(True).alias("enabled"), F.array(*steps).cast(workflows.STEPS).alias("steps")) for k, steps in enumerate(flows)]
    given = rows[0]
    for more in rows[1:]:
        given = given.unionByName(more)
    found = workflows.run(events, given, assets).collect()
    return found[0] if found else None


S = workflows.step


@pytest.mark.parametrize(
    "method,config,passes",
    [
        ("assetFileFilter", dict(value="img"), True), ("assetFileFilter", dict(value="img", case_sensitive=True), False), ("assetFileFilter", dict(value="IMG_1.jpg", match="exact"), True), ("assetFileFilter", dict(value="1", match="startsWith"), False),
        ("assetFileFilter", dict(value="^img_\\d", match="regex"), True), ("assetFileFilter", dict(value="x", match="other"), True),
        ("assetLocationFilter", dict(country="DE"), True), ("assetLocationFilter", dict(country="DE", city="Ulm"), False), ("assetLocationFilter", dict(latitude=48.1, longitude=11.0, radius_km=12.0), True), ("assetLocationFilter", dict(latitude=48.1, longitude=11.0), False), ("assetLocationFilter", dict(), True),
        ("assetExifFilter", dict(property="make", value="can"), True), ("assetExifFilter", dict(property="iso", value="100", match="exact"), True), ("assetExifFilter", dict(property="f_number", value="2", match="exact"), True), ("assetExifFilter", dict(property="city", value=""), False), ("assetExifFilter", dict(property="nothing", value=""), False),
        ("assetDateFilter", dict(start="2024-01-01", end="2024-01-05"), True), ("assetDateFilter", dict(start="2024-01-06", end="2024-02-05"), False), ("assetDateFilter", dict(start="1999-12-20", end="1999-01-06", recurring=True), True), ("assetDateFilter", dict(start="1999-02-01", end="1999-03-01", recurring=True), False),
        ("assetMissingTimeZoneFilter", dict(), False), ("assetMissingTimeZoneFilter", dict(inverse=True), True), ("assetTypeFilter", dict(types=["VIDEO", "IMAGE"]), True), ("assetTypeFilter", dict(types=["VIDEO"]), False), ("noopAnything", dict(), True),
    ],
)
def test_filters(spark, method, config, passes):
    assert outcome(spark, [S(method, **config), S("assetFavorite")]).is_favorite is passes


def test_later_steps_see_earlier_changes(spark):
    # unlocking gives the timeline only what is locked by then
    found = outcome(spark, [S("assetLock"), S("assetLock", inverse=True), S("assetFavorite")], visibility="archive")
    assert (found.visibility, found.is_favorite, found.changed) == ("timeline", True, True)
    assert outcome(spark, [S("assetArchive", inverse=True)], visibility="locked").visibility == "locked"
    assert outcome(spark, [S("assetArchive")], visibility="archive").changed is False
    assert outcome(spark, [S("assetFavorite", inverse=True)]).changed is False


def test_a_filter_ends_its_own_workflow_only(spark):
    found = outcome(spark, [S("assetFavorite"), S("assetTypeFilter", types=["VIDEO"]), S("assetLock")], [S("assetArchive")])
    assert (found.visibility, found.is_favorite) == ("archive", True)


def test_albums_and_requests(spark):
    found = outcome(spark, [S("assetAddToAlbums", album_ids=[3, 4]), S("assetAddToAlbums", album_name="Trips"), S("assetAddToAlbums"), S("webhook", url="u"), S("webhook", url="v", http_method="PUT")])
    assert [tuple(a) for a in found.albums] == [(3, None), (4, None), (None, "Trips")]
    assert [tuple(r) for r in found.requests] == [("u", "POST", 0), ("v", "PUT", 0)] and found.changed is False


def test_unknown_methods_fail_their_workflow(spark):
    found = outcome(spark, [S("assetFavorite"), S("assetDelete"), S("assetLock")], [S("assetArchive")])
    assert (found.is_favorite, found.visibility, found.failed) == (True, "archive", [0])


def test_what_starts_nothing(spark):
    steps = [S("assetFavorite")]
    assert outcome(spark, steps, trigger="AssetMetadataExtraction") is None
    assert outcome(spark, steps, source=workflows.OWN_WRITE) is None
    assert outcome(spark, steps, owner_id=6) is None and outcome(spark, steps, source="upload").is_favorite


def test_all_methods_are_known():
    assert len(workflows.METHODS) == len(set(workflows.METHODS)) == 12
    with pytest.raises(ValueError):
        S("assetLock", reverse=True)
