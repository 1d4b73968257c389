"""Devices, libraries and uploads against the catalogue, each owner and library for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_photos(assets: DataFrame, exif: DataFrame) -> DataFrame:
    """``(owner_id, image_id, video_id)``: images and the video of the same owner with the same content id, the smallest id if several."""
    ids = exif.where("live_photo_cid IS NOT NULL").select(F.col("asset_id").alias("id"), "live_photo_cid")
    rows = assets.where("owner_id IS NOT NULL").select("id", "owner_id", "type").join(ids, "id")
    videos = rows.where("type = 'VIDEO'").groupBy("owner_id", "live_photo_cid").agg(F.min("id").alias("video_id"))
    return rows.where("type = 'IMAGE'").join(videos, ["owner_id", "live_photo_cid"]).select("owner_id", F.col("id").alias("image_id"), "video_id")


def link_live_photos(assets: DataFrame, exif: DataFrame, album_assets: DataFrame) -> dict[str, DataFrame]:
    """What linking does: ``assets`` with their video set and motion parts hidden, and ``album_assets`` without motion parts."""
    pairs = live_photos(assets, exif)
    shown = pairs.select(F.col("image_id").alias("id"), F.col("video_id").alias("_video"))
    motion = pairs.select(F.col("video_id").alias("id"), F.lit(True).alias("_motion")).distinct()
    linked = assets.join(shown, "id", "left").join(motion, "id", "left")
    linked = linked.withColumns({"live_photo_video_id": F.coalesce("_video", "live_photo_video_id"), "visibility": F.when(F.col("_motion"), "hidden").otherwise(F.col("visibility"))})
    return {"assets": linked.select(*assets.columns), "album_assets": album_assets.join(motion.select(F.col("id").alias("asset_id")), "asset_id", "left_anti").select(*album_assets.columns)}


def new_paths(listing: DataFrame, assets: DataFrame) -> DataFrame:
    """``(library_id, path)`` of a listing that are no external assets of that library; another library's do not count."""
    known = assets.where("is_external AND library_id IS NOT NULL").select("library_id", F.col("original_path").alias("path"))
    return listing.select("library_id", "path").distinct().join(known, ["library_id", "path"], "left_anti")


def not_on_server(local: DataFrame, remote: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """``local`` assets whose owner, or a partner in the owner's timeline, has no remote asset with their checksum; one without a checksum is not there."""
    held = remote.where("checksum IS NOT NULL AND owner_id IS NOT NULL").select("owner_id", "checksum")
    if partners is not None:
        shared = partners.where("in_timeline").select(F.col("shared_by").alias("owner_id"), "shared_with")
        held = held.unionByName(held.join(shared, "owner_id").select(F.col("shared_with").alias("owner_id"), "checksum"))
    return local.join(held, ["owner_id", "checksum"], "left_anti").select(*local.columns)


def cloud_hashes(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``(id, checksum)`` for local assets without a checksum: that of the remote asset with the same cloud id, the least of several.

    Both have cloud_id, latitude, longitude, adjusted and created; the last four must all
    be equal, a null to a null only, else the local file may have been changed since.
    """
    same = ("latitude", "longitude", "adjusted", "created")
    there = remote.where("checksum IS NOT NULL").select("cloud_id", *(F.col(c).alias(f"_{c}") for c in same), F.col("checksum").alias("_checksum"))
    rows = local.where("checksum IS NULL").drop("checksum").join(there, "cloud_id")
    for c in same:
        rows = rows.where(F.col(c).eqNullSafe(F.col(f"_{c}")))
    return rows.groupBy("id").agg(F.min("_checksum").alias("checksum"))


def trash_sync(local: DataFrame, trashed: DataFrame, remote: DataFrame, albums: DataFrame, album_assets: DataFrame) -> dict[str, DataFrame]:
    """What the device has to do after the server's trash changed, in selected albums only.

    ``to_trash``: (album_id, ids) of local assets whose owner's remote asset is deleted.
    ``to_restore``: (album_id, ids) of assets that were trashed for the server's sake and
    whose owner's remote asset is there again.
    """
    chosen = albums.where("backup_selection = 0").select(F.col("id").alias("album_id"))
    keyed = remote.where("checksum IS NOT NULL").select("owner_id", "checksum", F.col("deleted_at").isNotNull().alias("deleted"))
    by_album = lambda rows: rows.groupBy("album_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    members = album_assets.join(chosen, "album_id", "left_semi").select("album_id", F.col("asset_id").alias("id"))
    here = local.select("id", "owner_id", "checksum").join(keyed.where("deleted"), ["owner_id", "checksum"], "left_semi")
    back = trashed.where("source = 'remote_sync'").join(chosen, "album_id", "left_semi").join(keyed.where("NOT deleted"), ["owner_id", "checksum"], "left_semi")
    return {"to_trash": by_album(members.join(here, "id")), "to_restore": by_album(back.select("album_id", "id"))}


def accessible(assets: DataFrame, albums: DataFrame, album_users: DataFrame, album_assets: DataFrame, users: DataFrame, partners: DataFrame, links: DataFrame, link_assets: DataFrame, sessions: DataFrame) -> DataFrame:
    """``(kind, principal, id)``: assets that each user, and each shared link, may see.

    A user sees their own assets, locked ones only in an elevated session; assets of
    albums they are in, if not deleted; and those of partners who are still there, if not
    deleted and in the timeline or hidden. A link shows its assets and its album's, if not
    deleted. With an asset of an album or a link goes its motion part. ``sessions`` has
    user_id and elevated, one row a user at most; a user without a session is not elevated.
    """
    live, alive = assets.where("deleted_at IS NULL"), users.where("NOT is_deleted")
    of_album = albums.where("NOT is_deleted").select(F.col("id").alias("album_id")).join(album_assets, "album_id")
    who = lambda kind, column: (F.lit(kind).alias("kind"), F.col(column).alias("principal"))
    own = assets.join(sessions.select(F.col("user_id").alias("owner_id"), "elevated"), "owner_id", "left")
    own = own.where("visibility <> 'locked' OR coalesce(elevated, false)").select(*who("user", "owner_id"), "id")
    sharing = partners.join(alive.select(F.col("id").alias("shared_by")), "shared_by", "left_semi")
    seen = sharing.join(live.where("visibility IN ('timeline', 'hidden')").withColumnRenamed("owner_id", "shared_by"), "shared_by").select(*who("user", "shared_with"), "id")
    member = album_users.join(alive.select(F.col("id").alias("user_id")), "user_id", "left_semi").join(of_album, "album_id").select(*who("user", "user_id"), "asset_id")
    named = links.select(F.col("id").alias("link_id"), "album_id")
    linked = named.join(link_assets, "link_id").select("link_id", "asset_id").unionByName(named.join(of_album, "album_id").select("link_id", "asset_id")).select(*who("link", "link_id"), "asset_id")
    with_motion = live.select(F.col("id").alias("asset_id"), F.array_compact(F.array("id", "live_photo_video_id")).alias("ids"))
    given = member.unionByName(linked).join(with_motion, "asset_id").select("kind", "principal", F.explode("ids").alias("id"))
    return own.unionByName(seen).unionByName(given).distinct()
