"""Queries that reconcile files, uploads and devices with the catalogue, and table mutations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions import scalar
from photolake.operators import groups, integrity, reconcile, tables
from photolake.plans.catalog import Catalog
from photolake.plans.registry import query
from photolake.session import shared_dir
from photolake.session import stored as kept
from photolake.sources import files
from photolake.streaming.sink import BucketTable


@query(
    "jn_new_paths",
    r"""SELECT DISTINCT b.id AS library_id, path FROM listing JOIN library b ON b.owner_id = CAST(regexp_extract(path, '^/data/([0-9]+)/', 1) AS BIGINT) WHERE regexp_matches(path, '^/data/[0-9]+/') AND NOT EXISTS (SELECT 1 FROM asset a WHERE a.original_path = path AND a.library_id = b.id AND a.is_external)""",
)
def jn_new_paths(c: Catalog) -> DataFrame:
    owner = F.regexp_extract("path", "^/data/([0-9]+)/", 1)
    listed = c.listing.where(owner != "").select("path", owner.cast("long").alias("owner_id")).join(c.library.select(F.col("id").alias("library_id"), "owner_id"), "owner_id")
    return reconcile.new_paths(listed, c.asset)


@query(
    "jn_upload_check",
    """WITH k AS (SELECT id AS candidate, owner_id, md5(CAST(CAST(floor(id / 4) AS BIGINT) AS STRING)) AS checksum FROM asset WHERE id % 3 = 0), a AS (SELECT owner_id, checksum, min(id) AS id, bool_and(deleted_at IS NOT NULL) AS trashed FROM asset WHERE checksum IS NOT NULL AND library_id IS NULL GROUP BY ALL)
SELECT candidate, CASE WHEN a.id IS NULL THEN 'accept' ELSE 'reject' END AS action, CASE WHEN a.id IS NOT NULL THEN 'duplicate' END AS reason, a.id AS asset_id, coalesce(trashed, false) AS trashed FROM k LEFT JOIN a ON a.owner_id = k.owner_id AND a.checksum = k.checksum""",
)
def jn_upload_check(c: Catalog) -> DataFrame:
    asked = c.asset.where("id % 3 = 0").select(F.col("id").alias("candidate"), "owner_id", F.md5(F.floor(F.col("id") / 4).cast("string").cast("binary")).alias("checksum"))
    known = c.asset.where("checksum IS NOT NULL AND library_id IS NULL").groupBy("owner_id", "checksum").agg(F.min("id").alias("asset_id"), F.bool_and(F.col("deleted_at").isNotNull()).alias("trashed"))
    rows = asked.join(known, ["owner_id", "checksum"], "left")
    hit = F.col("asset_id").isNotNull()
    return rows.select("candidate", F.when(hit, "reject").otherwise("accept").alias("action"), F.when(hit, "duplicate").alias("reason"), "asset_id", F.coalesce("trashed", F.lit(False)).alias("trashed"))


LOCAL = """sel AS (SELECT asset_id FROM local_album_asset JOIN local_album b ON b.id = album_id WHERE backup_selection = 0), exc AS (SELECT asset_id FROM local_album_asset JOIN local_album b ON b.id = album_id WHERE backup_selection = 2)"""


def selected(c: Catalog) -> DataFrame:
    """Local assets in a selected album and in no excluded one."""
    members = c.local_album_asset.join(c.local_album.withColumnRenamed("id", "album_id"), "album_id").select(F.col("asset_id").alias("id"), "backup_selection")
    return c.local_asset.join(members.where("backup_selection = 0"), "id", "left_semi").join(members.where("backup_selection = 2"), "id", "left_anti")


MERGED = f"""WITH {LOCAL}, merged AS (SELECT 'remote' AS side, a.id, CAST(a.local_date_time AS DATE) AS day FROM asset a LEFT JOIN stack s ON s.id = a.stack_id WHERE a.deleted_at IS NULL AND visibility = 'timeline' AND (a.stack_id IS NULL OR s.primary_asset_id = a.id)
UNION ALL SELECT 'local', l.id, CAST(l.created_at AS DATE) FROM local_asset l WHERE l.id IN (SELECT asset_id FROM sel) AND l.id NOT IN (SELECT asset_id FROM exc) AND NOT EXISTS (SELECT 1 FROM asset a WHERE a.checksum = l.checksum AND (a.owner_id = l.owner_id OR a.owner_id IN (SELECT shared_by FROM partner WHERE shared_with = l.owner_id AND in_timeline)))) """


def merged(c: Catalog) -> DataFrame:
    """The server's timeline (leading assets of stacks) and local assets that it lacks for their owner."""
    remote = groups.with_stack_size(c.asset, c.stack).where("deleted_at IS NULL AND visibility = 'timeline' AND (stack_id IS NULL OR lead = id)").select(F.lit("remote").alias("side"), "id", F.col("local_date_time").cast("date").alias("day"))
    local = reconcile.not_on_server(selected(c), c.asset, c.partner).select(F.lit("local").alias("side"), "id", F.col("created_at").cast("date").alias("day"))
    return remote.unionByName(local)


@query("jn_merge_local", MERGED + "SELECT side, id, day FROM merged")
def jn_merge_local(c: Catalog) -> DataFrame:
    return merged(c)


@query("agg_merged_buckets", MERGED + "SELECT strftime(day, '%Y-%m') AS bucket, count(*) AS count, count_if(side = 'local') AS local FROM merged GROUP BY ALL")
def agg_merged_buckets(c: Catalog) -> DataFrame:
    return merged(c).groupBy(F.date_format("day", "yyyy-MM").alias("bucket")).agg(F.count("*").alias("count"), F.count_if(F.col("side") == "local").alias("local"))


@query("jn_backup", f"WITH {LOCAL} SELECT owner_id, count(*) AS total, count_if(checksum IS NULL OR NOT EXISTS (SELECT 1 FROM asset a WHERE a.checksum = l.checksum AND a.owner_id = l.owner_id)) AS remainder, count_if(checksum IS NULL) AS processing FROM local_asset l WHERE id IN (SELECT asset_id FROM sel) AND id NOT IN (SELECT asset_id FROM exc) GROUP BY ALL")
def jn_backup(c: Catalog) -> DataFrame:
    mine = selected(c)
    rows = mine.join(reconcile.not_on_server(mine, c.asset).select("id", F.lit(True).alias("lacking")), "id", "left")
    return rows.groupBy("owner_id").agg(F.count("*").alias("total"), F.count_if("lacking").alias("remainder"), F.count_if(F.col("checksum").isNull()).alias("processing"))


@query("jn_link_diff", "SELECT DISTINCT x.album_id, a.id AS asset_id FROM local_album_asset x JOIN local_asset l ON l.id = x.asset_id JOIN asset a ON a.checksum = l.checksum WHERE a.deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM album_asset r WHERE r.album_id = x.album_id AND r.asset_id = a.id)")
def jn_link_diff(c: Catalog) -> DataFrame:
    rows = c.local_album_asset.join(c.local_asset.select(F.col("id").alias("asset_id"), "checksum"), "asset_id").select("album_id", "checksum")
    rows = rows.join(c.asset.where("deleted_at IS NULL").select("checksum", F.col("id").alias("asset_id")), "checksum").select("album_id", "asset_id").distinct()
    return rows.join(c.album_asset, ["album_id", "asset_id"], "left_anti")


LIVE = "WITH x AS (SELECT a.id, owner_id, type, live_photo_cid FROM asset a JOIN exif ON asset_id = a.id WHERE live_photo_cid IS NOT NULL), p AS (SELECT i.owner_id, i.id AS image_id, min(v.id) AS video_id FROM x i JOIN x v ON v.owner_id = i.owner_id AND v.live_photo_cid = i.live_photo_cid AND v.type = 'VIDEO' WHERE i.type = 'IMAGE' GROUP BY ALL) "


@query("jn_live_photo", LIVE + "SELECT owner_id, image_id, video_id FROM p")
def jn_live_photo(c: Catalog) -> DataFrame:
    return reconcile.live_photos(c.asset, c.exif)


@query("jn_live_photo_link", LIVE + ", m AS (SELECT DISTINCT video_id FROM p) SELECT a.id, coalesce(p.video_id, a.live_photo_video_id) AS live_photo_video_id, CASE WHEN m.video_id IS NULL THEN visibility ELSE 'hidden' END AS visibility, (SELECT count(*) FROM album_asset x WHERE x.asset_id = a.id AND m.video_id IS NULL) AS albums FROM asset a LEFT JOIN p ON p.image_id = a.id LEFT JOIN m ON m.video_id = a.id")
def jn_live_photo_link(c: Catalog) -> DataFrame:
    linked = reconcile.link_live_photos(c.asset, c.exif, c.album_asset)
    albums = linked["album_assets"].groupBy(F.col("asset_id").alias("id")).agg(F.count("*").alias("albums"))
    return linked["assets"].join(albums, "id", "left").select("id", "live_photo_video_id", "visibility", F.coalesce("albums", F.lit(0)).alias("albums"))


CLOUD = "CASE WHEN id % 3 <> 0 THEN CAST(id % 90 AS DOUBLE) END AS latitude, CASE WHEN id % 7 <> 0 THEN CAST(id % 170 AS DOUBLE) END AS longitude, CASE WHEN id % 5 <> 0 THEN id % 7 END AS adjusted"


@query(
    "jn_cloud_hash",
    f"""WITH r AS (SELECT CAST(CAST(floor(id / 2) AS BIGINT) AS STRING) AS cloud_id, {CLOUD}, id % 8 AS created, checksum FROM asset WHERE checksum IS NOT NULL AND id % 2 = 1),
l AS (SELECT id, cloud_id, {CLOUD}, CASE WHEN id % 10 = 3 THEN id % 8 + 1 ELSE id % 8 END AS created FROM local_asset WHERE cloud_id IS NOT NULL AND id % 4 <> 1)
SELECT l.id, min(r.checksum) AS checksum FROM l JOIN r ON l.cloud_id = r.cloud_id AND l.latitude IS NOT DISTINCT FROM r.latitude AND l.longitude IS NOT DISTINCT FROM r.longitude AND l.adjusted IS NOT DISTINCT FROM r.adjusted AND l.created IS NOT DISTINCT FROM r.created GROUP BY ALL""",
)
def jn_cloud_hash(c: Catalog) -> DataFrame:
    cloud = [F.expr(x) for x in ("CASE WHEN id % 3 <> 0 THEN CAST(id % 90 AS DOUBLE) END AS latitude", "CASE WHEN id % 7 <> 0 THEN CAST(id % 170 AS DOUBLE) END AS longitude", "CASE WHEN id % 5 <> 0 THEN id % 7 END AS adjusted")]
    remote = c.asset.where("checksum IS NOT NULL AND id % 2 = 1").select(F.floor(F.col("id") / 2).cast("string").alias("cloud_id"), *cloud, (F.col("id") % 8).alias("created"), "checksum")
    moved = F.when(F.col("id") % 10 == 3, F.col("id") % 8 + 1).otherwise(F.col("id") % 8)
    return reconcile.cloud_hashes(c.local_asset.where("cloud_id IS NOT NULL AND id % 4 <> 1").select("id", "cloud_id", *cloud, moved.alias("created"), F.lit(None).cast("string").alias("checksum")), remote)


@query(
    "jn_removal",
    """SELECT l.type, count(*) AS n, CAST(sum(l.size) AS BIGINT) AS bytes FROM local_asset l WHERE l.created_at < TIMESTAMP '2000-06-01' AND NOT l.is_favorite AND l.checksum IN (SELECT checksum FROM asset WHERE deleted_at IS NULL AND checksum IS NOT NULL)
AND l.checksum NOT IN (SELECT checksum FROM asset WHERE is_favorite AND deleted_at IS NULL AND checksum IS NOT NULL) AND l.id NOT IN (SELECT asset_id FROM local_album_asset JOIN local_album b ON b.id = album_id WHERE is_shared) GROUP BY ALL""",
)
def jn_removal(c: Catalog) -> DataFrame:
    live = c.asset.where("deleted_at IS NULL AND checksum IS NOT NULL")
    kept = c.local_album_asset.join(c.local_album.where("is_shared").select(F.col("id").alias("album_id")), "album_id", "left_semi").select(F.col("asset_id").alias("id"))
    rows = c.local_asset.where("NOT is_favorite").where(F.col("created_at") < F.lit("2000-06-01").cast("timestamp_ntz"))
    rows = rows.join(live.select("checksum"), "checksum", "left_semi").join(live.where("is_favorite").select("checksum"), "checksum", "left_anti").join(kept, "id", "left_anti")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(
    "jn_trash_sync",
    """WITH chosen AS (SELECT id FROM local_album WHERE backup_selection = 0)
SELECT 'trash' AS side, x.album_id, string_agg(DISTINCT CAST(l.id AS STRING), ',' ORDER BY CAST(l.id AS STRING)) AS ids FROM local_album_asset x JOIN chosen ON chosen.id = x.album_id JOIN local_asset l ON l.id = x.asset_id JOIN asset a ON a.checksum = l.checksum AND a.owner_id = l.owner_id WHERE a.deleted_at IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'restore', t.album_id, string_agg(DISTINCT CAST(t.id AS STRING), ',' ORDER BY CAST(t.id AS STRING)) FROM trashed_local t JOIN chosen ON chosen.id = t.album_id JOIN asset a ON a.checksum = t.checksum AND a.owner_id = t.owner_id WHERE source = 'remote_sync' AND a.deleted_at IS NULL GROUP BY ALL""",
)
def jn_trash_sync(c: Catalog) -> DataFrame:
    found = reconcile.trash_sync(c.local_asset, c.trashed_local, c.asset, c.local_album, c.local_album_asset)
    ids = F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ",").alias("ids")
    return found["to_trash"].select(F.lit("trash").alias("side"), "album_id", ids).unionByName(found["to_restore"].select(F.lit("restore").alias("side"), "album_id", ids))


@query("jn_backup_albums", "SELECT b.name AS album, string_agg(CAST(a.id AS STRING), ',' ORDER BY CAST(a.id AS STRING)) AS ids FROM local_album b JOIN local_album_asset x ON x.album_id = b.id JOIN local_asset l ON l.id = x.asset_id JOIN asset a ON a.checksum = l.checksum WHERE backup_selection = 0 GROUP BY ALL")
def jn_backup_albums(c: Catalog) -> DataFrame:
    rows = c.local_album.where("backup_selection = 0").select(F.col("id").alias("album_id"), F.col("name").alias("album")).join(c.local_album_asset, "album_id")
    rows = rows.join(c.local_asset.select(F.col("id").alias("asset_id"), "checksum"), "asset_id").join(c.asset.select("checksum", "id"), "checksum")
    return rows.groupBy("album").agg(F.array_join(F.sort_array(F.collect_list(F.col("id").cast("string"))), ",").alias("ids"))


@query(
    "jn_sidecar",
    """WITH cand AS (SELECT id, 0 AS rank, path FROM (SELECT asset_id AS id, path FROM asset_file WHERE type = 'sidecar') UNION ALL SELECT id, 1, original_path || '.xmp' FROM asset UNION ALL SELECT id, 2, regexp_replace(original_path, '\\.[^./]*$', '') || '.xmp' FROM asset),
disk AS (SELECT path FROM listing UNION SELECT original_path || '.xmp' FROM asset WHERE id % 10 = 3 UNION SELECT regexp_replace(original_path, '\\.[^./]*$', '') || '.xmp' FROM asset WHERE id % 10 IN (3, 5))
SELECT id, min_by(path, rank) AS path FROM cand WHERE path IN (SELECT path FROM disk) GROUP BY ALL""",
)
def jn_sidecar(c: Catalog) -> DataFrame:
    bare = F.regexp_replace("original_path", r"\.[^./]*$", "")
    disk = c.listing.select("path").unionByName(c.asset.where("id % 10 = 3").select(F.concat("original_path", F.lit(".xmp")).alias("path"))).unionByName(c.asset.where("id % 10 IN (3, 5)").select(F.concat(bare, F.lit(".xmp")).alias("path"))).distinct()
    known = c.asset_file.where("type = 'sidecar'").select(F.col("asset_id").alias("id"), F.lit(0).alias("rank"), "path")
    tries = c.asset.select("id", F.posexplode(F.array(F.concat("original_path", F.lit(".xmp")), F.concat(bare, F.lit(".xmp")))).alias("rank", "path")).withColumn("rank", F.col("rank") + 1)
    return known.unionByName(tries).join(disk, "path", "left_semi").groupBy("id").agg(F.min_by("path", "rank").alias("path"))


@query("jn_folder_albums", "WITH f AS (SELECT owner_id, id, regexp_extract(original_path, '([^/]*)/[^/]*$', 1) AS album FROM asset) SELECT owner_id, album, count(*) AS assets, album NOT IN (SELECT name FROM album) AS is_new FROM f GROUP BY ALL")
def jn_folder_albums(c: Catalog) -> DataFrame:
    rows = c.asset.groupBy("owner_id", F.regexp_extract("original_path", "([^/]*)/[^/]*$", 1).alias("album")).agg(F.count("*").alias("assets"))
    known = c.album.select(F.col("name").alias("album"), F.lit(True).alias("known")).distinct()
    return rows.join(known, "album", "left").select("owner_id", "album", "assets", F.col("known").isNull().alias("is_new"))


def untracked(c: Catalog) -> DataFrame:
    known = c.asset.select(F.col("original_path").alias("path")).unionByName(c.asset_file.select("path"))
    return c.listing.select("path").distinct().join(known, "path", "left_anti")


@query("jn_untracked", "SELECT DISTINCT path FROM listing WHERE path NOT IN (SELECT original_path FROM asset) AND path NOT IN (SELECT path FROM asset_file)")
def jn_untracked(c: Catalog) -> DataFrame:
    return untracked(c)


PATHS = "paths AS (SELECT original_path AS path, id AS asset_id, CAST(NULL AS BIGINT) AS file_id FROM asset WHERE NOT is_external UNION ALL SELECT path, asset_id, id FROM asset_file)"


def all_paths(c: Catalog) -> DataFrame:
    return c.asset.where("NOT is_external").select(F.col("original_path").alias("path"), F.col("id").alias("asset_id"), F.lit(None).cast("long").alias("file_id")).unionByName(c.asset_file.select("path", "asset_id", F.col("id").alias("file_id")))


@query("set_paths", f"WITH {PATHS} SELECT path, asset_id, file_id FROM paths")
def set_paths(c: Catalog) -> DataFrame:
    return all_paths(c)


@query("jn_missing", f"WITH {PATHS} SELECT path, asset_id, file_id FROM paths WHERE path NOT IN (SELECT path FROM listing)")
def jn_missing(c: Catalog) -> DataFrame:
    return all_paths(c).join(c.listing.select("path"), "path", "left_anti").select("path", "asset_id", "file_id")


@query(
    "jn_checksum",
    """SELECT page_id AS id, CASE WHEN page_id % 29 = 4 THEN 'missing' WHEN page_id % 40 = 11 THEN 'mismatch' ELSE 'ok' END AS outcome FROM pages WHERE page_id % 6 <> 0 AND page_id % 31 <> 5""",
)
def jn_checksum(c: Catalog) -> DataFrame:
    # web pages as files, dealt to 256 folders by a hash; recorded digests, of which some are of other bytes
    root = f"{shared_dir(c.spark)}/stored-{uuid.uuid4().hex}"
    k = F.col("page_id")
    stored = F.concat(F.coalesce("html", F.lit("")), F.lit("\n"))
    name = F.concat_ws("/", F.pmod(F.xxhash64(k), F.lit(256)).cast("string"), F.concat(k.cast("string"), F.lit(".html")))
    files.write_files(c.pages.where((k % 29 != 4) & k.isNotNull()).select(name.alias("name"), stored.cast("binary").alias("content")), root)
    # a listing asks each file, so it is kept
    listing = kept(files.file_listing(c.spark, [root]), "listing").withColumn("page", F.regexp_extract("path", r"/(-?\d+)\.html$", 1).cast("long"))
    recorded = F.when(k % 31 != 5, F.when(k % 40 == 11, F.sha1(F.concat(F.lit("other "), stored).cast("binary"))).otherwise(F.upper(F.sha1(stored.cast("binary")))))
    rows = c.pages.where(k.isNotNull()).join(listing.select("page", "path"), k == F.col("page"), "left")
    path = F.coalesce("path", F.concat(F.lit(f"{root}/"), name))
    assets = rows.select(k.alias("id"), path.alias("path"), recorded.alias("checksum"), F.timestamp_add("HOUR", k.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"), (k % 6 == 0).alias("is_external"))
    return integrity.checksum_scan(assets, listing).select("id", "outcome")


@query("jn_report_refresh", "SELECT id FROM report WHERE (type = 'missing_file' AND path IN (SELECT path FROM listing)) OR (type = 'untracked_file' AND (path NOT IN (SELECT path FROM listing) OR path IN (SELECT path FROM asset_file)))")
def jn_report_refresh(c: Catalog) -> DataFrame:
    disk, known = c.listing.select("path", F.lit(True).alias("on_disk")).distinct(), c.asset_file.select("path", F.lit(True).alias("known")).distinct()
    rows = c.report.join(disk, "path", "left").join(known, "path", "left")
    return rows.where("(type = 'missing_file' AND on_disk) OR (type = 'untracked_file' AND (on_disk IS NULL OR known))").select("id")


@query(
    "jn_library_state",
    "SELECT a.id, CASE WHEN l.path IS NULL THEN CASE WHEN is_offline THEN 'nothing' ELSE 'offline' END WHEN is_offline AND a.deleted_at IS NOT NULL THEN 'check_offline' WHEN l.modified_at IS DISTINCT FROM a.file_modified_at + to_seconds(CASE WHEN a.id % 12 = 0 THEN 5 ELSE 0 END) THEN 'update' ELSE 'nothing' END AS state FROM asset a LEFT JOIN (SELECT path, min(modified_at) AS modified_at FROM listing GROUP BY ALL) l ON l.path = a.original_path WHERE is_external",
)
def jn_library_state(c: Catalog) -> DataFrame:
    disk = c.listing.groupBy("path").agg(F.min("modified_at").alias("modified_at"), F.lit(True).alias("on_disk"))
    rows = c.asset.where("is_external").withColumn("path", F.col("original_path")).join(disk, "path", "left")
    seen = F.expr("timestampadd(SECOND, CASE WHEN id % 12 = 0 THEN 5 ELSE 0 END, file_modified_at)")
    state = F.when(F.col("on_disk").isNull(), F.when(F.col("is_offline"), "nothing").otherwise("offline")).when(F.col("is_offline") & F.col("deleted_at").isNotNull(), "check_offline").when(~F.col("modified_at").eqNullSafe(seen), "update").otherwise("nothing")
    return rows.select("id", state.alias("state"))


@query(
    "src_import",
    """SELECT path, sha1('path:' || path) AS checksum, CASE WHEN ends_with(lower(path), '.mp4') THEN 'VIDEO' WHEN regexp_matches(lower(path), '\\.(jpg|raw|webp)$') THEN 'IMAGE' ELSE 'OTHER' END AS type, true AS is_external, regexp_replace(path, '^.*/', '') AS original_file_name FROM listing""",
)
def src_import(c: Catalog) -> DataFrame:
    low = F.lower("path")
    kind = F.when(low.endswith(".mp4"), "VIDEO").when(low.rlike(r"\.(jpg|raw|webp)$"), "IMAGE").otherwise("OTHER")
    return c.listing.select("path", F.sha1(F.concat(F.lit("path:"), "path").cast("binary")).alias("checksum"), kind.alias("type"), F.lit(True).alias("is_external"), scalar.base_name(F.col("path")).alias("original_file_name"))


@query("snk_upsert", "SELECT id, coalesce(d.name, b.name) AS name, CASE WHEN d.id IS NOT NULL AND b.id IS NOT NULL THEN b.owner_id ELSE coalesce(d.owner_id, b.owner_id) END AS owner_id FROM (SELECT id, name, owner_id FROM person) b FULL JOIN (SELECT id * 2 AS id, 'P' || id AS name, 999 AS owner_id FROM person) d USING (id)")
def snk_upsert(c: Catalog) -> DataFrame:
    delta = c.person.select((F.col("id") * 2).alias("id"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"), F.lit(999).cast("long").alias("owner_id"))
    held = BucketTable(c.spark, f"{shared_dir(c.spark)}/upsert-{uuid.uuid4().hex}", "id long, name string, owner_id long", ("id",), buckets=8)
    held.merge(c.person.select("id", "name", "owner_id"), 0)
    held.merge(delta, 1, columns=["name"])
    return held.read()


@query("mut_av", "SELECT id, coalesce(b.name, d.name) AS name FROM (SELECT id, name FROM person) b FULL JOIN (SELECT id * 2 AS id, 'P' || id AS name FROM person) d USING (id)")
def mut_av(c: Catalog) -> DataFrame:
    delta = c.person.select((F.col("id") * 2).alias("id"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"))
    return tables.upsert(c.person.select("id", "name"), delta, ["id"], keep=True)


@query(
    "mut_exif",
    """SELECT asset_id, CASE WHEN asset_id % 3 = 0 AND asset_id % 4 <> 0 THEN 'new' ELSE description END AS description, CASE WHEN asset_id % 3 = 0 THEN 5 ELSE rating END AS rating FROM exif""",
)
def mut_exif(c: Catalog) -> DataFrame:
    base = c.exif.select("asset_id", "description", "rating", F.when(F.col("asset_id") % 4 == 0, F.array(F.lit("description"))).alias("locked"))
    delta = c.exif.where("asset_id % 3 = 0").select("asset_id", F.lit("new").alias("description"), F.lit(5).alias("rating"))
    return tables.upsert_camera(base, delta, "asset_id", "skip").drop("locked")


@query("set_locked", "SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 'description,rating' ELSE 'rating' END AS locked, CASE WHEN asset_id % 2 = 1 AND asset_id % 4 <> 0 THEN 'latitude' END AS unlocked FROM exif")
def set_locked(c: Catalog) -> DataFrame:
    rows = c.exif.select("asset_id", F.when(F.col("asset_id") % 4 == 0, F.array(F.lit("description"))).alias("a"), F.when(F.col("asset_id") % 2 == 1, F.array(F.lit("description"), F.lit("latitude"))).otherwise(F.array(F.lit("description"))).alias("b"))
    return rows.select("asset_id", F.array_join(tables.lock("a", ["rating"]), ",").alias("locked"), F.array_join(tables.unlock("b", ["description"]), ",").alias("unlocked"))


@query("set_copy", "SELECT DISTINCT album_id, asset_id FROM (SELECT album_id, asset_id FROM album_asset UNION ALL SELECT album_id, asset_id + 1 FROM album_asset WHERE asset_id % 100 = 0)")
def set_copy(c: Catalog) -> DataFrame:
    more = c.album_asset.where("asset_id % 100 = 0").select("album_id", (F.col("asset_id") + 1).alias("asset_id"))
    return c.album_asset.unionByName(more).distinct()


@query("mut_trash", "SELECT id, CASE WHEN status = 'trashed' AND id % 2 = 0 THEN 'active' WHEN status = 'trashed' THEN 'deleted' ELSE status END AS status, deleted_at <= TIMESTAMP '1999-01-01' - INTERVAL 30 DAY AS purge FROM asset WHERE deleted_at IS NOT NULL")
def mut_trash(c: Catalog) -> DataFrame:
    trashed = F.col("status") == "trashed"
    status = F.when(trashed & (F.col("id") % 2 == 0), "active").when(trashed, "deleted").otherwise(F.col("status"))
    limit = F.expr("timestampadd(DAY, -30, CAST('1999-01-01' AS TIMESTAMP_NTZ))")
    return c.asset.where("deleted_at IS NOT NULL").select("id", status.alias("status"), (F.col("deleted_at") <= limit).alias("purge"))


@query("mut_memory", "SELECT m.id AS memory_id, x.asset_id FROM memories m JOIN memory_asset x ON x.memory_id = m.id JOIN asset a ON a.id = x.asset_id AND a.visibility = 'timeline' AND a.deleted_at IS NULL WHERE is_saved OR m.created_at >= TIMESTAMP '1998-01-01'")
def mut_memory(c: Catalog) -> DataFrame:
    kept = c.memories.where(F.col("is_saved") | (F.col("created_at") >= F.lit("1998-01-01").cast("timestamp_ntz"))).select(F.col("id").alias("memory_id"))
    shown = c.asset.where("visibility = 'timeline' AND deleted_at IS NULL").select(F.col("id").alias("asset_id"))
    return c.memory_asset.join(kept, "memory_id", "left_semi").join(shown, "asset_id", "left_semi").select("memory_id", "asset_id")


@query(
    "mut_retention",
    """SELECT 'session' AS kind, event_id AS id FROM events WHERE ts + INTERVAL 40 DAY <= TIMESTAMP '2024-02-20' OR (event_id % 4 = 0 AND ts + INTERVAL 30 DAY <= TIMESTAMP '2024-02-20') AND event_type = 'click'
UNION ALL SELECT 'notification', event_id FROM events WHERE event_type <> 'click' AND ((event_id % 5 = 0 AND ts + INTERVAL 1 DAY < TIMESTAMP '2024-02-17') OR (event_id % 3 = 0 AND ts + INTERVAL 20 DAY <= TIMESTAMP '2024-02-18' AND ts < TIMESTAMP '2024-02-05') OR (event_id % 3 <> 0 AND ts < TIMESTAMP '2024-01-21'))
UNION ALL SELECT 'audit', CAST(id AS BIGINT) FROM audit WHERE deleted_at < TIMESTAMP '2024-01-20' UNION ALL SELECT 'user', c_custkey FROM customer WHERE c_custkey % 17 = 0 AND TIMESTAMP '2024-02-20' - to_days(CAST(c_custkey % 15 AS INTEGER)) <= TIMESTAMP '2024-02-13'""",
)
def mut_retention(c: Catalog) -> DataFrame:
    now, k = F.lit("2024-02-20").cast("timestamp_ntz"), F.col("event_id")

    def later(days: int, column: str = "ts"):
        return F.timestamp_add("DAY", F.lit(days), F.col(column))

    # a session was last used 50 days before its event plus 90, some expire 30 days after it
    sessions = c.events.select(k.alias("id"), later(-50).alias("updated_at"), F.when((k % 4 == 0) & (F.col("event_type") == "click"), later(30)).alias("expires_at"))
    notices = c.events.where("event_type <> 'click'").select(k.alias("id"), F.col("ts").alias("created_at"), F.when(k % 3 == 0, later(20)).alias("read_at"), F.when(k % 5 == 0, later(1)).alias("deleted_at"))
    removed = F.timestamp_add("DAY", -(F.col("c_custkey") % 15).cast("int"), now)
    users = c.customer.where("c_custkey % 17 = 0").select(F.col("c_custkey").alias("id"), removed.alias("deleted_at"))
    found = {"session": integrity.stale_sessions(sessions, now), "notification": integrity.stale_notifications(notices, now), "audit": integrity.stale_audit(c.audit.withColumn("id", F.col("id").cast("long")), now), "user": integrity.deletable_users(users, now)}
    parts = [rows.select(F.lit(kind).alias("kind"), "id") for kind, rows in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


GONE = "doomed AS (SELECT id FROM asset WHERE id % 40 IN (0, 10)), gone AS (SELECT id FROM doomed UNION SELECT live_photo_video_id FROM asset WHERE id IN (SELECT id FROM doomed) AND live_photo_video_id IS NOT NULL AND live_photo_video_id NOT IN (SELECT live_photo_video_id FROM asset WHERE live_photo_video_id IS NOT NULL AND id NOT IN (SELECT id FROM doomed)))"


@query("mut_asset_files", f"WITH {GONE} SELECT f.asset_id, f.path FROM asset_file f JOIN asset a ON a.id = f.asset_id WHERE a.id IN (SELECT id FROM gone) AND (f.type <> 'sidecar' OR NOT a.is_offline) UNION ALL SELECT id, original_path FROM asset WHERE id IN (SELECT id FROM gone) AND NOT is_offline")
def mut_asset_files(c: Catalog) -> DataFrame:
    gone = tables.delete_assets(c.asset, c.stack, c.asset.where("id % 40 IN (0, 10)"))["assets"]
    return tables.deleted_files(gone, c.asset, c.asset_file)


@query("mut_asset_usage", f"WITH {GONE} SELECT owner_id, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes FROM asset a LEFT JOIN exif e ON e.asset_id = a.id WHERE a.id IN (SELECT id FROM gone) AND library_id IS NULL GROUP BY ALL")
def mut_asset_usage(c: Catalog) -> DataFrame:
    gone = tables.delete_assets(c.asset, c.stack, c.asset.where("id % 40 IN (0, 10)"))["assets"]
    return tables.usage_freed(gone, c.asset, c.exif)


@query(
    "mut_asset_delete",
    """WITH doomed AS (SELECT id FROM asset WHERE id % 40 IN (0, 10)), gone AS (SELECT id FROM doomed UNION SELECT live_photo_video_id FROM asset WHERE id IN (SELECT id FROM doomed) AND live_photo_video_id IS NOT NULL AND live_photo_video_id NOT IN (SELECT live_photo_video_id FROM asset WHERE live_photo_video_id IS NOT NULL AND id NOT IN (SELECT id FROM doomed))),
m AS (SELECT stack_id, id, id IN (SELECT id FROM gone) AS gone FROM asset WHERE stack_id IS NOT NULL)
SELECT stack_id, count_if(NOT gone) < 2 AS dissolve, CASE WHEN count_if(NOT gone) >= 2 THEN CASE WHEN bool_or(gone AND m.id = primary_asset_id) THEN min(CASE WHEN NOT gone THEN m.id END) ELSE any_value(primary_asset_id) END END AS primary_asset_id FROM m JOIN stack ON stack.id = stack_id GROUP BY stack_id HAVING count_if(gone) > 0""",
)
def mut_asset_delete(c: Catalog) -> DataFrame:
    return tables.delete_assets(c.asset, c.stack, c.asset.where("id % 40 IN (0, 10)"))["stacks"]


@query("mut_snapshot", "SELECT id, CASE WHEN s.k IS NULL THEN 'delete' WHEN b.k IS NULL THEN 'insert' WHEN b.stamp IS DISTINCT FROM s.stamp THEN 'update' ELSE 'same' END AS change, coalesce(s.checksum, b.checksum) AS checksum FROM (SELECT id, 1 AS k, created_at AS stamp, checksum FROM local_asset WHERE id % 10 <> 1) b FULL JOIN (SELECT id, 1 AS k, created_at + to_seconds(CASE WHEN id % 6 = 1 THEN 1 ELSE 0 END) AS stamp, CASE WHEN id % 4 = 1 THEN checksum END AS checksum FROM local_asset WHERE id % 10 <> 3) s USING (id)")
def mut_snapshot(c: Catalog) -> DataFrame:
    base = c.local_asset.where("id % 10 <> 1").select("id", F.col("created_at").alias("stamp"), "checksum")
    snap = c.local_asset.where("id % 10 <> 3").selectExpr("id", "timestampadd(SECOND, CASE WHEN id % 6 = 1 THEN 1 ELSE 0 END, created_at) AS stamp", "CASE WHEN id % 4 = 1 THEN checksum END AS checksum")
    return tables.apply_snapshot(base, snap, "id", "stamp")


@query("mut_faces", "SELECT id, CASE WHEN source_type = 'machine-learning' AND person_id = 3 THEN NULL WHEN person_id = 4 THEN 5 ELSE person_id END AS person_id FROM face")
def mut_faces(c: Catalog) -> DataFrame:
    p = F.col("person_id")
    return c.face.select("id", F.when((F.col("source_type") == "machine-learning") & (p == 3), None).when(p == 4, 5).otherwise(p).cast("long").alias("person_id"))
