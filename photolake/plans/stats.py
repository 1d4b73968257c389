"""Queries of statistics, albums and access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions import scalar
from photolake.operators import filters, reconcile, relations, stats, timeline
from photolake.operators.stats import count_if
from photolake.plans.catalog import Catalog
from photolake.plans.registry import query

SHOWN = "a.deleted_at IS NULL AND a.visibility IN ('archive', 'timeline')"


@query("agg_asset_stats", f"SELECT owner_id, count_if(type = 'IMAGE') AS images, count_if(type = 'VIDEO') AS videos, count_if(type NOT IN ('IMAGE', 'VIDEO')) AS others FROM asset a WHERE {SHOWN} AND is_favorite GROUP BY ALL")
def agg_asset_stats(c: Catalog) -> DataFrame:
    rows = timeline.timeline_assets(c.asset).where("is_favorite")
    return rows.groupBy("owner_id").agg(count_if("type = 'IMAGE'").alias("images"), count_if("type = 'VIDEO'").alias("videos"), count_if("type NOT IN ('IMAGE', 'VIDEO')").alias("others"))


@query(
    "agg_user_stats",
    """SELECT u.id, count(CASE WHEN type = 'IMAGE' AND visibility <> 'hidden' THEN 1 END) AS photos, count(CASE WHEN type = 'VIDEO' AND visibility <> 'hidden' THEN 1 END) AS videos,
CAST(coalesce(sum(CASE WHEN library_id IS NULL THEN file_size END), 0) AS BIGINT) AS usage, CAST(coalesce(sum(CASE WHEN library_id IS NULL AND type = 'IMAGE' THEN file_size END), 0) AS BIGINT) AS usage_photos,
CAST(coalesce(sum(CASE WHEN library_id IS NULL AND type = 'VIDEO' THEN file_size END), 0) AS BIGINT) AS usage_videos, quota
FROM users u LEFT JOIN asset a ON a.owner_id = u.id AND a.deleted_at IS NULL LEFT JOIN exif e ON e.asset_id = a.id WHERE NOT u.is_deleted GROUP BY u.id, quota""",
)
def agg_user_stats(c: Catalog) -> DataFrame:
    return stats.user_stats(c.users, c.asset, c.exif)


@query("agg_quota", "SELECT u.id, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS usage FROM users u LEFT JOIN asset a ON a.owner_id = u.id AND library_id IS NULL LEFT JOIN exif ON asset_id = a.id WHERE NOT u.is_deleted GROUP BY u.id")
def agg_quota(c: Catalog) -> DataFrame:
    return stats.quota_usage(c.users, c.asset, c.exif)


@query(
    "agg_library_stats",
    """SELECT l.id, count(CASE WHEN type = 'IMAGE' AND visibility <> 'hidden' THEN 1 END) AS photos, count(CASE WHEN type = 'VIDEO' AND visibility <> 'hidden' THEN 1 END) AS videos, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS usage, count(a.id) AS total
FROM library l LEFT JOIN asset a ON a.library_id = l.id AND a.deleted_at IS NULL LEFT JOIN exif ON asset_id = a.id GROUP BY l.id""",
)
def agg_library_stats(c: Catalog) -> DataFrame:
    return stats.library_stats(c.library, c.asset, c.exif)


@query("agg_album_meta", f"SELECT album_id, CAST(min(local_date_time) AS DATE) AS start, CAST(max(local_date_time) AS DATE) AS \"end\", CAST(max(updated_at) AS DATE) AS changed, count(*) AS count FROM album_asset JOIN asset a ON a.id = asset_id WHERE {SHOWN} GROUP BY ALL")
def agg_album_meta(c: Catalog) -> DataFrame:
    return stats.album_metadata(c.album_asset, c.asset)


@query("agg_contributors", "SELECT album_id, owner_id, count(*) AS count FROM album_asset JOIN asset a ON a.id = asset_id WHERE a.deleted_at IS NULL GROUP BY ALL")
def agg_contributors(c: Catalog) -> DataFrame:
    live = c.asset.where("deleted_at IS NULL").select(F.col("id").alias("asset_id"), "owner_id")
    return c.album_asset.join(live, "asset_id").groupBy("album_id", "owner_id").agg(F.count("*").alias("count"))


@query("agg_album_sort", "SELECT b.id, CAST(min(a.file_created_at) AS DATE) AS start, CAST(max(a.file_created_at) AS DATE) AS \"end\" FROM album b JOIN album_asset x ON x.album_id = b.id JOIN asset a ON a.id = x.asset_id WHERE a.deleted_at IS NULL GROUP BY ALL")
def agg_album_sort(c: Catalog) -> DataFrame:
    members = c.album_asset.join(c.asset.where("deleted_at IS NULL").select(F.col("id").alias("asset_id"), "file_created_at"), "asset_id")
    sums = members.groupBy(F.col("album_id").alias("id")).agg(F.min("file_created_at").cast("date").alias("start"), F.max("file_created_at").cast("date").alias("end"))
    return c.album.select("id").join(sums, "id").orderBy("start", "id")


@query("agg_album_share", "SELECT id, owner_id, id IN (SELECT album_id FROM album_user WHERE role <> 'owner') OR id IN (SELECT album_id FROM shared_link WHERE album_id IS NOT NULL) AS shared FROM album WHERE NOT is_deleted")
def agg_album_share(c: Catalog) -> DataFrame:
    members = c.album_user.where("role <> 'owner'").select(F.col("album_id").alias("id"))
    shared = members.unionByName(c.shared_link.where("album_id IS NOT NULL").select(F.col("album_id").alias("id"))).distinct().withColumn("shared", F.lit(True))
    return c.album.where("NOT is_deleted").join(shared, "id", "left").select("id", "owner_id", F.coalesce("shared", F.lit(False)).alias("shared"))


@query(
    "agg_albums_list",
    """SELECT b.id, b.name, u.name AS owner, count(DISTINCT a.id) AS assets FROM album b LEFT JOIN users u ON u.id = b.owner_id LEFT JOIN album_asset x ON x.album_id = b.id LEFT JOIN asset a ON a.id = x.asset_id AND a.deleted_at IS NULL GROUP BY ALL""",
)
def agg_albums_list(c: Catalog) -> DataFrame:
    live = c.album_asset.join(c.asset.where("deleted_at IS NULL").select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    counts = live.groupBy(F.col("album_id").alias("id")).agg(F.count_distinct("asset_id").alias("assets"))
    owners = c.users.select(F.col("id").alias("owner_id"), F.col("name").alias("owner"))
    return c.album.join(counts, "id", "left").join(owners, "owner_id", "left").select("id", "name", "owner", F.coalesce("assets", F.lit(0)).alias("assets"))


ACTIVE = "FROM activity v JOIN users u ON u.id = v.user_id AND NOT u.is_deleted LEFT JOIN asset a ON a.id = v.asset_id WHERE (v.asset_id IS NULL OR (a.deleted_at IS NULL AND a.id IS NOT NULL AND a.visibility <> 'locked'))"


def live_activity(c: Catalog) -> DataFrame:
    users = c.users.where("NOT is_deleted").select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    assets = c.asset.where("deleted_at IS NULL AND visibility <> 'locked'").select(F.col("id").alias("asset_id"), F.lit(True).alias("live"))
    return c.activity.join(users, "user_id").join(assets, "asset_id", "left").where("asset_id IS NULL OR live")


@query("agg_activity", f"SELECT album_id, count_if(is_liked) AS likes, count_if(NOT is_liked) AS comments {ACTIVE} GROUP BY ALL")
def agg_activity(c: Catalog) -> DataFrame:
    return live_activity(c).groupBy("album_id").agg(count_if("is_liked").alias("likes"), count_if("NOT is_liked").alias("comments"))


@query("jn_activity", f"SELECT v.id, v.album_id, v.asset_id, u.name AS user_name, v.comment {ACTIVE}")
def jn_activity(c: Catalog) -> DataFrame:
    return live_activity(c).select("id", "album_id", "asset_id", "user_name", "comment")


@query(
    "agg_people",
    """SELECT p.id, p.owner_id, p.name, count(DISTINCT a.id) AS faces FROM person p JOIN face f ON f.person_id = p.id AND f.is_visible AND f.deleted_at IS NULL JOIN asset a ON a.id = f.asset_id AND a.visibility = 'timeline' AND a.deleted_at IS NULL LEFT JOIN users u ON u.id = p.owner_id
GROUP BY p.id, p.owner_id, p.name, u.preferences HAVING p.name <> '' OR count(DISTINCT a.id) >= coalesce(TRY_CAST(json_extract_string(u.preferences, '$.people.minimumFaces') AS INTEGER), 3)""",
)
def agg_people(c: Catalog) -> DataFrame:
    return stats.people(c.person, c.face, c.asset, c.users).select("id", "owner_id", "name", "faces")


@query("agg_person_assets", "SELECT person_id, count(DISTINCT a.id) AS assets FROM face f JOIN asset a ON a.id = f.asset_id WHERE person_id IS NOT NULL AND f.deleted_at IS NULL AND is_visible AND a.visibility = 'timeline' AND a.deleted_at IS NULL GROUP BY ALL")
def agg_person_assets(c: Catalog) -> DataFrame:
    shown = c.asset.where("visibility = 'timeline' AND deleted_at IS NULL").select(F.col("id").alias("asset_id"))
    return c.face.where("person_id IS NOT NULL AND deleted_at IS NULL AND is_visible").join(shown, "asset_id", "left_semi").groupBy("person_id").agg(F.count_distinct("asset_id").alias("assets"))


@query("agg_people_total", "SELECT owner_id, count(*) AS total, count_if(is_hidden) AS hidden FROM person WHERE id IN (SELECT person_id FROM face f JOIN asset a ON a.id = f.asset_id WHERE person_id IS NOT NULL AND f.deleted_at IS NULL AND is_visible AND a.visibility = 'timeline' AND a.deleted_at IS NULL) GROUP BY ALL")
def agg_people_total(c: Catalog) -> DataFrame:
    shown = c.asset.where("visibility = 'timeline' AND deleted_at IS NULL").select(F.col("id").alias("asset_id"))
    seen = c.face.where("person_id IS NOT NULL AND deleted_at IS NULL AND is_visible").join(shown, "asset_id", "left_semi").select(F.col("person_id").alias("id"))
    return c.person.join(seen, "id", "left_semi").groupBy("owner_id").agg(F.count("*").alias("total"), count_if("is_hidden").alias("hidden"))


@query(
    "agg_explore_city",
    f"""WITH big AS (SELECT city FROM exif JOIN asset a ON a.id = asset_id WHERE city <> '' AND a.deleted_at IS NULL AND a.visibility = 'timeline' AND type = 'IMAGE' GROUP BY city HAVING count(*) >= 5)
SELECT owner_id, city, min(a.id) AS id FROM exif JOIN asset a ON a.id = asset_id WHERE a.deleted_at IS NULL AND a.visibility = 'timeline' AND type = 'IMAGE' AND city IN (SELECT city FROM big) GROUP BY ALL""",
)
def agg_explore_city(c: Catalog) -> DataFrame:
    rows = c.asset.where("deleted_at IS NULL AND visibility = 'timeline' AND type = 'IMAGE'").join(c.exif.where("city <> ''").select(F.col("asset_id").alias("id"), "city"), "id")
    big = rows.groupBy("city").count().where("count >= 5").select("city")
    return rows.join(big, "city", "left_semi").groupBy("owner_id", "city").agg(F.min("id").alias("id"))


@query("agg_memory_stats", "SELECT owner_id, count(*) AS total, count_if(is_saved) AS saved FROM memories WHERE NOT is_trashed GROUP BY ALL")
def agg_memory_stats(c: Catalog) -> DataFrame:
    return c.memories.where("NOT is_trashed").groupBy("owner_id").agg(F.count("*").alias("total"), count_if("is_saved").alias("saved"))


@query("agg_integrity", "SELECT t.type, count(r.id) AS count FROM (SELECT unnest(['checksum_mismatch', 'missing_file', 'untracked_file', 'other']) AS type) t LEFT JOIN report r ON r.type = t.type GROUP BY ALL")
def agg_integrity(c: Catalog) -> DataFrame:
    kinds = c.spark.createDataFrame([(k,) for k in ("checksum_mismatch", "missing_file", "untracked_file", "other")], "type string")
    counts = c.report.groupBy("type").agg(F.count("*").alias("count"))
    return kinds.join(counts, "type", "left").select("type", F.coalesce("count", F.lit(0)).alias("count"))


@query(
    "agg_dup_groups",
    f"""WITH t AS (SELECT asset_id, string_agg(value, '+' ORDER BY value, tag_id) AS tags FROM tag_asset JOIN tag ON tag.id = tag_id GROUP BY ALL)
SELECT duplicate_id, owner_id, string_agg(CAST(a.id AS STRING), ',' ORDER BY local_date_time, a.id) AS ids, string_agg(coalesce(make, '-') || '/' || coalesce(city, '-') || '/' || CAST(file_size AS STRING), ',' ORDER BY local_date_time, a.id) AS exif, string_agg(coalesce(tags, ''), ',' ORDER BY local_date_time, a.id) AS tags, count(*) AS n
FROM asset a JOIN exif e ON e.asset_id = a.id LEFT JOIN t ON t.asset_id = a.id WHERE {SHOWN} AND duplicate_id IS NOT NULL AND stack_id IS NULL GROUP BY ALL HAVING count(*) > 1""",
)
def agg_dup_groups(c: Catalog) -> DataFrame:
    groups = relations.duplicate_groups(timeline.timeline_assets(c.asset), c.exif, c.tag, c.tag_asset)
    exif = F.transform("items", lambda i: F.concat_ws("/", *(F.coalesce(i["exif"][f].cast("string"), F.lit("-")) for f in ("make", "city", "file_size"))))
    tags = F.transform("items", lambda i: F.array_join(F.transform(i["tags"], lambda t: t["value"]), "+"))
    return groups.select("duplicate_id", "owner_id", F.array_join(F.transform("items.id", lambda x: x.cast("string")), ",").alias("ids"), F.array_join(exif, ",").alias("exif"), F.array_join(tags, ",").alias("tags"), F.size("items").cast("long").alias("n"))


@query("agg_dup_singletons", "SELECT id, CASE WHEN count(*) OVER (PARTITION BY duplicate_id) > 1 THEN duplicate_id END AS duplicate_id FROM asset WHERE duplicate_id IS NOT NULL")
def agg_dup_singletons(c: Catalog) -> DataFrame:
    rows = c.asset.where("duplicate_id IS NOT NULL").select("id", "duplicate_id")
    single = rows.groupBy("duplicate_id").count().where("count = 1").select("duplicate_id", F.lit(True).alias("single"))
    return rows.join(single, "duplicate_id", "left").select("id", F.when(F.col("single").isNull(), F.col("duplicate_id")).alias("duplicate_id"))


@query("agg_place_buckets", "SELECT city, CAST(date_trunc('month', local_date_time) AS DATE) AS bucket, count(*) AS count FROM asset JOIN exif ON asset_id = id WHERE deleted_at IS NULL AND visibility = 'timeline' AND city IN ('City 27', 'City 46') GROUP BY ALL")
def agg_place_buckets(c: Catalog) -> DataFrame:
    rows = c.asset.where("deleted_at IS NULL AND visibility = 'timeline'").join(c.exif.where(F.col("city").isin("City 27", "City 46")).select(F.col("asset_id").alias("id"), "city"), "id")
    return stats.buckets_by(rows, ["city"])


@query("agg_map_buckets", "SELECT CAST(local_date_time AS DATE) AS bucket, count(*) AS count FROM asset JOIN exif ON asset_id = id WHERE deleted_at IS NULL AND visibility = 'timeline' AND latitude BETWEEN 0 AND 50 AND longitude BETWEEN 10 AND 90 GROUP BY ALL")
def agg_map_buckets(c: Catalog) -> DataFrame:
    places = c.exif.where(filters.in_bbox(10, 0, 90, 50)).select(F.col("asset_id").alias("id"))
    return stats.buckets_by(c.asset.where("deleted_at IS NULL AND visibility = 'timeline'").join(places, "id", "left_semi"), [], "day")


@query("agg_places", "SELECT city, min(id) AS id FROM asset JOIN exif ON asset_id = id WHERE city <> '' AND deleted_at IS NULL AND visibility = 'timeline' GROUP BY ALL")
def agg_places(c: Catalog) -> DataFrame:
    rows = c.asset.where("deleted_at IS NULL AND visibility = 'timeline'").join(c.exif.where("city <> ''").select(F.col("asset_id").alias("id"), "city"), "id")
    return rows.groupBy("city").agg(F.min("id").alias("id")).orderBy("city")


@query("agg_paths", f"SELECT DISTINCT owner_id, regexp_replace(original_path, '/[^/]*$', '') AS folder FROM asset a WHERE {SHOWN}")
def agg_paths(c: Catalog) -> DataFrame:
    return timeline.timeline_assets(c.asset).select("owner_id", scalar.directory(F.col("original_path")).alias("folder")).distinct()


@query("agg_latest", "SELECT CAST(max(faces_at) AS DATE) AS latest FROM job_status")
def agg_latest(c: Catalog) -> DataFrame:
    return c.job_status.agg(F.max("faces_at").cast("date").alias("latest"))


@query(
    "agg_cube_stats",
    "SELECT owner_id, type, CAST(date_trunc('month', local_date_time) AS DATE) AS month, count(*) AS count, CAST(sum(file_size) AS BIGINT) AS bytes, grouping(owner_id, type, CAST(date_trunc('month', local_date_time) AS DATE)) AS level FROM asset LEFT JOIN exif ON asset_id = id WHERE deleted_at IS NULL GROUP BY ROLLUP (owner_id, type, CAST(date_trunc('month', local_date_time) AS DATE))",
)
def agg_cube_stats(c: Catalog) -> DataFrame:
    return stats.rollup(c.asset, c.exif)


@query("jn_exif", "SELECT id, make, city FROM asset LEFT JOIN exif ON asset_id = id")
def jn_exif(c: Catalog) -> DataFrame:
    nested = c.exif.select(F.col("asset_id").alias("id"), F.struct(*[x for x in c.exif.columns if x != "asset_id"]).alias("exif"))
    return c.asset.select("id").join(nested, "id", "left").select("id", F.col("exif.make").alias("make"), F.col("exif.city").alias("city"))


@query(
    "jn_nested",
    """WITH s AS (SELECT * FROM face WHERE deleted_at IS NULL AND is_visible), f AS (SELECT asset_id, string_agg(concat_ws(':', id, coalesce(CAST(person_id AS STRING), '-'), x1, y1, x2, y2), ',' ORDER BY id, person_id NULLS FIRST, x1, y1, x2, y2) AS faces FROM s GROUP BY ALL),
p AS (SELECT asset_id, string_agg(concat_ws(':', person_id, name, is_hidden), ',' ORDER BY person_id) AS people FROM (SELECT DISTINCT asset_id, person_id FROM s) JOIN person ON person.id = person_id GROUP BY ALL),
t AS (SELECT asset_id, string_agg(value || ':' || tag_id, ',' ORDER BY value, tag_id) AS tags FROM tag_asset JOIN tag ON tag.id = tag_id GROUP BY ALL), x AS (SELECT asset_id, string_agg(type || ':' || path, ',' ORDER BY type, path) AS files FROM asset_file GROUP BY ALL),
k AS (SELECT stack.id, concat_ws(':', stack.id, primary_asset_id, string_agg(CAST(asset.id AS STRING), '+' ORDER BY asset.id <> primary_asset_id, asset.id)) AS stack FROM stack JOIN asset ON asset.stack_id = stack.id GROUP BY stack.id, primary_asset_id)
SELECT a.id, coalesce(faces, '') AS faces, coalesce(people, '') AS people, coalesce(tags, '') AS tags, coalesce(files, '') AS files, CASE WHEN is_edited THEN CASE WHEN a.id % 28 = 0 THEN '0:crop,1:rotate' ELSE '0:crop' END ELSE '' END AS edits,
u.name || ':' || u.email AS owner, l.id || ':' || l.owner_id AS library, k.stack FROM asset a LEFT JOIN f ON f.asset_id = a.id LEFT JOIN p ON p.asset_id = a.id LEFT JOIN t ON t.asset_id = a.id LEFT JOIN x ON x.asset_id = a.id LEFT JOIN users u ON u.id = a.owner_id LEFT JOIN library l ON l.id = a.library_id LEFT JOIN k ON k.id = a.stack_id""",
)
def jn_nested(c: Catalog) -> DataFrame:
    actions = F.when(F.col("id") % 28 == 0, F.array(F.lit("crop"), F.lit("rotate"))).otherwise(F.array(F.lit("crop")))
    edits = c.asset.where("is_edited").select(F.col("id").alias("asset_id"), F.posexplode(actions).alias("sequence", "action"))
    rows = relations.with_relations(c.asset.select("id", "owner_id", "library_id", "stack_id"), c.face, c.person, c.tag, c.tag_asset, c.asset_file, edits, c.users, c.library, c.stack)
    flat = {"faces": ("face_id", "person_id", "x1", "y1", "x2", "y2"), "people": ("person_id", "name", "is_hidden"), "tags": ("value", "tag_id"), "files": ("type", "path"), "edits": ("sequence", "action")}
    stack = F.concat(F.concat_ws(":", "stack.id", "stack.primary_asset_id"), F.lit(":"), F.array_join(F.transform("stack.asset_ids", lambda x: x.cast("string")), "+"))
    return rows.select("id", *(relations.flat(k, *v).alias(k) for k, v in flat.items()), F.concat("owner.name", F.lit(":"), "owner.email").alias("owner"), F.concat(F.col("library.id").cast("string"), F.lit(":"), F.col("library.library_owner").cast("string")).alias("library"), F.when(F.col("stack").isNotNull(), stack).alias("stack"))


@query(
    "jn_album_access",
    "SELECT id AS album_id, owner_id AS user_id, 'owner' AS via FROM album WHERE NOT is_deleted UNION SELECT album_id, user_id, role FROM album_user JOIN album b ON b.id = album_id WHERE NOT is_deleted AND role <> 'owner' UNION SELECT album_id, l.user_id, 'link' FROM shared_link l JOIN album b ON b.id = album_id WHERE NOT is_deleted",
)
def jn_album_access(c: Catalog) -> DataFrame:
    live = c.album.where("NOT is_deleted").select(F.col("id").alias("album_id"), F.col("owner_id").alias("album_owner"))
    own = live.select("album_id", F.col("album_owner").alias("user_id"), F.lit("owner").alias("via"))
    member = c.album_user.where("role <> 'owner'").join(live, "album_id").select("album_id", "user_id", F.col("role").alias("via"))
    link = c.shared_link.where("album_id IS NOT NULL").join(live, "album_id").select("album_id", "user_id", F.lit("link").alias("via"))
    return own.unionByName(member).unionByName(link).distinct()


@query("jn_partners", "SELECT id AS user_id, id AS owner_id FROM users WHERE NOT is_deleted UNION SELECT shared_with, shared_by FROM partner JOIN users a ON a.id = shared_by AND NOT a.is_deleted JOIN users b ON b.id = shared_with AND NOT b.is_deleted WHERE in_timeline")
def jn_partners(c: Catalog) -> DataFrame:
    live = c.users.where("NOT is_deleted").select("id")
    shared = c.partner.where("in_timeline").join(live.withColumnRenamed("id", "shared_by"), "shared_by", "left_semi").join(live.withColumnRenamed("id", "shared_with"), "shared_with", "left_semi")
    return live.select(F.col("id").alias("user_id"), F.col("id").alias("owner_id")).unionByName(shared.select(F.col("shared_with").alias("user_id"), F.col("shared_by").alias("owner_id"))).distinct()


@query("jn_partner_list", "SELECT shared_by, a.name AS by_name, shared_with, b.name AS with_name, in_timeline FROM partner JOIN users a ON a.id = shared_by AND NOT a.is_deleted JOIN users b ON b.id = shared_with AND NOT b.is_deleted")
def jn_partner_list(c: Catalog) -> DataFrame:
    live = c.users.where("NOT is_deleted")
    rows = c.partner.join(live.select(F.col("id").alias("shared_by"), F.col("name").alias("by_name")), "shared_by")
    return rows.join(live.select(F.col("id").alias("shared_with"), F.col("name").alias("with_name")), "shared_with").select("shared_by", "by_name", "shared_with", "with_name", "in_timeline")


@query(
    "jn_access",
    """WITH given AS (SELECT 'user' AS kind, m.user_id AS principal, x.asset_id FROM album_user m JOIN users u ON u.id = m.user_id AND NOT u.is_deleted JOIN album b ON b.id = m.album_id AND NOT b.is_deleted JOIN album_asset x ON x.album_id = m.album_id
UNION SELECT 'link', l.id, x.asset_id FROM shared_link l JOIN album b ON b.id = l.album_id AND NOT b.is_deleted JOIN album_asset x ON x.album_id = l.album_id UNION SELECT 'link', l.id, x.asset_id FROM shared_link l JOIN shared_link_asset x ON x.link_id = l.id),
acc AS (SELECT 'user' AS kind, a.owner_id AS principal, a.id FROM asset a LEFT JOIN session s ON s.user_id = a.owner_id WHERE visibility <> 'locked' OR coalesce(s.elevated, false)
UNION SELECT 'user', shared_with, a.id FROM partner p JOIN users u ON u.id = p.shared_by AND NOT u.is_deleted JOIN asset a ON a.owner_id = p.shared_by AND a.deleted_at IS NULL AND a.visibility IN ('timeline', 'hidden')
UNION SELECT kind, principal, a.id FROM given g JOIN asset a ON a.id = g.asset_id AND a.deleted_at IS NULL UNION SELECT kind, principal, a.live_photo_video_id FROM given g JOIN asset a ON a.id = g.asset_id AND a.deleted_at IS NULL WHERE a.live_photo_video_id IS NOT NULL)
SELECT kind, principal, count(*) AS assets, CAST(sum(id) AS BIGINT) AS digest FROM acc GROUP BY ALL""",
)
def jn_access(c: Catalog) -> DataFrame:
    seen = reconcile.accessible(c.asset, c.album, c.album_user, c.album_asset, c.users, c.partner, c.shared_link, c.shared_link_asset, c.session)
    return seen.groupBy("kind", "principal").agg(F.count("*").alias("assets"), F.sum("id").alias("digest"))


@query(
    "jn_shared_link",
    "SELECT s.id AS link_id, a.id AS asset_id, file_size FROM shared_link s JOIN (SELECT link_id, asset_id FROM shared_link_asset UNION SELECT l.id, x.asset_id FROM shared_link l JOIN album b ON b.id = l.album_id AND NOT b.is_deleted JOIN album_asset x ON x.album_id = l.album_id) m ON m.link_id = s.id JOIN asset a ON a.id = m.asset_id AND a.deleted_at IS NULL LEFT JOIN exif e ON e.asset_id = a.id",
)
def jn_shared_link(c: Catalog) -> DataFrame:
    albums = c.shared_link.join(c.album.where("NOT is_deleted").select(F.col("id").alias("album_id")), "album_id", "left_semi").join(c.album_asset, "album_id").select(F.col("id").alias("link_id"), "asset_id")
    members = c.shared_link_asset.select("link_id", "asset_id").unionByName(albums).distinct().join(c.shared_link.select(F.col("id").alias("link_id")), "link_id", "left_semi")
    live = c.asset.where("deleted_at IS NULL").select(F.col("id").alias("asset_id"))
    return members.join(live, "asset_id", "left_semi").join(c.exif.select("asset_id", "file_size"), "asset_id", "left").select("link_id", "asset_id", "file_size")


@query(
    "jn_map_markers",
    """SELECT u.id AS user_id, count(*) AS markers, CAST(sum(a.id) AS BIGINT) AS digest FROM users u JOIN asset a ON a.deleted_at IS NULL AND ((a.owner_id = u.id AND a.visibility IN ('archive', 'timeline')) OR (a.visibility = 'timeline' AND EXISTS (SELECT 1 FROM album_user m JOIN album_asset x ON x.album_id = m.album_id WHERE m.user_id = u.id AND x.asset_id = a.id)))
JOIN exif e ON e.asset_id = a.id AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY ALL""",
)
def jn_map_markers(c: Catalog) -> DataFrame:
    placed = c.asset.where("deleted_at IS NULL").join(c.exif.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(F.col("asset_id").alias("id")), "id", "left_semi")
    own = placed.where(filters.default_visible()).select(F.col("owner_id").alias("user_id"), "id")
    shared = c.album_user.join(c.album_asset, "album_id").select("user_id", F.col("asset_id").alias("id")).distinct().join(placed.where("visibility = 'timeline'").select("id"), "id", "left_semi").select("user_id", "id")
    rows = own.unionByName(shared).distinct().join(c.users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return rows.groupBy("user_id").agg(F.count("*").alias("markers"), F.sum("id").alias("digest"))
