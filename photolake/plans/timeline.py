"""Queries of timelines, memories and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions import scalar
from photolake.operators import filters, timeline
from photolake.plans.catalog import Catalog
from photolake.plans.registry import query

VISIBLE = "deleted_at IS NULL AND visibility IN ('archive', 'timeline')"


@query("src_catalog", "SELECT id, owner_id, type, visibility, status, is_favorite, original_path, original_file_name FROM asset")
def src_catalog(c: Catalog) -> DataFrame:
    return c.asset.select("id", "owner_id", "type", "visibility", "status", "is_favorite", "original_path", "original_file_name")


@query("flt_visibility", "SELECT id, owner_id, visibility FROM asset WHERE visibility IN ('archive', 'timeline')")
def flt_visibility(c: Catalog) -> DataFrame:
    return c.asset.where(filters.default_visible()).select("id", "owner_id", "visibility")


@query("agg_time_buckets", f"SELECT owner_id, CAST(date_trunc('month', local_date_time) AS DATE) AS bucket, count(*) AS count FROM asset WHERE {VISIBLE} GROUP BY ALL")
def agg_time_buckets(c: Catalog) -> DataFrame:
    return timeline.time_buckets(timeline.timeline_assets(c.asset), keys=("owner_id",))


@query(
    "agg_time_buckets_stacked",
    f"""SELECT CAST(date_trunc('month', a.created_at) AS DATE) AS bucket, count(*) AS count FROM asset a LEFT JOIN stack s ON s.id = a.stack_id AND s.primary_asset_id = a.id
WHERE a.deleted_at IS NULL AND visibility IN ('archive', 'timeline') AND (a.stack_id IS NULL OR s.id IS NOT NULL) AND is_favorite GROUP BY ALL""",
)
def agg_time_buckets_stacked(c: Catalog) -> DataFrame:
    return timeline.time_buckets(timeline.stack_primaries(timeline.timeline_assets(c.asset), c.stack).where("is_favorite"), by="created_at")


@query(
    "agg_bucket_page_stacked",
    f"""WITH n AS (SELECT stack_id, count(*) AS n FROM asset WHERE stack_id IS NOT NULL AND deleted_at IS NULL AND visibility = 'timeline' GROUP BY ALL)
SELECT owner_id, CAST(date_trunc('month', local_date_time) AS DATE) AS bucket, count(*) AS n, string_agg(coalesce(n.stack_id || ':' || n.n, '-'), ',' ORDER BY CAST(local_date_time AS DATE) DESC, file_created_at DESC, a.id DESC) AS stacks
FROM asset a LEFT JOIN n ON n.stack_id = a.stack_id WHERE {VISIBLE} AND is_favorite AND (a.stack_id IS NULL OR a.id IN (SELECT primary_asset_id FROM stack)) GROUP BY ALL""",
)
def agg_bucket_page_stacked(c: Catalog) -> DataFrame:
    shown = timeline.stacked(timeline.timeline_assets(c.asset, is_favorite={"eq": True}), c.stack, c.asset)
    page = timeline.bucket_page(shown, c.exif)
    pairs = F.transform("stack", lambda s: F.coalesce(F.array_join(s, ":"), F.lit("-")))
    return page.select("owner_id", "bucket", F.size("id").cast("long").alias("n"), F.array_join(pairs, ",").alias("stacks"))


@query(
    "agg_bucket_page",
    f"""SELECT owner_id, CAST(date_trunc('month', local_date_time) AS DATE) AS bucket, count(*) AS n, string_agg(CAST(a.id AS STRING), ',' ORDER BY CAST(local_date_time AS DATE) DESC, file_created_at DESC, a.id DESC) AS ids,
  string_agg(CASE WHEN is_favorite THEN '1' ELSE '0' END, ',' ORDER BY CAST(local_date_time AS DATE) DESC, file_created_at DESC, a.id DESC) AS favorites,
  CAST(sum(date_diff('second', file_created_at, local_date_time)) AS DOUBLE) / 3600 AS hours, count(thumbhash) AS thumbs, count(city) AS cities FROM asset a LEFT JOIN exif e ON e.asset_id = a.id WHERE {VISIBLE} GROUP BY ALL""",
)
def agg_bucket_page(c: Catalog) -> DataFrame:
    page = timeline.bucket_page(timeline.timeline_assets(c.asset), c.exif)

    def known(name: str):
        return F.size(F.filter(name, lambda x: x.isNotNull())).cast("long")

    return page.select(
        "owner_id", "bucket", F.size("id").cast("long").alias("n"), F.array_join(F.transform("id", lambda x: x.cast("string")), ",").alias("ids"),
        F.array_join(F.transform("is_favorite", lambda x: F.when(x, "1").otherwise("0")), ",").alias("favorites"), F.aggregate("offset", F.lit(0.0), lambda a, x: a + x).alias("hours"), known("thumbhash").alias("thumbs"), known("city").alias("cities"),
    )


@query("agg_heatmap", "SELECT owner_id, CAST(local_date_time AS DATE) AS day, count(*) AS count FROM asset WHERE deleted_at IS NULL AND local_date_time >= TIMESTAMP '1997-01-01' AND local_date_time < TIMESTAMP '1998-01-01' GROUP BY ALL")
def agg_heatmap(c: Catalog) -> DataFrame:
    return timeline.heatmap(c.asset, "1997-01-01", "1998-01-01")


DAYS = [f"2001-06-{d:02d}" for d in range(12, 19)]


@query(
    "win_memories",
    f"""WITH target AS (SELECT unnest([{", ".join(f"DATE '{d}'" for d in DAYS)}]) AS t),
hit AS (SELECT strftime(t, '%Y-%m-%d') AS day, owner_id, CAST(year(local_date_time) AS INTEGER) AS year, id, row_number() OVER (PARTITION BY t, owner_id, year(local_date_time) ORDER BY local_date_time DESC, id) AS rank
FROM asset JOIN target ON month(local_date_time) = month(t) AND day(local_date_time) = day(t) AND year(local_date_time) < year(t)
WHERE deleted_at IS NULL AND visibility = 'timeline' AND id IN (SELECT asset_id FROM asset_file WHERE type = 'preview'))
SELECT day, owner_id, year, CAST(rank AS INTEGER) AS rank, id FROM hit WHERE rank <= 20""",
)
def win_memories(c: Catalog) -> DataFrame:
    return timeline.on_this_day(c.asset, c.asset_file, DAYS)


@query("win_recent", f"SELECT owner_id, id, rank FROM (SELECT owner_id, id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, id) AS INTEGER) AS rank FROM asset WHERE {VISIBLE} AND type = 'IMAGE') WHERE rank <= 12")
def win_recent(c: Catalog) -> DataFrame:
    return timeline.recent(c.asset, 12).select("owner_id", "id", "rank")


@query("win_city_first", f"SELECT owner_id, city, min(id) AS id FROM asset JOIN exif ON asset_id = id WHERE {VISIBLE} AND type = 'IMAGE' AND city IS NOT NULL GROUP BY ALL")
def win_city_first(c: Catalog) -> DataFrame:
    rows = timeline.timeline_assets(c.asset).where("type = 'IMAGE'").join(c.exif.where("city IS NOT NULL").select(F.col("asset_id").alias("id"), "city"), "id")
    return timeline.first_of(rows, ["owner_id", "city"], F.col("id")).select("owner_id", "city", "id")


@query(
    "win_filename",
    """SELECT owner_id, id, CASE WHEN n > 0 THEN regexp_replace(original_file_name, '\\.[^.]*$', '') || '+' || n || regexp_extract(original_file_name, '(\\.[^.]*)$', 1) ELSE original_file_name END AS archive_name
FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, original_file_name ORDER BY id) - 1 AS n FROM asset)""",
)
def win_filename(c: Catalog) -> DataFrame:
    return timeline.archive_names(c.asset).select("owner_id", "id", "archive_name")


@query(
    "win_template",
    """WITH t AS (SELECT id, owner_id, strftime(local_date_time, '%Y') || '/' || strftime(local_date_time, '%Y-%m-%d') || '/' || regexp_replace(original_file_name, '\\.[^.]*$', '') AS base, lower(regexp_extract(original_file_name, '\\.([^.]*)$', 1)) AS ext FROM asset),
n AS (SELECT *, row_number() OVER (PARTITION BY owner_id, base, ext ORDER BY id) - 1 AS n FROM t)
SELECT id, owner_id, '/library/' || owner_id || '/' || base || CASE WHEN n > 0 THEN '+' || n ELSE '' END || '.' || ext AS path FROM n""",
)
def win_template(c: Catalog) -> DataFrame:
    return timeline.storage_paths(c.asset, "{{y}}/{{y}}-{{MM}}-{{dd}}/{{filename}}")


@query(
    "win_archives",
    """WITH RECURSIVE o AS (SELECT owner_id, id, file_size, row_number() OVER (PARTITION BY owner_id ORDER BY id) AS n FROM asset JOIN exif ON asset_id = id),
r AS (SELECT owner_id, id, n, file_size AS used, CAST(0 AS BIGINT) AS archive FROM o WHERE n = 1
UNION ALL SELECT o.owner_id, o.id, o.n, CASE WHEN r.used > 100000000 THEN o.file_size ELSE r.used + o.file_size END, CASE WHEN r.used > 100000000 THEN r.archive + 1 ELSE r.archive END FROM r JOIN o ON o.owner_id = r.owner_id AND o.n = r.n + 1)
SELECT owner_id, id, archive FROM r""",
)
def win_archives(c: Catalog) -> DataFrame:
    return timeline.split_archives(c.asset.join(c.exif.select(F.col("asset_id").alias("id"), "file_size"), "id"), 100_000_000)


@query(
    "win_album_thumb",
    """WITH live AS (SELECT album_id, a.id, a.file_created_at FROM album_asset x JOIN asset a ON a.id = x.asset_id WHERE a.deleted_at IS NULL)
SELECT b.id AS album_id, CASE WHEN EXISTS (SELECT 1 FROM live l WHERE l.album_id = b.id AND l.id = b.thumbnail_id) THEN b.thumbnail_id
  ELSE (SELECT l.id FROM live l WHERE l.album_id = b.id ORDER BY l.file_created_at DESC, l.id DESC LIMIT 1) END AS thumbnail_id FROM album b""",
)
def win_album_thumb(c: Catalog) -> DataFrame:
    members = c.album_asset.join(c.asset.where("deleted_at IS NULL").select(F.col("id").alias("asset_id"), "file_created_at"), "asset_id")
    newest = members.join(c.album.select(F.col("id").alias("album_id"), "thumbnail_id"), "album_id").groupBy("album_id").agg(
        F.max_by("asset_id", F.struct("file_created_at", "asset_id")).alias("newest"), F.max(F.coalesce(F.col("asset_id") == F.col("thumbnail_id"), F.lit(False))).alias("valid")
    )
    rows = c.album.select(F.col("id").alias("album_id"), "thumbnail_id").join(newest, "album_id", "left")
    return rows.select("album_id", F.when(F.coalesce("valid", F.lit(False)), F.col("thumbnail_id")).otherwise(F.col("newest")).alias("thumbnail_id"))


@query("fn_bucket", "SELECT id, CAST(date_trunc('month', local_date_time) AS DATE) AS month, CAST(date_trunc('day', created_at) AS DATE) AS day FROM asset")
def fn_bucket(c: Catalog) -> DataFrame:
    return c.asset.select("id", scalar.truncated(F.col("local_date_time"), "month").alias("month"), scalar.truncated(F.col("created_at"), "day").alias("day"))


@query("fn_offset", "SELECT id, CAST(date_diff('second', file_created_at, local_date_time) AS DOUBLE) / 3600 AS hours FROM asset")
def fn_offset(c: Catalog) -> DataFrame:
    return c.asset.select("id", scalar.offset_hours(F.col("local_date_time"), F.col("file_created_at")).alias("hours"))


@query("fn_ratio", "SELECT id, CASE WHEN coalesce(width, 0) <> 0 AND coalesce(height, 0) <> 0 THEN CAST(floor(CAST(width AS DOUBLE) / height * 1000 + 0.5) / 1000 AS DOUBLE) ELSE 1.0::DOUBLE END AS ratio FROM asset")
def fn_ratio(c: Catalog) -> DataFrame:
    return c.asset.select("id", scalar.aspect_ratio(F.col("width"), F.col("height")).alias("ratio"))


@query("fn_shift", "SELECT id, strftime(file_created_at + to_minutes(90), '%Y-%m-%d %H:%M:%S') AS shifted FROM asset")
def fn_shift(c: Catalog) -> DataFrame:
    return c.asset.select("id", F.date_format(F.expr("timestampadd(MINUTE, 90, file_created_at)"), "yyyy-MM-dd HH:mm:ss").alias("shifted"))


@query("fn_dir_base", "SELECT id, regexp_replace(original_path, '/[^/]*$', '') AS directory, regexp_replace(original_path, '^.*/', '') AS base FROM asset")
def fn_dir_base(c: Catalog) -> DataFrame:
    return c.asset.select("id", scalar.directory(F.col("original_path")).alias("directory"), scalar.base_name(F.col("original_path")).alias("base"))


@query("fn_b64", "SELECT id, to_base64(unhex(thumbhash)) AS thumbhash FROM asset")
def fn_b64(c: Catalog) -> DataFrame:
    return c.asset.select("id", F.base64(F.unhex("thumbhash")).alias("thumbhash"))


@query("fn_format", "SELECT id, strftime(local_date_time, '%Y/%m/%d %H-%M-%S') AS text FROM asset")
def fn_format(c: Catalog) -> DataFrame:
    return c.asset.select("id", scalar.storage_path("{{y}}/{{MM}}/{{dd}} {{HH}}-{{mm}}-{{ss}}", F.col("local_date_time")).alias("text"))


@query("fn_stem", "SELECT id, lower(regexp_replace(original_file_name, '\\.[^.]*$', '')) AS stem, lower(regexp_extract(original_file_name, '\\.([^.]*)$', 1)) AS extension FROM asset")
def fn_stem(c: Catalog) -> DataFrame:
    return c.asset.select("id", scalar.stem(F.col("original_file_name")).alias("stem"), scalar.extension(F.col("original_file_name")).alias("extension"))


@query("fn_unaccent", "SELECT asset_id, strip_accents(city) AS city FROM exif")
def fn_unaccent(c: Catalog) -> DataFrame:
    return c.exif.select("asset_id", scalar.unaccent(F.col("city")).alias("city"))


@query(
    "fn_exif_clean",
    "SELECT asset_id, CASE WHEN rating BETWEEN 1 AND 5 THEN rating END AS rating, CASE WHEN bits_per_sample >= 24 THEN CAST(floor(bits_per_sample / 3) AS INTEGER) ELSE bits_per_sample END AS bits, coalesce(orientation IN (5, 6, 7, 8), false) AS sideways FROM exif",
)
def fn_exif_clean(c: Catalog) -> DataFrame:
    return c.exif.select("asset_id", scalar.rating(F.col("rating")).alias("rating"), scalar.bits_per_sample(F.col("bits_per_sample")).alias("bits"), scalar.sideways(F.col("orientation")).alias("sideways"))


@query(
    "flt_srgb",
    "SELECT asset_id, CASE WHEN coalesce(colorspace, profile_description) IS NOT NULL THEN contains(lower(coalesce(colorspace, '')), 'srgb') OR contains(lower(coalesce(profile_description, '')), 'srgb') ELSE coalesce(bits_per_sample, 8) <= 8 END AS srgb FROM exif",
)
def flt_srgb(c: Catalog) -> DataFrame:
    return c.exif.select("asset_id", scalar.is_srgb(F.col("colorspace"), F.col("profile_description"), F.col("bits_per_sample")).alias("srgb"))


@query("fn_box_visible", "SELECT id, greatest(least(x2, 200) - greatest(x1, 50), 0) * greatest(least(y2, 180) - greatest(y1, 20), 0) >= 0.5 * (x2 - x1) * (y2 - y1) AS visible FROM face")
def fn_box_visible(c: Catalog) -> DataFrame:
    return c.face.select("id", scalar.box_visible(*map(F.col, ("x1", "y1", "x2", "y2")), crop=(50, 20, 200, 180)).alias("visible"))


@query("fn_pref", "SELECT id, coalesce(TRY_CAST(json_extract_string(preferences, '$.people.minimumFaces') AS INTEGER), 3) AS minimum_faces FROM users")
def fn_pref(c: Catalog) -> DataFrame:
    return c.users.select("id", scalar.preference(F.col("preferences"), "$.people.minimumFaces", 3).alias("minimum_faces"))


@query(
    "fn_earth",
    "SELECT asset_id, round(6378168.0 * cos(radians(latitude)) * cos(radians(longitude)), 3) AS x, round(6378168.0 * cos(radians(latitude)) * sin(radians(longitude)), 3) AS y, round(6378168.0 * sin(radians(latitude)), 3) AS z FROM exif WHERE latitude IS NOT NULL",
)
def fn_earth(c: Catalog) -> DataFrame:
    p = scalar.earth(F.col("latitude"), F.col("longitude"))
    return c.exif.where("latitude IS NOT NULL").select("asset_id", *(F.round(p[k], 3).alias(k) for k in "xyz"))


@query("fn_uuid7", "SELECT id, CAST(concat('0x', substr(thumbhash, 1, 12)) AS BIGINT) AS ms FROM asset WHERE thumbhash IS NOT NULL")
def fn_uuid7(c: Catalog) -> DataFrame:
    return c.asset.where("thumbhash IS NOT NULL").select("id", scalar.uuid7_ms(F.col("thumbhash")).alias("ms"))
