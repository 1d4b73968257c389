"""Further queries: media streams, stack plans, dates and registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions import registry as names
from photolake.functions import scalar, similarity
from photolake.operators import filters, groups
from photolake.plans.catalog import Catalog
from photolake.plans.people import CLOSURE, PAIRS, pair_input
from photolake.plans.registry import query
from photolake.plans.search import similar_sql, trigrams_sql


@query(
    "flt_ids_legacy",
    f"""WITH {CLOSURE}, p AS (SELECT asset_id FROM face WHERE person_id IN (1, 2, 4, 5, 7, 8, 10, 11, 13, 14) AND deleted_at IS NULL AND is_visible GROUP BY asset_id HAVING count(DISTINCT person_id) = 2),
t AS (SELECT asset_id FROM tag_asset JOIN closure ON descendant = tag_id WHERE ancestor IN (0, 1, 2) GROUP BY asset_id HAVING count(DISTINCT ancestor) >= 1) SELECT 'people' AS kind, asset_id FROM p UNION ALL SELECT 'tags', asset_id FROM t""",
)
def flt_ids_legacy(c: Catalog) -> DataFrame:
    shown = c.face.where("deleted_at IS NULL AND is_visible").where(F.col("person_id").isin(1, 2, 4, 5, 7, 8, 10, 11, 13, 14))
    people = shown.groupBy("asset_id").agg(F.count_distinct("person_id").alias("n")).where("n = 2").select(F.lit("people").alias("kind"), "asset_id")
    tagged = c.tag_asset.join(groups.tag_closure(c.tag).where("ancestor IN (0, 1, 2)"), F.col("tag_id") == F.col("descendant"))
    tags = tagged.groupBy("asset_id").agg(F.count_distinct("ancestor").alias("n")).where("n >= 1").select(F.lit("tags").alias("kind"), "asset_id")
    return people.unionByName(tags)


@query(
    "jn_video_info",
    """SELECT id, CASE id % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' ELSE 'vp9' END AS video_codec, CASE WHEN id % 5 <> 0 THEN 'aac' END AS audio_codec, width, height, CASE orientation WHEN 6 THEN -90 WHEN 8 THEN 90 WHEN 3 THEN 180 ELSE 0 END AS rotation, duration FROM asset JOIN exif ON asset_id = id WHERE type = 'VIDEO'""",
)
def jn_video_info(c: Catalog) -> DataFrame:
    k = F.col("id")
    # stream tables: one video stream a video, an audio stream for most
    video = c.asset.where("type = 'VIDEO'").select(k.alias("asset_id"), F.struct(F.when(k % 3 == 0, "h264").when(k % 3 == 1, "hevc").otherwise("vp9").alias("codec"), "width", "height").alias("video"))
    audio = c.asset.where("type = 'VIDEO' AND id % 5 <> 0").select(k.alias("asset_id"), F.struct(F.lit("aac").alias("codec")).alias("audio"))
    turn = F.when(F.col("orientation") == 6, -90).when(F.col("orientation") == 8, 90).when(F.col("orientation") == 3, 180).otherwise(0)
    rows = c.asset.select(k.alias("asset_id"), "duration").join(video, "asset_id").join(audio, "asset_id", "left").join(c.exif.select("asset_id", "orientation"), "asset_id")
    return rows.select(F.col("asset_id").alias("id"), F.col("video.codec").alias("video_codec"), F.col("audio.codec").alias("audio_codec"), "video.width", "video.height", turn.alias("rotation"), "duration")


@query(
    "grp_pair_plan",
    f"""WITH {PAIRS}, p AS (SELECT owner_id, stem, jpg, raw FROM g WHERE second IS NOT NULL AND j = 1 AND r = 1)
SELECT p.owner_id, stem, jpg, raw, CASE WHEN a.is_external <> b.is_external THEN 'SCOPE_MISMATCH' WHEN a.stack_id IS NOT NULL OR b.stack_id IS NOT NULL THEN 'CURRENT_STACK_BLOCKER' WHEN a.deleted_at IS NOT NULL OR b.deleted_at IS NOT NULL OR a.is_offline OR b.is_offline THEN 'ASSET_NOT_HEALTHY' WHEN a.local_date_time <> b.local_date_time THEN 'TIME_EVIDENCE_MISMATCH' ELSE 'PLANNED' END AS outcome
FROM p JOIN asset a ON a.id = jpg JOIN asset b ON b.id = raw""",
)
def grp_pair_plan(c: Catalog) -> DataFrame:
    pairs = groups.pair_jpg_raw(pair_input(c)).where("status = 'CANDIDATE'")
    return groups.stack_plan(pairs, c.asset.select("id", F.col("is_external").alias("scope"), "stack_id", F.col("deleted_at").isNotNull().alias("is_trashed"), "is_offline", F.col("local_date_time").alias("second"))).select("owner_id", "stem", "jpg", "raw", "outcome")


DETAILS = """d AS (SELECT o.*, CASE WHEN o.id % 17 = 3 THEN NULL WHEN o.id % 13 = 5 THEN 'FAILURE' ELSE 'SUCCESS' END AS status, CASE WHEN o.id % 26 = 5 THEN 'TIMEOUT' END AS reason FROM o),
w AS (SELECT *, CASE WHEN status IS NULL THEN 'DETAIL_UNSCHEDULED' WHEN status <> 'SUCCESS' THEN coalesce(reason, 'DETAIL_FAILURE') WHEN second IS NULL THEN 'DETAIL_GROUP_TIME_UNPROVEN' END AS why FROM d),
z AS (SELECT owner_id, stem, count(*) AS assets, count(why) AS open FROM w GROUP BY ALL),
full_ AS (SELECT owner_id, stem, second, count_if(role = 'JPG') AS j, count_if(role = 'RAW') AS r, min(CASE WHEN role = 'JPG' THEN id END) AS jpg, min(CASE WHEN role = 'RAW' THEN id END) AS raw FROM d JOIN z USING (owner_id, stem) WHERE z.open = 0 GROUP BY ALL),
cand AS (SELECT f.*, CASE WHEN a.is_external <> b.is_external THEN 'SCOPE_MISMATCH' WHEN a.stack_id IS NOT NULL OR b.stack_id IS NOT NULL THEN 'CURRENT_STACK_BLOCKER' WHEN a.deleted_at IS NOT NULL OR b.deleted_at IS NOT NULL OR a.is_offline OR b.is_offline THEN 'ASSET_NOT_HEALTHY' ELSE 'PLANNED' END AS outcome FROM full_ f JOIN asset a ON a.id = f.jpg JOIN asset b ON b.id = f.raw WHERE j = 1 AND r = 1),
plan AS (SELECT owner_id, stem, jpg, raw, second, sha256(concat_ws('|', owner_id, stem, jpg, raw)) AS pair_id FROM cand WHERE outcome = 'PLANNED'),
out_ AS (SELECT owner_id, stem, CASE WHEN j > 1 OR r > 1 THEN 'AMBIGUOUS' ELSE 'REJECTED' END AS status, concat_ws(',', CASE WHEN j > 1 THEN 'DUPLICATE_JPG' END, CASE WHEN r > 1 THEN 'DUPLICATE_RAW' END, CASE WHEN j = 0 THEN 'MISSING_JPG' END, CASE WHEN r = 0 THEN 'MISSING_RAW' END) AS reasons FROM full_ WHERE NOT (j = 1 AND r = 1)
  UNION ALL SELECT owner_id, stem, 'UNVERIFIED', string_agg(DISTINCT why, ',' ORDER BY why) FROM (SELECT owner_id, stem, why FROM w WHERE why IS NOT NULL UNION ALL SELECT owner_id, stem, 'DETAIL_GROUP_INCOMPLETE' FROM z WHERE open > 0) GROUP BY ALL
  UNION ALL SELECT owner_id, stem, 'REJECTED', outcome FROM cand WHERE outcome <> 'PLANNED')"""


def write_plan(c: Catalog) -> dict[str, DataFrame]:
    k = F.col("id")
    taken = pair_input(c).where("endswith(name, '.jpg') OR endswith(name, '.raw')")
    more = c.asset.select("id", F.col("is_external").alias("scope"), "stack_id", F.col("deleted_at").isNotNull().alias("is_trashed"), "is_offline")
    status = F.when(k % 17 == 3, None).when(k % 13 == 5, "FAILURE").otherwise("SUCCESS")
    return groups.write_plan(taken.join(more, "id").withColumns({"status": status, "reason": F.when(k % 26 == 5, "TIMEOUT")}))


@query(
    "grp_write_plan",
    f"""WITH {PAIRS}, {DETAILS}
SELECT 'plan' AS kind, owner_id, stem, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY stem, pair_id) AS INTEGER) AS position, jpg, raw, NULL AS status, NULL AS reasons, 2::BIGINT AS assets FROM plan
UNION ALL SELECT 'excluded', owner_id, stem, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY stem, status, reasons) AS INTEGER), NULL, NULL, status, reasons, assets FROM out_ JOIN z USING (owner_id, stem)""",
)
def grp_write_plan(c: Catalog) -> DataFrame:
    found = write_plan(c)
    none = lambda kind: F.lit(None).cast(kind)
    plan = found["plan"].select(F.lit("plan").alias("kind"), "owner_id", "stem", "position", "jpg", "raw", none("string").alias("status"), none("string").alias("reasons"), F.lit(2).cast("long").alias("assets"))
    excluded = found["excluded"].select(F.lit("excluded").alias("kind"), "owner_id", "stem", "position", none("long").alias("jpg"), none("long").alias("raw"), "status", "reasons", "assets")
    return plan.unionByName(excluded)


@query(
    "fn_plan_digest",
    f"""WITH {PAIRS}, {DETAILS}, h AS (SELECT sha256(concat_ws(chr(31), coalesce(CAST(owner_id AS VARCHAR), '\u2400'), stem, CAST(jpg AS VARCHAR), CAST(raw AS VARCHAR), CAST(second AS VARCHAR), pair_id)) AS h FROM plan),
a AS (SELECT substr(h, 1, 4) AS k, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY ALL), b AS (SELECT substr(k, 1, 2) AS j, sum(n) AS n, sha256(string_agg(k || h, '' ORDER BY k || h)) AS h FROM a GROUP BY ALL)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, sha256(coalesce(string_agg(j || h, '' ORDER BY j || h), '')) AS digest FROM b""",
)
def fn_plan_digest(c: Catalog) -> DataFrame:
    return groups.plan_digest(write_plan(c)["plan"], ["owner_id", "stem", "jpg", "raw", "second", "pair_id"])


@query(
    "fn_dates",
    """WITH r AS (SELECT *, CASE WHEN id % 4 <> 0 AND id % 5 = 1 THEN 60 ELSE 0 END AS own, CASE id % 4 WHEN 1 THEN 120 WHEN 2 THEN -330 WHEN 3 THEN 540 ELSE 0 END AS shift, least(file_created_at, file_modified_at, CASE WHEN id % 3 = 1 THEN file_created_at - INTERVAL 1 HOUR END) AS earliest FROM asset)
SELECT id, CASE id % 4 WHEN 1 THEN 'UTC+2' WHEN 2 THEN '-05:30' WHEN 3 THEN 'Asia/Tokyo' ELSE CASE WHEN id % 7 <> 2 THEN 'UTC+0' END END AS zone,
strftime(CASE WHEN id % 7 = 2 THEN earliest ELSE file_created_at + to_minutes(CAST(-own AS INTEGER)) END, '%Y-%m-%d %H:%M:%S') AS original, strftime(CASE WHEN id % 7 = 2 THEN earliest ELSE file_created_at + to_minutes(CAST(shift - own AS INTEGER)) END, '%Y-%m-%d %H:%M:%S') AS local FROM r""",
)
def fn_dates(c: Catalog) -> DataFrame:
    k = F.col("id")
    zone = F.when(k % 4 == 1, "UTC+2").when(k % 4 == 2, "-05:30").when(k % 4 == 3, "Asia/Tokyo")
    raw = F.concat(F.date_format("file_created_at", "yyyy:MM:dd HH:mm:ss"), F.when(k % 4 == 0, F.when(k % 8 == 0, "Z").otherwise("+00:00")).when(k % 5 == 1, "+01:00").otherwise(""))
    birth = F.when(k % 3 == 1, F.timestamp_add("HOUR", F.lit(-1), F.col("file_created_at")))
    rows = c.asset.select("id", zone.alias("zone"), F.when(k % 7 != 2, raw).alias("raw"), "file_created_at", "file_modified_at", birth.alias("birth"))
    found = rows.select("id", scalar.taken_dates(*map(F.col, ("raw", "zone", "file_created_at", "file_modified_at", "birth"))).alias("d"))
    return found.select("id", "d.zone", *(F.date_format(f"d.{x}", "yyyy-MM-dd HH:mm:ss").alias(x) for x in ("original", "local")))


@query(
    "fn_trgm",
    f"WITH {similar_sql("SELECT 'ring blue' AS needle, id, 0 AS c, name AS t FROM album")}, t AS (SELECT id, {trigrams_sql('name')} AS g, {trigrams_sql(repr('ring blue'))} AS n FROM album) SELECT id, round(word, 6) AS word, round(strict, 6) AS strict, round(CAST(len(list_intersect(n, g)) AS DOUBLE) / len(list_distinct(list_concat(n, g))), 6) AS whole FROM t JOIN sims USING (id)",
)
def fn_trgm(c: Catalog) -> DataFrame:
    found = c.album.select("id", similarity.similarities(F.lit("ring blue"), F.col("name")).alias("s"), scalar.similarity(scalar.trigrams(F.lit("ring blue")), scalar.trigrams(F.col("name"))).alias("whole"))
    return found.select("id", F.round("s.word", 6).alias("word"), F.round("s.strict", 6).alias("strict"), F.round("whole", 6).alias("whole"))


@query("fn_checksum", "SELECT id, sha1(CAST(id AS STRING)) AS hex FROM asset")
def fn_checksum(c: Catalog) -> DataFrame:
    digest = F.sha1(F.col("id").cast("string").cast("binary"))
    given = c.asset.select("id", F.when(F.col("id") % 2 == 0, digest).otherwise(F.base64(F.unhex(digest))).alias("given"))
    return given.select("id", scalar.checksum_hex(F.col("given")).alias("hex"))


@query("fn_duration", "SELECT id, CAST(floor(duration / 7.0::DOUBLE * 1000 + 0.5) AS INTEGER) AS ms FROM asset")
def fn_duration(c: Catalog) -> DataFrame:
    return c.asset.select("id", scalar.duration_ms(F.col("duration") / F.lit(7.0)).alias("ms"))


@query("fn_autostack", "SELECT id, CASE WHEN id % 5 = 0 THEN 'burst' || id WHEN id % 5 = 1 THEN 'uuid' || id WHEN id % 5 = 2 THEN 'camera' || id WHEN id % 5 = 3 THEN 'media' || id END AS auto_stack_id FROM asset")
def fn_autostack(c: Catalog) -> DataFrame:
    tags = c.asset.select("id", *(F.when(F.col("id") % 5 == r, F.concat(F.lit(n), F.col("id").cast("string"))).alias(n) for r, n in enumerate(("burst", "uuid", "camera", "media"))))
    return tags.select("id", scalar.auto_stack_id(*map(F.col, ("burst", "uuid", "camera", "media"))).alias("auto_stack_id"))


@query("fn_orient", "SELECT id, CASE WHEN orientation IN (5, 6, 7, 8) THEN height ELSE width END AS width, CASE WHEN orientation IN (5, 6, 7, 8) THEN width ELSE height END AS height FROM asset JOIN exif ON asset_id = id")
def fn_orient(c: Catalog) -> DataFrame:
    rows = c.asset.select("id", "width", "height").join(c.exif.select(F.col("asset_id").alias("id"), "orientation"), "id")
    turned = scalar.sideways(F.col("orientation"))
    return rows.select("id", F.when(turned, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(turned, F.col("width")).otherwise(F.col("height")).alias("height"))


@query("udf_registry", "SELECT id, strip_accents(city) AS city, CASE WHEN coalesce(width, 0) <> 0 AND coalesce(height, 0) <> 0 THEN CAST(floor(CAST(width AS DOUBLE) / height * 1000 + 0.5) / 1000 AS DOUBLE) ELSE 1.0::DOUBLE END AS ratio FROM asset JOIN exif ON asset_id = id")
def udf_registry(c: Catalog) -> DataFrame:
    names.register(c.spark)
    return c.spark.sql("SELECT id, pl_unaccent(city) AS city, pl_ratio(width, height) AS ratio FROM {asset} JOIN {exif} ON asset_id = id", asset=c.asset, exif=c.exif)


@query("udf_plugins", "SELECT id, 'archive' AS visibility, true AS is_favorite FROM asset JOIN exif ON asset_id = id WHERE starts_with(original_file_name, 'IMG_00') AND type IN ('IMAGE') AND coalesce(contains(lower(lens_model), 'lens 3'), false)")
def udf_plugins(c: Catalog) -> DataFrame:
    passes, changes = names.steps([("match_name", {"value": "IMG_00", "kind": "startsWith", "case_sensitive": True}), ("type_in", {"types": ["IMAGE"]}), ("match_field", {"field": "lens_model", "value": "Lens 3"}), ("archive", {}), ("favorite", {})])
    rows = c.asset.join(c.exif.withColumnRenamed("asset_id", "id"), "id").where(passes)
    return rows.select("id", *(v.alias(k) for k, v in changes.items()))


@query("udaf_merge", "SELECT duplicate_id, bool_or(is_favorite) AS is_favorite, max(coalesce(rating, 0)) AS rating, count(*) AS n FROM asset JOIN exif ON asset_id = id WHERE duplicate_id IS NOT NULL GROUP BY ALL")
def udaf_merge(c: Catalog) -> DataFrame:
    rows = c.asset.where("duplicate_id IS NOT NULL").join(c.exif.select(F.col("asset_id").alias("id"), "rating"), "id")
    return rows.groupBy("duplicate_id").agg(F.bool_or("is_favorite").alias("is_favorite"), F.max(F.coalesce("rating", F.lit(0))).alias("rating"), F.count("*").alias("n"))


@query("udtf_tokens", "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\\s]+')) AS token FROM documents) GROUP BY ALL")
def udtf_tokens(c: Catalog) -> DataFrame:
    return c.documents.select(F.explode(scalar.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(
    "flt_bbox_circle",
    """WITH p AS (SELECT asset_id, latitude, longitude, 6378168.0 * cos(radians(latitude)) * cos(radians(longitude)) AS x, 6378168.0 * cos(radians(latitude)) * sin(radians(longitude)) AS y, 6378168.0 * sin(radians(latitude)) AS z FROM exif WHERE latitude IS NOT NULL)
SELECT asset_id FROM p WHERE latitude BETWEEN 10 AND 20 AND longitude BETWEEN 30 AND 50 AND abs(x - 6378168.0 * cos(radians(15)) * cos(radians(40))) <= 1000000 AND abs(y - 6378168.0 * cos(radians(15)) * sin(radians(40))) <= 1000000 AND abs(z - 6378168.0 * sin(radians(15))) <= 1000000""",
)
def flt_bbox_circle(c: Catalog) -> DataFrame:
    return c.exif.where("latitude IS NOT NULL").where(filters.in_bbox(30, 10, 50, 20)).where(filters.in_cube(15, 40, 1_000_000)).select("asset_id")
