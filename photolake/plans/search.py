"""Queries of filters, search and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions import scalar
from photolake.operators import bitmaps, filters, names, search, timeline
from photolake.plans.catalog import Catalog
from photolake.plans.registry import query

WIDE = """WITH w AS (SELECT a.*, e.* EXCLUDE (asset_id),
  a.id IN (SELECT asset_id FROM album_asset) AS has_albums, a.id IN (SELECT asset_id FROM face WHERE person_id IS NOT NULL AND is_visible AND deleted_at IS NULL) AS has_people,
  a.id IN (SELECT asset_id FROM tag_asset) AS has_tags, a.id IN (SELECT asset_id FROM asset_file WHERE type = 'encoded_video') AS is_encoded
  FROM asset a LEFT JOIN exif e ON e.asset_id = a.id) """


def wide(c: Catalog) -> DataFrame:
    return search.wide(c.asset, c.exif, c.album_asset, c.face, c.tag_asset, c.asset_file)


@query("flt_compare", "SELECT id FROM asset JOIN exif ON asset_id = id WHERE iso >= 400 AND iso < 2000 AND rating IN (3, 4) AND make <> 'Canon' AND model NOT IN ('M-1', 'M-2') AND state IS NULL AND city IS NOT NULL")
def flt_compare(c: Catalog) -> DataFrame:
    rows = c.asset.join(c.exif.withColumnRenamed("asset_id", "id"), "id")
    tests = (("iso", {"gte": 400, "lt": 2000}), ("rating", {"isin": [3, 4]}), ("make", {"ne": "Canon"}), ("model", {"not_in": ["M-1", "M-2"]}), ("state", {"eq": None}), ("city", {"ne": None}))
    for name, ops in tests:
        rows = rows.where(filters.compare(F.col(name), **ops))
    return rows.select("id")


@query("flt_pattern", "SELECT asset_id FROM exif WHERE lower(strip_accents(city)) LIKE '%munster 1%' AND lower(strip_accents(description)) NOT LIKE '%trip 2%'")
def flt_pattern(c: Catalog) -> DataFrame:
    return c.exif.where(filters.pattern(F.col("city"), like="MÜNSTER 1")).where(filters.pattern(F.col("description"), not_like="TRIP 2")).select("asset_id")


@query("flt_exists", WIDE + "SELECT id FROM w WHERE has_albums AND NOT has_people AND NOT has_tags")
def flt_exists(c: Catalog) -> DataFrame:
    rows = filters.having(c.asset, c.album_asset)
    rows = filters.having(rows, c.face.where("person_id IS NOT NULL AND is_visible AND deleted_at IS NULL"), wanted=False)
    return filters.having(rows, c.tag_asset, wanted=False).select("id")


@query(
    "flt_ids",
    """SELECT id FROM asset WHERE id IN (SELECT asset_id FROM face WHERE person_id IN (1, 2, 3, 4, 5, 6, 7, 8))
AND id NOT IN (SELECT asset_id FROM album_asset WHERE album_id IN (10, 11, 12))""",
)
def flt_ids(c: Catalog) -> DataFrame:
    rows = filters.with_ids(c.asset, c.face, "person_id", any_of=[1, 2, 3, 4, 5, 6, 7, 8, 8])
    return filters.with_ids(rows, c.album_asset, "album_id", none_of=[10, 11, 12]).select("id")


@query("flt_ids_all", "SELECT p.asset_id AS id FROM album_asset p JOIN asset ON id = p.asset_id WHERE album_id IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 2) GROUP BY ALL HAVING count(DISTINCT album_id) >= 1 AND count(DISTINCT album_id) = (SELECT count(DISTINCT album_id) FROM album_asset WHERE asset_id = 2)")
def flt_ids_all(c: Catalog) -> DataFrame:
    # all albums of one asset, which is a bounded list
    ids = [r.album_id for r in c.album_asset.where("asset_id = 2").distinct().collect()]
    return filters.with_ids(c.asset, c.album_asset, "album_id", all_of=ids).select("id")


TREE = {
    "visibility": {"isin": ["archive", "timeline"]}, "taken": {"lt": "2000-01-01"},
    "or": [{"rating": {"gte": 4}, "has_albums": {"eq": True}}, {"make": {"eq": None}, "has_people": {"eq": False}}, {"city": {"like": "münster"}, "favorite": {"eq": True}}],
}
TREE_SQL = """visibility IN ('archive', 'timeline') AND local_date_time < TIMESTAMP '2000-01-01' AND ((rating >= 4 AND has_albums) OR (make IS NULL AND NOT has_people) OR (lower(strip_accents(city)) LIKE '%munster%' AND is_favorite))"""


@query("flt_tree", WIDE + f"SELECT id, owner_id FROM w WHERE {TREE_SQL}")
def flt_tree(c: Catalog) -> DataFrame:
    return wide(c).where(search.condition(TREE)).select("id", "owner_id")


#: Ids of people, tags and albums, exists tests, patterns and texts, in branches within branches.
IDS_TREE = {
    "visibility": {"in": ["archive", "timeline"]}, "trashedAt": {"eq": None}, "takenAt": {"gte": "1993-01-01"},
    "or": [
        {"albumIds": {"any": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89], "none": [4, 6]}, "rating": {"gte": 2}},
        {"tagIds": {"all": [1, 101]}, "isFavorite": {"eq": False}},
        {"personIds": {"any": [1, 2, 3, 4, 6], "none": [7]}, "or": [{"hasTags": {"eq": True}}, {"hasAlbums": {"eq": False}, "isEncoded": {"eq": False}}, {"originalFileName": {"startsWith": "img_00", "notLike": "raw"}}]},
        {"encodedVideoPath": {"in": ["/encoded/57.mp4", "/encoded/117.mp4", "/encoded/387.mp4"]}},
        {"ocr": {"matches": "hotel munster"}, "country": {"ne": None}, "or": [{"isMotion": {"eq": True}}, {"libraryId": {"eq": None}, "hasPeople": {"eq": False}}]},
    ],
}
IDS_TREE_SQL = """visibility IN ('archive', 'timeline') AND deleted_at IS NULL AND file_created_at >= TIMESTAMP '1993-01-01' AND (
  (id IN (SELECT asset_id FROM album_asset WHERE album_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)) AND id NOT IN (SELECT asset_id FROM album_asset WHERE album_id IN (4, 6)) AND rating >= 2)
  OR (id IN (SELECT asset_id FROM below WHERE ancestor IN (1, 101) GROUP BY asset_id HAVING count(DISTINCT ancestor) = 2) AND NOT is_favorite)
  OR (id IN (SELECT asset_id FROM shown WHERE person_id IN (1, 2, 3, 4, 6)) AND id NOT IN (SELECT asset_id FROM shown WHERE person_id = 7) AND (id IN (SELECT asset_id FROM tag_asset) OR (id NOT IN (SELECT asset_id FROM album_asset) AND id NOT IN (SELECT asset_id FROM asset_file WHERE type = 'encoded_video')) OR (lower(strip_accents(original_file_name)) LIKE 'img_00%' AND lower(strip_accents(original_file_name)) NOT LIKE '%raw%')))
  OR id IN (SELECT asset_id FROM asset_file WHERE type = 'encoded_video' AND path IN ('/encoded/57.mp4', '/encoded/117.mp4', '/encoded/387.mp4'))
  OR (id IN (SELECT id FROM sims WHERE strict >= 0.5) AND country IS NOT NULL AND (live_photo_video_id IS NOT NULL OR (library_id IS NULL AND id NOT IN (SELECT asset_id FROM shown)))))"""


def bitmap_tables(c: Catalog) -> bitmaps.Tables:
    return bitmaps.Tables(c.asset, c.exif, c.asset_file, c.ocr_text, bitmaps.postings(c.album_asset, c.face, c.tag, c.tag_asset, c.asset_file))


def ids_tree_sql(what: str) -> str:
    tags = "below AS (SELECT x.asset_id, a.id AS ancestor FROM tag_asset x JOIN tag t ON t.id = x.tag_id JOIN tag a ON a.value = t.value OR starts_with(t.value, a.value || '/')), shown AS (SELECT asset_id, person_id FROM face WHERE is_visible AND deleted_at IS NULL)"
    texts = similar_sql("SELECT 'hotel munster' AS needle, asset_id AS id, 0 AS c, text AS t FROM ocr_text")
    return f"WITH {texts}, {tags}, w AS (SELECT a.*, e.* EXCLUDE (asset_id) FROM asset a LEFT JOIN exif e ON e.asset_id = a.id) SELECT {what} FROM w WHERE {IDS_TREE_SQL}"


@query("agg_search_stats", WIDE + f"SELECT owner_id, count(*) AS total FROM w WHERE {TREE_SQL} GROUP BY ALL")
def agg_search_stats(c: Catalog) -> DataFrame:
    return wide(c).where(search.condition(TREE)).groupBy("owner_id").agg(F.count("*").alias("total"))


@query("flt_legacy", "SELECT id FROM asset JOIN exif ON asset_id = id WHERE local_date_time >= TIMESTAMP '1996-01-01' AND local_date_time <= TIMESTAMP '1999-06-30' AND city = 'City 26' AND stack_id IS NULL AND deleted_at IS NULL AND live_photo_video_id IS NULL AND id NOT IN (SELECT asset_id FROM album_asset WHERE album_id < 500)")
def flt_legacy(c: Catalog) -> DataFrame:
    rows = c.asset.join(c.exif.withColumnRenamed("asset_id", "id"), "id")
    rows = rows.where(filters.compare(F.col("local_date_time"), gte="1996-01-01", lte="1999-06-30")).where("city = 'City 26' AND stack_id IS NULL AND deleted_at IS NULL AND live_photo_video_id IS NULL")
    return filters.having(rows, c.album_asset.where("album_id < 500"), wanted=False).select("id")


@query("flt_bbox", "SELECT asset_id FROM exif WHERE latitude BETWEEN -20 AND 40 AND (longitude >= 150 OR longitude <= -140)")
def flt_bbox(c: Catalog) -> DataFrame:
    return c.exif.where(filters.in_bbox(150, -20, -140, 40)).select("asset_id")


@query("flt_folder", "SELECT id, regexp_replace(original_path, '^.*/', '') AS base FROM asset WHERE original_path LIKE '%1997/raw/%' AND original_path NOT LIKE '%1997/raw/%/%'")
def flt_folder(c: Catalog) -> DataFrame:
    return filters.in_folder(c.asset, "1997/raw").select("id", scalar.base_name(F.col("original_path")).alias("base"))


@query("flt_glob", "SELECT id FROM asset WHERE original_path LIKE '%/raw/%.mp_'")
def flt_glob(c: Catalog) -> DataFrame:
    return c.asset.where(F.col("original_path").like(scalar.glob_to_like("**/raw/*.mp?"))).select("id")


@query(
    "flt_offline",
    """SELECT id FROM asset a WHERE is_external AND NOT is_offline AND library_id IS NOT NULL AND (original_path LIKE '%/raw/%' OR NOT EXISTS (SELECT 1 FROM library l WHERE l.id = a.library_id AND starts_with(a.original_path, '/data/' || l.owner_id || '/199')))""",
)
def flt_offline(c: Catalog) -> DataFrame:
    roots = c.library.select(F.col("id").alias("library_id"), F.concat(F.lit("/data/"), F.col("owner_id").cast("string"), F.lit("/199")).alias("root"))
    return filters.detect_offline(c.asset, roots, ["**/raw/**"]).select("id")


@query("flt_value_match", "SELECT asset_id FROM exif WHERE coalesce(contains(lower(lens_model), 'lens 3'), false) AND coalesce(regexp_matches(model, '(?i)^m-1\\d?$'), false)")
def flt_value_match(c: Catalog) -> DataFrame:
    return c.exif.where(filters.match_value(F.col("lens_model"), "LENS 3")).where(filters.match_value(F.col("model"), r"^m-1\d?$", "regex")).select("asset_id")


@query(
    "flt_location",
    "SELECT asset_id FROM exif WHERE 12742.0 * asin(sqrt(least(1.0, pow(sin(radians(48.1 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(48.1)) * pow(sin(radians(11.6 - longitude) / 2), 2)))) <= 2500",
)
def flt_location(c: Catalog) -> DataFrame:
    return c.exif.where(filters.near(48.1, 11.6, 2500)).select("asset_id")


@query(
    "flt_location_named",
    "SELECT asset_id FROM exif WHERE country = 'NATION_7' OR (country = 'NATION_3' AND state = 'State 8') OR (country = 'NATION_11' AND city IS NOT NULL AND 12742.0 * asin(sqrt(least(1.0, pow(sin(radians(48.1 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(48.1)) * pow(sin(radians(11.6 - longitude) / 2), 2)))) <= 5000)",
)
def flt_location_named(c: Catalog) -> DataFrame:
    near = filters.located(country="NATION_11", latitude=48.1, longitude=11.6, radius_km=5000) & F.col("city").isNotNull()
    return c.exif.where(filters.located(country="NATION_7") | filters.located(country="NATION_3", state="State 8") | near).select("asset_id")


@query("flt_date_window", "SELECT id FROM asset WHERE month(local_date_time) * 100 + day(local_date_time) >= 1224 OR month(local_date_time) * 100 + day(local_date_time) <= 106")
def flt_date_window(c: Catalog) -> DataFrame:
    return c.asset.where(filters.in_date_window(F.col("local_date_time"), "2020-12-24", "2021-01-06", recurring=True)).select("id")


@query("flt_type_tz", "SELECT id FROM asset JOIN exif ON asset_id = id WHERE type IN ('VIDEO', 'OTHER') AND time_zone IS NULL")
def flt_type_tz(c: Catalog) -> DataFrame:
    return c.asset.where(F.col("type").isin("VIDEO", "OTHER")).join(c.exif.where("time_zone IS NULL").select(F.col("asset_id").alias("id")), "id").select("id")


BACKLOG = """SELECT 'thumbnails' AS job, id FROM asset a WHERE deleted_at IS NULL AND visibility <> 'hidden' AND (thumbhash IS NULL OR NOT EXISTS (SELECT 1 FROM asset_file f WHERE f.asset_id = a.id AND f.type = 'preview') OR NOT EXISTS (SELECT 1 FROM asset_file f WHERE f.asset_id = a.id AND f.type = 'thumbnail'))
UNION ALL SELECT 'metadata', id FROM asset a WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM job_status j WHERE j.asset_id = a.id AND metadata_at IS NOT NULL)
UNION ALL SELECT 'faces', id FROM asset a WHERE deleted_at IS NULL AND visibility <> 'hidden' AND NOT EXISTS (SELECT 1 FROM job_status j WHERE j.asset_id = a.id AND faces_at IS NOT NULL)
UNION ALL SELECT 'ocr', id FROM asset a WHERE deleted_at IS NULL AND visibility <> 'hidden' AND NOT EXISTS (SELECT 1 FROM job_status j WHERE j.asset_id = a.id AND ocr_at IS NOT NULL)
UNION ALL SELECT 'duplicates', id FROM asset a WHERE deleted_at IS NULL AND visibility IN ('archive', 'timeline') AND stack_id IS NULL AND NOT EXISTS (SELECT 1 FROM job_status j WHERE j.asset_id = a.id AND duplicates_at IS NOT NULL)
UNION ALL SELECT 'video', id FROM asset a WHERE deleted_at IS NULL AND type = 'VIDEO' AND visibility <> 'hidden' AND NOT EXISTS (SELECT 1 FROM asset_file f WHERE f.asset_id = a.id AND f.type = 'encoded_video')
UNION ALL SELECT 'sidecar', id FROM asset a WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM asset_file f WHERE f.asset_id = a.id AND f.type = 'sidecar')"""


@query("flt_backlog", BACKLOG)
def flt_backlog(c: Catalog) -> DataFrame:
    out = None
    for job in ("thumbnails", "metadata", "faces", "ocr", "duplicates", "video", "sidecar"):
        rows = filters.pending(c.asset, c.job_status, c.asset_file, job).select(F.lit(job).alias("job"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


STREAMS = "id, CASE id % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' ELSE 'vp9' END AS video_codec, CASE WHEN id % 4 = 0 THEN 'yuv422p' ELSE 'yuv420p' END AS pixel_format, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'opus' ELSE 'aac' END AS audio_codec, 640 + id % 2000 AS width, 480 + id % 900 AS height, id % 30000 AS bitrate"


FORMATS = "CASE id % 6 WHEN 0 THEN 'mp4' WHEN 1 THEN 'avi' WHEN 2 THEN 'matroska,webm' WHEN 3 THEN 'mov,mp4' WHEN 4 THEN 'ogg' END AS format_name, CASE id % 6 WHEN 2 THEN 'Matroska / WebM' WHEN 3 THEN 'QuickTime / MOV' WHEN 1 THEN 'AVI (Audio Video Interleaved)' END AS format_long_name"


@query(
    "flt_transcode",
    f"""WITH v AS (SELECT {STREAMS}, {FORMATS} FROM asset WHERE type = 'VIDEO'), d AS (SELECT *, NOT video_codec IN ('h264', 'hevc') OR NOT ends_with(pixel_format, '420p') OR least(width, height) > 720 AS video, coalesce(audio_codec NOT IN ('aac'), false) AS audio,
  CASE format_long_name WHEN 'QuickTime / MOV' THEN 'mov' WHEN 'Matroska / WebM' THEN 'webm' ELSE coalesce(format_name, '') END AS container FROM v)
SELECT id, CASE WHEN video AND audio THEN 'all' WHEN video THEN 'video' WHEN audio THEN 'audio' ELSE 'none' END AS target, container NOT IN ('mp4', 'mov', 'ogg') AS remux FROM d""",
)
def flt_transcode(c: Catalog) -> DataFrame:
    videos = c.asset.where("type = 'VIDEO'").selectExpr(*_split(STREAMS), *_split(FORMATS))
    return videos.select("id", filters.transcode_target("optimal", ("h264", "hevc")).alias("target"), filters.remux_required("optimal", ("mov", "ogg")).alias("remux"))


def _split(select: str) -> list[str]:
    import re

    return re.split(r", (?=CASE|\d|id)", select)


@query("flt_memory_active", "SELECT id, owner_id FROM memories WHERE NOT is_trashed AND (show_at IS NULL OR show_at <= TIMESTAMP '1998-05-05') AND (hide_at IS NULL OR hide_at >= TIMESTAMP '1998-05-05')")
def flt_memory_active(c: Catalog) -> DataFrame:
    return c.memories.where("NOT is_trashed").where(filters.active_memories("1998-05-05")).select("id", "owner_id")


@query("jn_has_geo", "SELECT asset_id FROM exif WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)")
def jn_has_geo(c: Catalog) -> DataFrame:
    return c.exif.where("latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)").select("asset_id")


@query("top_search", WIDE + f"SELECT id, rating FROM w WHERE {TREE_SQL} ORDER BY rating DESC NULLS LAST, id DESC LIMIT 100")
def top_search(c: Catalog) -> DataFrame:
    return search.ordered(wide(c).where(search.condition(TREE)), "rating").select("id", "rating").limit(100)


@query("top_paged", "WITH o AS (SELECT id, CAST(row_number() OVER (ORDER BY file_size DESC NULLS LAST, id DESC) AS INTEGER) AS n FROM asset JOIN exif ON asset_id = id) SELECT id, CAST(n - 40 AS INTEGER) AS at, (SELECT count(*) FROM o) > 60 AS has_next FROM o WHERE n > 40 AND n <= 60")
def top_paged(c: Catalog) -> DataFrame:
    rows = c.asset.join(c.exif.select(F.col("asset_id").alias("id"), "file_size"), "id")
    return search.page(rows, 3, 20, "size").select("id", "at", "has_next")


@query("top_keyset", "SELECT id, CAST(row_number() OVER (ORDER BY id DESC) AS INTEGER) AS at, lead(id) OVER (ORDER BY id DESC) AS next FROM report WHERE type = 'missing_file' AND id <= 40000 QUALIFY row_number() OVER (ORDER BY id DESC) <= 50")
def top_keyset(c: Catalog) -> DataFrame:
    return search.keyset(c.report.where("type = 'missing_file'"), 40000, 50).select("id", "at", "next")


@query("top_large", "SELECT id, file_size FROM asset JOIN exif ON asset_id = id WHERE deleted_at IS NULL AND file_size >= 1000000 ORDER BY file_size DESC, id DESC LIMIT 250")
def top_large(c: Catalog) -> DataFrame:
    rows = c.asset.where("deleted_at IS NULL").join(c.exif.where("file_size >= 1000000").select(F.col("asset_id").alias("id"), "file_size"), "id")
    return search.ordered(rows, "size").select("id", "file_size").limit(250)


@query("top_random", "SELECT id, owner_id FROM asset WHERE deleted_at IS NULL AND visibility IN ('archive', 'timeline') ORDER BY md5('7:' || id), id LIMIT 250")
def top_random(c: Catalog) -> DataFrame:
    return search.sample(timeline.timeline_assets(c.asset), 250).select("id", "owner_id")


def trigrams_sql(text: str) -> str:
    """Distinct trigrams of a text's words in DuckDB."""
    words = f"list_filter(string_split(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def similar_sql(texts: str) -> str:
    """``sims``: word and strict similarity of each (needle, id, c, t), by all runs of the text's trigrams."""
    return f"""asked AS ({texts}),
words AS (SELECT needle, id, c, unnest(l) AS w, generate_subscripts(l, 1) AS k FROM (SELECT needle, id, c, list_filter(string_split(regexp_replace(lower(strip_accents(t)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS l FROM asked WHERE t IS NOT NULL)),
grams AS (SELECT needle, id, c, row_number() OVER (PARTITION BY needle, id, c ORDER BY k, i) AS p, substr('  ' || w || ' ', CAST(i AS INTEGER), 3) AS g, i = 1 AS first, i = length(w) + 1 AS last FROM words, LATERAL (SELECT unnest(range(1, length(w) + 2)) AS i)),
wanted AS (SELECT needle, {trigrams_sql('strip_accents(needle)')} AS n FROM (SELECT DISTINCT needle FROM asked)),
runs AS (SELECT a.needle, a.id, a.c, a.p AS i, b.p AS j, a.first AND b.last AS whole FROM grams a JOIN grams b ON a.needle = b.needle AND a.id = b.id AND a.c = b.c AND b.p >= a.p),
shares AS (SELECT r.needle, r.id, r.c, r.i, r.j, r.whole, count(DISTINCT g) AS u, count(DISTINCT CASE WHEN list_contains(n, g) THEN g END) AS shared, any_value(len(n)) AS m FROM runs r JOIN grams x ON x.needle = r.needle AND x.id = r.id AND x.c = r.c AND x.p BETWEEN r.i AND r.j JOIN wanted w ON w.needle = r.needle GROUP BY ALL),
sims AS (SELECT a.needle, a.id, a.c, CASE WHEN any_value(a.t) IS NOT NULL THEN coalesce(max(shared / (m + u - shared)), 0) END AS word, CASE WHEN any_value(a.t) IS NOT NULL THEN coalesce(max(CASE WHEN whole THEN shared / (m + u - shared) END), 0) END AS strict FROM asked a LEFT JOIN shares s ON s.needle = a.needle AND s.id = a.id AND s.c = a.c GROUP BY ALL)"""


@query("flt_tree_ids", ids_tree_sql("id"))
def flt_tree_ids(c: Catalog) -> DataFrame:
    return bitmaps.ids(bitmaps.search(bitmap_tables(c), IDS_TREE))


@query("agg_tree_count", ids_tree_sql("count(*) AS total"))
def agg_tree_count(c: Catalog) -> DataFrame:
    return bitmaps.count(bitmaps.search(bitmap_tables(c), IDS_TREE))


PLACE_NAMES = ("name", "admin2_name", "admin1_name", "alternate_names")
PLACE_NEEDLES = "SELECT concat(CASE n_nationkey % 3 WHEN 0 THEN 'Old Towm ' WHEN 1 THEN 'distrikt ' ELSE 'tówn ' END, CAST(n_nationkey * 2 AS STRING)) AS needle FROM nation"
PERSON_NEEDLES = "SELECT n_nationkey % 10 AS owner_id, concat(CASE WHEN n_nationkey % 2 = 0 THEN 'jorg ' ELSE 'Jörk ' END, CAST(n_nationkey AS STRING)) AS needle FROM nation"


@query(
    "top_places",
    "WITH " + similar_sql(" UNION ALL ".join(f"SELECT needle, id, {i} AS c, {c} AS t FROM ({PLACE_NEEDLES}), place" for i, c in enumerate(PLACE_NAMES)))
    + """, near AS (SELECT needle, id, round(sum(coalesce(1 - strict, 0.1)), 6) AS distance FROM sims GROUP BY ALL HAVING max(strict) >= 0.5)
SELECT needle, id, distance, CAST(row_number() OVER (PARTITION BY needle ORDER BY distance, id) AS INTEGER) AS rank FROM near QUALIFY row_number() OVER (PARTITION BY needle ORDER BY distance, id) <= 20""",
)
def top_places(c: Catalog) -> DataFrame:
    index = names.gram_index(c.place, list(PLACE_NAMES))
    needles = c.spark.sql(PLACE_NEEDLES.replace("FROM nation", "FROM {nation}"), nation=c.nation)
    return names.search_places(c.place, index, needles, list(PLACE_NAMES)).select("needle", "id", "distance", "rank")


@query(
    "top_person_name",
    f"WITH {similar_sql(f'SELECT DISTINCT needle, id, 0 AS c, name AS t FROM ({PERSON_NEEDLES}) n JOIN person p ON p.owner_id = n.owner_id AND NOT p.is_hidden')}"
    f""", near AS (SELECT n.owner_id, s.needle, s.id, round(1 - strict, 6) AS distance FROM sims s JOIN person p ON p.id = s.id JOIN (SELECT DISTINCT * FROM ({PERSON_NEEDLES})) n ON n.needle = s.needle AND n.owner_id = p.owner_id WHERE word >= 0.5)
SELECT owner_id, needle, id, distance, CAST(row_number() OVER (PARTITION BY owner_id, needle ORDER BY distance, id) AS INTEGER) AS rank FROM near QUALIFY row_number() OVER (PARTITION BY owner_id, needle ORDER BY distance, id) <= 100""",
)
def top_person_name(c: Catalog) -> DataFrame:
    index = names.gram_index(c.person, ["name"])
    needles = c.spark.sql(PERSON_NEEDLES.replace("FROM nation", "FROM {nation}"), nation=c.nation)
    return names.search_people(c.person, index, needles).select("owner_id", "needle", "id", "distance", "rank")


@query("top_distinct_names", "SELECT owner_id, lower(name) AS name, min(id) AS id FROM person WHERE name <> '' GROUP BY ALL")
def top_distinct_names(c: Catalog) -> DataFrame:
    rows = c.person.where("name <> ''").withColumn("name", F.lower("name"))
    return timeline.first_of(rows, ["owner_id", "name"], F.col("id")).select("owner_id", "name", "id")


@query("agg_suggest", "SELECT 'city' AS field, city AS value FROM exif WHERE country = 'NATION_3' AND city <> '' GROUP BY ALL UNION ALL SELECT 'make', make FROM exif WHERE make <> '' GROUP BY ALL UNION ALL SELECT 'lens', lens_model FROM exif WHERE make = 'Canon' AND lens_model <> '' GROUP BY ALL")
def agg_suggest(c: Catalog) -> DataFrame:
    parts = (("city", c.exif.where("country = 'NATION_3'"), "city"), ("make", c.exif, "make"), ("lens", c.exif.where("make = 'Canon'"), "lens_model"))
    out = None
    for name, rows, field in parts:
        part = search.suggestions(rows, field).select(F.lit(name).alias("field"), "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("fn_tokenize", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\s]+')) AS INTEGER) AS n FROM documents")
def fn_tokenize(c: Catalog) -> DataFrame:
    return c.documents.select("doc_id", F.size(scalar.tokens(F.col("text"))).alias("n"))
