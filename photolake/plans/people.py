"""Queries of groups, duplicates, tags, stacks, pairs, places and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.operators import geo, groups, timeline, vectors
from photolake.plans.catalog import Catalog
from photolake.plans.registry import query

CLOSURE = "closure AS (SELECT a.id AS ancestor, d.id AS descendant FROM tag d JOIN tag a ON d.value = a.value OR starts_with(d.value, a.value || '/'))"


@query("grp_tags", f"WITH {CLOSURE} SELECT ancestor, descendant FROM closure")
def grp_tags(c: Catalog) -> DataFrame:
    return groups.tag_closure(c.tag)


@query("grp_tag_paths", "SELECT DISTINCT value, list_extract(string_split(value, '/'), -1) AS name, CASE WHEN contains(value, '/') THEN regexp_replace(value, '/[^/]*$', '') END AS parent FROM (SELECT value FROM tag UNION SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name FROM region)")
def grp_tag_paths(c: Catalog) -> DataFrame:
    return groups.tag_paths(c.tag)


@query("grp_tag_assets", f"WITH {CLOSURE} SELECT DISTINCT ancestor AS tag_id, asset_id FROM closure JOIN tag_asset ON tag_id = descendant")
def grp_tag_assets(c: Catalog) -> DataFrame:
    return groups.tag_closure(c.tag).join(c.tag_asset, F.col("tag_id") == F.col("descendant")).select(F.col("ancestor").alias("tag_id"), "asset_id").distinct()


@query("grp_tag_cleanup", f"WITH {CLOSURE} SELECT id, value FROM tag WHERE id NOT IN (SELECT ancestor FROM closure JOIN tag_asset ON tag_id = descendant)")
def grp_tag_cleanup(c: Catalog) -> DataFrame:
    used = groups.tag_closure(c.tag).join(c.tag_asset, F.col("tag_id") == F.col("descendant"), "left_semi").select(F.col("ancestor").alias("id"))
    return c.tag.join(used, "id", "left_anti").select("id", "value")


def dup_members(c: Catalog) -> DataFrame:
    exif = c.exif.select(F.col("asset_id").alias("id"), "file_size", groups.exif_count(c.exif).alias("fields"))
    return c.asset.where("duplicate_id IS NOT NULL AND deleted_at IS NULL").join(exif, "id").select("duplicate_id", "id", "file_size", "fields", F.col("id").alias("position"))


FIELDS = " + ".join(
    [f"CAST(coalesce({x} <> '', false) AS INTEGER)" for x in ("make", "model", "lens_model", "country", "state", "city", "description", "time_zone", "live_photo_cid", "profile_description", "colorspace")]
    + [f"CAST(coalesce({x} <> 0, false) AS INTEGER)" for x in ("f_number", "iso", "latitude", "longitude", "rating", "file_size", "orientation", "bits_per_sample")]
)


@query("win_keep", f"SELECT duplicate_id, id AS keep FROM (SELECT duplicate_id, a.id, row_number() OVER (PARTITION BY duplicate_id ORDER BY file_size DESC, {FIELDS} DESC, a.id DESC) AS r FROM asset a JOIN exif ON asset_id = a.id WHERE duplicate_id IS NOT NULL AND deleted_at IS NULL) WHERE r = 1")
def win_keep(c: Catalog) -> DataFrame:
    return groups.suggest_keep(dup_members(c))


@query(
    "grp_resolve",
    """WITH m AS (SELECT duplicate_id, a.id, CASE WHEN a.id % 25 = 0 THEN 'keep' ELSE 'trash' END AS action, is_favorite, visibility, rating, description, latitude, longitude FROM asset a JOIN exif e ON e.asset_id = a.id WHERE duplicate_id IS NOT NULL AND deleted_at IS NULL),
al AS (SELECT duplicate_id, string_agg(DISTINCT CAST(album_id AS STRING), ',' ORDER BY CAST(album_id AS STRING)) AS albums FROM m JOIN album_asset x ON x.asset_id = m.id GROUP BY ALL),
d AS (SELECT duplicate_id, description, min(id) AS first FROM m WHERE description <> '' GROUP BY ALL), t AS (SELECT duplicate_id, string_agg(description, chr(10) ORDER BY first) AS description FROM d GROUP BY ALL)
SELECT duplicate_id, CASE WHEN count_if(action = 'keep') <> 1 THEN 'one asset must be kept' WHEN count_if(action = 'trash') < 1 THEN 'nothing to trash' ELSE 'ok' END AS status, max(CASE WHEN action = 'keep' THEN m.id END) AS keeper, bool_or(is_favorite) AS is_favorite,
  list_extract(['locked', 'archive', 'timeline', 'hidden'], min(CASE visibility WHEN 'locked' THEN 1 WHEN 'archive' THEN 2 WHEN 'timeline' THEN 3 ELSE 4 END)) AS visibility, nullif(max(coalesce(rating, 0)), 0) AS rating, coalesce(any_value(t.description), '') AS description,
  CASE WHEN count(DISTINCT latitude) = 1 AND count(DISTINCT longitude) = 1 THEN max(latitude) END AS latitude, coalesce(any_value(al.albums), '') AS albums FROM m LEFT JOIN al USING (duplicate_id) LEFT JOIN t USING (duplicate_id) GROUP BY duplicate_id""",
)
def grp_resolve(c: Catalog) -> DataFrame:
    albums = c.album_asset.groupBy(F.col("asset_id").alias("id")).agg(F.collect_set("album_id").alias("albums"))
    tags = c.tag_asset.groupBy(F.col("asset_id").alias("id")).agg(F.collect_set("tag_id").alias("tags"))
    rows = c.asset.where("duplicate_id IS NOT NULL AND deleted_at IS NULL").join(c.exif.withColumnRenamed("asset_id", "id"), "id").join(albums, "id", "left").join(tags, "id", "left")
    found = groups.resolve(rows.withColumn("action", F.when(F.col("id") % 25 == 0, "keep").otherwise("trash")))
    text = F.array_join(F.array_sort(F.transform("albums", lambda x: x.cast("string"))), ",")
    return found.select("duplicate_id", "status", "keeper", "is_favorite", "visibility", "rating", "description", "latitude", text.alias("albums"))


@query(
    "grp_duplicates",
    """WITH RECURSIVE live AS (SELECT id, owner_id, checksum, duplicate_id FROM asset WHERE deleted_at IS NULL), f AS (SELECT id, min(id) OVER (PARTITION BY owner_id, checksum) AS hub FROM live WHERE checksum IS NOT NULL), g AS (SELECT id, min(id) OVER (PARTITION BY duplicate_id) AS hub FROM live WHERE duplicate_id IS NOT NULL),
e AS (SELECT id AS a, hub AS b FROM f WHERE id <> hub UNION SELECT hub, id FROM f WHERE id <> hub UNION SELECT id, hub FROM g UNION SELECT hub, id FROM g), reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a)
SELECT id, coalesce((SELECT min(l.duplicate_id) FROM c x JOIN live l ON l.id = x.id WHERE x.component = c.component), component) AS duplicate_id FROM c""",
)
def grp_duplicates(c: Catalog) -> DataFrame:
    # candidate pairs: assets of one owner with the same checksum, each linked to the first
    rows = c.asset.where("checksum IS NOT NULL AND deleted_at IS NULL")
    first = rows.groupBy("owner_id", "checksum").agg(F.min("id").alias("dst"))
    pairs = rows.join(first, ["owner_id", "checksum"]).where("id <> dst").select(F.col("id").alias("src"), "dst")
    return groups.assign_duplicates(pairs, c.asset.where("deleted_at IS NULL"))


@query(
    "grp_stacks",
    """WITH r AS (SELECT CAST(floor(id / 60) AS BIGINT) AS request, id % 60 AS position, id FROM asset WHERE id % 60 < 2), lead AS (SELECT a.id, s.primary_asset_id AS led_by FROM asset a JOIN stack s ON s.id = a.stack_id WHERE a.deleted_at IS NULL)
SELECT request, m.id, (SELECT min_by(x.id, x.position) FROM r x WHERE x.request = m.request) AS primary_id FROM (SELECT request, id FROM r UNION SELECT request, lead.id FROM r JOIN lead ON lead.led_by = r.id) m""",
)
def grp_stacks(c: Catalog) -> DataFrame:
    requests = c.asset.where("id % 60 < 2").select(F.floor(F.col("id") / 60).alias("request"), (F.col("id") % 60).alias("position"), "id")
    return groups.merge_stacks(groups.with_stack_size(c.asset, c.stack), requests).select("request", "id", "primary_id")


PAIRS = """o AS (SELECT id, CAST(floor(id / 40) AS BIGINT) AS owner_id, lower(regexp_replace(original_file_name, '\\.[^.]*$', '')) AS stem, CASE WHEN ends_with(original_file_name, '.jpg') THEN 'JPG' ELSE 'RAW' END AS role, CASE WHEN id % 7 <> 3 THEN CAST(floor((id + 1) / 2) AS BIGINT) END AS second FROM asset WHERE ends_with(original_file_name, '.jpg') OR ends_with(original_file_name, '.raw')),
g AS (SELECT owner_id, stem, second, count_if(role = 'JPG') AS j, count_if(role = 'RAW') AS r, min(CASE WHEN role = 'JPG' THEN id END) AS jpg, min(CASE WHEN role = 'RAW' THEN id END) AS raw FROM o GROUP BY ALL)"""


def pair_input(c: Catalog) -> DataFrame:
    # two neighbours are taken in the same second, forty by the same owner; some have no verified time
    k = F.col("id")
    return c.asset.select("id", F.floor(k / 40).alias("owner_id"), F.col("original_file_name").alias("name"), F.when(k % 7 != 3, F.floor((k + 1) / 2)).alias("second"))


@query(
    "grp_pairs",
    f"""WITH {PAIRS} SELECT owner_id, stem, second, CASE WHEN second IS NULL THEN 'UNVERIFIED' WHEN j = 1 AND r = 1 THEN 'CANDIDATE' WHEN j > 1 OR r > 1 THEN 'AMBIGUOUS' ELSE 'REJECTED' END AS status, CASE WHEN j = 1 THEN jpg END AS jpg, CASE WHEN r = 1 THEN raw END AS raw,
  CASE WHEN second IS NULL THEN 'TIME_UNVERIFIED' WHEN j = 1 AND r = 1 THEN 'RULES_MATCH' ELSE concat_ws(',', CASE WHEN j > 1 THEN 'DUPLICATE_JPG' END, CASE WHEN r > 1 THEN 'DUPLICATE_RAW' END, CASE WHEN j = 0 THEN 'MISSING_JPG' END, CASE WHEN r = 0 THEN 'MISSING_RAW' END) END AS reasons,
  sha256(concat_ws('|', owner_id, stem, coalesce(CAST(CASE WHEN j = 1 THEN jpg END AS STRING), ''), coalesce(CAST(CASE WHEN r = 1 THEN raw END AS STRING), ''))) AS pair_id FROM g""",
)
def grp_pairs(c: Catalog) -> DataFrame:
    return groups.pair_jpg_raw(pair_input(c))


@query("grp_pair_stems", "SELECT lower(regexp_replace(original_file_name, '\\.[^.]*$', '')) AS stem, count_if(ends_with(original_file_name, '.jpg')) AS jpgs, count_if(ends_with(original_file_name, '.raw')) AS raws, count_if(NOT ends_with(original_file_name, '.jpg') AND NOT ends_with(original_file_name, '.raw')) AS others FROM asset GROUP BY ALL HAVING jpgs > 0 AND raws > 0")
def grp_pair_stems(c: Catalog) -> DataFrame:
    from photolake.functions import scalar

    ext = scalar.extension(F.col("original_file_name"))
    rows = c.asset.groupBy(scalar.stem(F.col("original_file_name")).alias("stem")).agg(F.count_if(ext == "jpg").alias("jpgs"), F.count_if(ext == "raw").alias("raws"), F.count_if(~ext.isin("jpg", "raw")).alias("others"))
    return rows.where("jpgs > 0 AND raws > 0")


@query(
    "grp_stack_state",
    """WITH p AS (SELECT id AS jpg, id + CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN 4 ELSE 40 END AS raw FROM asset WHERE id % 10 IN (0, 1, 3)), s AS (SELECT a.id, a.stack_id, primary_asset_id AS lead, count(*) OVER (PARTITION BY a.stack_id) AS members FROM asset a LEFT JOIN stack ON stack.id = a.stack_id)
SELECT jpg, raw, CASE WHEN j.id IS NULL OR r.id IS NULL THEN 'UNKNOWN' WHEN j.stack_id IS NULL AND r.stack_id IS NULL THEN 'NO_STACK' WHEN j.stack_id IS NULL OR r.stack_id IS NULL THEN 'STACK_PARTIAL_CONFLICT' WHEN j.stack_id <> r.stack_id THEN 'STACK_SPLIT_CONFLICT' WHEN j.members > 2 THEN 'STACK_HAS_OTHER_ASSETS' WHEN j.lead = jpg THEN 'EXTERNAL_EQUIVALENT' ELSE 'EXTERNAL_PRIMARY_CONFLICT' END AS state
FROM p LEFT JOIN s j ON j.id = jpg LEFT JOIN s r ON r.id = raw""",
)
def grp_stack_state(c: Catalog) -> DataFrame:
    k = F.col("id")
    pairs = c.asset.where("id % 10 IN (0, 1, 3)").select(k.alias("jpg"), (k + F.when(k % 3 == 0, 1).when(k % 3 == 1, 4).otherwise(40)).alias("raw"))
    return groups.classify_stacks(pairs, groups.with_stack_size(c.asset, c.stack))


@query("grp_two_pass", "SELECT (SELECT count(*) FROM asset) AS first, CAST(0 AS BIGINT) AS first_repeats, (SELECT count(*) FROM asset WHERE id % 500 <> 7) AS second, CAST(0 AS BIGINT) AS second_repeats, (SELECT count(*) FROM asset WHERE id % 500 = 7) AS different, false AS stable")
def grp_two_pass(c: Catalog) -> DataFrame:
    return groups.inventory_stable(c.asset.select("id"), c.asset.where("id % 500 <> 7").select("id"))


@query("grp_people_cleanup", "SELECT id, owner_id FROM person WHERE id NOT IN (SELECT person_id FROM face WHERE person_id IS NOT NULL AND deleted_at IS NULL AND source_type = 'exif' AND asset_id % 40 = 0)")
def grp_people_cleanup(c: Catalog) -> DataFrame:
    used = c.face.where("person_id IS NOT NULL AND deleted_at IS NULL AND source_type = 'exif' AND asset_id % 40 = 0").select(F.col("person_id").alias("id"))
    return c.person.join(used, "id", "left_anti").select("id", "owner_id")


@query(
    "grp_people_merge",
    """WITH m AS (SELECT id, CAST(floor(id / 3) AS BIGINT) * 3 AS primary_id, nullif(name, '') AS name, birth_date FROM person)
SELECT primary_id AS id, coalesce((SELECT name FROM m x WHERE x.primary_id = m.primary_id AND name IS NOT NULL ORDER BY id LIMIT 1), '') AS name, (SELECT birth_date FROM m x WHERE x.primary_id = m.primary_id AND birth_date IS NOT NULL ORDER BY id LIMIT 1) AS birth_date, count(*) AS merged FROM m GROUP BY primary_id""",
)
def grp_people_merge(c: Catalog) -> DataFrame:
    rows = c.person.select("id", (F.floor(F.col("id") / 3) * 3).alias("primary_id"), F.nullif("name", F.lit("")).alias("name"), "birth_date")
    # the primary's own value, else the first of those merged into it
    first = [F.min_by(x, F.when(F.col(x).isNotNull(), F.col("id"))).alias(x) for x in ("name", "birth_date")]
    return rows.groupBy(F.col("primary_id").alias("id")).agg(*first, F.count("*").alias("merged")).select("id", F.coalesce("name", F.lit("")).alias("name"), "birth_date", "merged")


GEO = 25_000


@query(
    "jn_geocode",
    """WITH p AS (SELECT asset_id AS id, 6378168.0 * cos(radians(latitude)) * cos(radians(longitude)) AS x, 6378168.0 * cos(radians(latitude)) * sin(radians(longitude)) AS y, 6378168.0 * sin(radians(latitude)) AS z FROM exif WHERE latitude IS NOT NULL),
q AS (SELECT id AS place_id, name, admin1_name, country_code, 6378168.0 * cos(radians(latitude)) * cos(radians(longitude)) AS x, 6378168.0 * cos(radians(latitude)) * sin(radians(longitude)) AS y, 6378168.0 * sin(radians(latitude)) AS z FROM place),
h AS (SELECT 2 * 6378168.0 * sin(25000 / (2 * 6378168.0)) AS h)
SELECT id, place_id, name AS city, admin1_name AS state, country_code AS country FROM p, q, h WHERE abs(p.x - q.x) <= h AND abs(p.y - q.y) <= h AND abs(p.z - q.z) <= h
QUALIFY row_number() OVER (PARTITION BY id ORDER BY sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)), place_id) = 1""",
)
def jn_geocode(c: Catalog) -> DataFrame:
    return geo.reverse_geocode(c.exif.withColumnRenamed("asset_id", "id"), c.place, GEO)


@query(
    "jn_country",
    """SELECT asset_id AS id, min(n_name) AS country FROM exif JOIN nation ON abs(longitude - ((n_nationkey * 53) % 300 - 150)) / 22.003 + abs(latitude - ((n_nationkey * 31) % 120 - 60)) / 17.007 < 1 GROUP BY ALL""",
)
def jn_country(c: Catalog) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = (k * 53) % 300 - 150, (k * 31) % 120 - 60

    def corner(dx: float, dy: float):
        return F.struct((x + dx).cast("double").alias("lon"), (y + dy).cast("double").alias("lat"))

    polygons = c.nation.select(F.col("n_name").alias("country"), F.array(corner(-22.003, 0), corner(0, 17.007), corner(22.003, 0), corner(0, -17.007)).alias("ring"))
    return geo.countries(c.exif.where("latitude IS NOT NULL").withColumnRenamed("asset_id", "id"), polygons)


OPEN = "visibility IN ('timeline', 'archive') AND deleted_at IS NULL AND stack_id IS NULL"


def _duplicates(distance: float) -> str:
    return f"""WITH v AS (SELECT v.owner_id, a.type, v.id, v.embedding::DOUBLE[] AS e FROM vector v JOIN asset a ON a.id = v.id WHERE {OPEN}),
n AS (SELECT a.owner_id, a.id, b.id AS other, 1 - list_cosine_similarity(a.e, b.e) AS d, row_number() OVER (PARTITION BY a.id ORDER BY d, b.id) AS rank
  FROM v a JOIN v b ON a.owner_id = b.owner_id AND a.type = b.type AND a.id <> b.id)
SELECT owner_id, id, other, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 64 AND d <= {distance}"""


def duplicate_candidates(c: Catalog, distance: float) -> DataFrame:
    """The nearest 64 of each vector: same owner and type, visible, not deleted, not stacked."""
    rows = c.vector.join(c.asset.where(OPEN).select("id", "type"), "id")
    return vectors.neighbours(rows, distance, k=64, keys=("owner_id", "type")).select("owner_id", "id", "other", "rank")


@query("jn_knn_dup", _duplicates(0.7))
def jn_knn_dup(c: Catalog) -> DataFrame:
    return duplicate_candidates(c, 0.7)


@query("jn_knn_dup_default", _duplicates(0.01))
def jn_knn_dup_default(c: Catalog) -> DataFrame:
    return duplicate_candidates(c, 0.01)


@query("jn_knn_dup_index")
def jn_knn_dup_index(c: Catalog) -> DataFrame:
    """As ``jn_knn_dup``, through an index whose probes were chosen for a recall of 0.95; a search may miss some, so there is no SQL."""
    rows = c.vector.join(c.asset.where(OPEN).select("id", "type"), "id")
    index = vectors.fit_cells(rows, 0.7, 64, recall=0.95)
    return vectors.neighbours(rows, 0.7, k=64, keys=("owner_id", "type"), index=index).select("owner_id", "id", "other", "rank")


@query(
    "jn_knn_text",
    "SELECT query, id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.id AS query, b.id, row_number() OVER (PARTITION BY a.id ORDER BY 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.id) AS rank FROM vector a, vector b WHERE a.id % 50 = 0) WHERE rank <= 20",
)
def jn_knn_text(c: Catalog) -> DataFrame:
    asked = c.vector.where("id % 50 = 0")
    return vectors.nearest(asked, c.vector, 20).select("query", "id", "rank")


#: The person of a vector's face, by rule.
FACE_PERSON = "CASE WHEN v.id % 3 <> 0 THEN v.id % 97 END"


def _face_matches(distance: float, has_person: bool = False) -> str:
    return f"""WITH v AS (SELECT v.owner_id, v.id, v.embedding::DOUBLE[] AS e, CAST(a.file_created_at AS DATE) AS taken, p.birth_date, {FACE_PERSON} AS person_id
  FROM vector v JOIN asset a ON a.id = v.id LEFT JOIN person p ON p.id = {FACE_PERSON} WHERE a.deleted_at IS NULL),
n AS (SELECT a.owner_id, a.id, b.id AS other, 1 - list_cosine_similarity(a.e, b.e) AS d, row_number() OVER (PARTITION BY a.id ORDER BY d, b.id) AS rank
  FROM v a JOIN v b ON a.owner_id = b.owner_id AND (b.birth_date IS NULL OR b.birth_date <= a.taken){" WHERE b.person_id IS NOT NULL" if has_person else ""})
SELECT owner_id, id, other, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 10 AND d <= {distance}"""


def face_matches(c: Catalog, distance: float, has_person: bool = False) -> DataFrame:
    """The nearest 10 faces of each, itself included: same owner, not deleted, of nobody born after the photo; with ``has_person`` only those of a person."""
    v, p = c.vector.alias("v"), c.person.select(F.col("id").alias("person_id"), "birth_date")
    rows = v.withColumn("person_id", F.expr(FACE_PERSON)).join(p, "person_id", "left")
    rows = rows.join(c.asset.where("deleted_at IS NULL").select("id", F.to_date("file_created_at").alias("taken")), "id")
    # days as numbers, so that nulls are not a number in the tiles
    days = {x: F.datediff(x, F.lit("1970-01-01")).cast("double") for x in ("birth_date", "taken")}
    rows = rows.withColumns(days)
    if has_person:
        rows = rows.withColumn("birth_date", F.when(F.col("person_id").isNull(), F.lit(float("inf"))).otherwise(F.col("birth_date")))
    found = vectors.neighbours(rows, distance, k=10, keys=("owner_id",), with_self=True, since="birth_date", until="taken")
    return found.select("owner_id", "id", "other", "rank")


@query("jn_knn_face", _face_matches(0.65))
def jn_knn_face(c: Catalog) -> DataFrame:
    return face_matches(c, 0.65)


@query("jn_knn_face_person", _face_matches(0.65, True))
def jn_knn_face_person(c: Catalog) -> DataFrame:
    return face_matches(c, 0.65, has_person=True)


@query("jn_knn_face_default", _face_matches(0.5))
def jn_knn_face_default(c: Catalog) -> DataFrame:
    return face_matches(c, 0.5)


@query("fn_cosine", "SELECT a.id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM vector a JOIN vector b ON b.id = 0")
def fn_cosine(c: Catalog) -> DataFrame:
    return vectors.distances(c.vector.where("id = 0"), c.vector).select("id", F.round("distance", 6).alias("distance"))


def _people_of_faces(distance: float, faces: int) -> str:
    return f"""WITH RECURSIVE v AS (SELECT v.owner_id, v.id, v.embedding::DOUBLE[] AS e, a.visibility = 'timeline' AS shown FROM vector v JOIN asset a ON a.id = v.id WHERE a.deleted_at IS NULL),
n AS (SELECT a.owner_id, a.id, b.id AS other, 1 - list_cosine_similarity(a.e, b.e) AS d, a.shown FROM v a JOIN v b ON a.owner_id = b.owner_id), near AS (SELECT * FROM n WHERE d <= {distance}),
core AS (SELECT id FROM near WHERE shown GROUP BY id HAVING count(*) >= {faces}),
e AS (SELECT id AS a, other AS b FROM near WHERE id IN (SELECT id FROM core) AND other IN (SELECT id FROM core)),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), named AS (SELECT a AS id, min(b) AS person FROM reach GROUP BY a)
SELECT v.owner_id, v.id, (SELECT p.person FROM near x JOIN named p ON p.id = x.other WHERE x.id = v.id ORDER BY x.d, x.other LIMIT 1) AS person FROM v"""


def people_of_faces(c: Catalog, distance: float, faces: int) -> DataFrame:
    """Faces of photos that are not deleted; only those on the timeline make a person."""
    rows = c.vector.join(c.asset.where("deleted_at IS NULL").select("id", (F.col("visibility") == "timeline").alias("shown")), "id")
    return vectors.cluster_faces(rows, distance, faces, keys=("owner_id",), may_be_core="shown")


@query("grp_faces", _people_of_faces(0.62, 3))
def grp_faces(c: Catalog) -> DataFrame:
    return people_of_faces(c, 0.62, 3)


@query("grp_faces_default", _people_of_faces(0.5, 2))
def grp_faces_default(c: Catalog) -> DataFrame:
    return people_of_faces(c, 0.5, 2)


@query(
    "jn_iou",
    """WITH d AS (SELECT id, asset_id, x1 + 6 AS x1, y1 + 4 AS y1, x2 + 9 AS x2, y2 AS y2 FROM face WHERE id % 3 <> 0), m AS (SELECT d.asset_id, d.id AS detected, f.id AS face,
 greatest(least(f.x2, d.x2) - greatest(f.x1, d.x1), 0) * greatest(least(f.y2, d.y2) - greatest(f.y1, d.y1), 0)::DOUBLE AS i, (f.x2 - f.x1) * (f.y2 - f.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) AS s FROM d JOIN face f ON f.asset_id = d.asset_id WHERE f.deleted_at IS NULL)
SELECT asset_id, detected, min(face) AS face FROM m WHERE i / (s - i) > 0.5 GROUP BY ALL""",
)
def jn_iou(c: Catalog) -> DataFrame:
    found = c.face.where("id % 3 <> 0").selectExpr("asset_id", "id AS detected", "x1 + 6 AS dx1", "y1 + 4 AS dy1", "x2 + 9 AS dx2", "y2 AS dy2")
    rows = found.join(c.face.where("deleted_at IS NULL"), "asset_id")
    shared = "greatest(least(x2, dx2) - greatest(x1, dx1), 0) * greatest(least(y2, dy2) - greatest(y1, dy1), 0)"
    rows = rows.withColumn("i", F.expr(shared)).where("i / ((x2 - x1) * (y2 - y1) + (dx2 - dx1) * (dy2 - dy1) - i) > 0.5")
    return rows.groupBy("asset_id", "detected").agg(F.min("id").alias("face"))


@query(
    "jn_memory_assets",
    """SELECT m.id AS memory_id, count(*) AS n, string_agg(CAST(a.id AS STRING), ',' ORDER BY a.file_created_at, a.id) AS ids FROM memories m JOIN memory_asset x ON x.memory_id = m.id JOIN asset a ON a.id = x.asset_id WHERE NOT m.is_trashed AND a.deleted_at IS NULL AND a.visibility = 'timeline'
AND a.id NOT IN (SELECT asset_id FROM face f JOIN person p ON p.id = f.person_id WHERE p.is_hidden) GROUP BY ALL""",
)
def jn_memory_assets(c: Catalog) -> DataFrame:
    hidden = c.face.join(c.person.where("is_hidden").select(F.col("id").alias("person_id")), "person_id", "left_semi").select(F.col("asset_id").alias("id"))
    shown = c.asset.where("deleted_at IS NULL AND visibility = 'timeline'").join(hidden, "id", "left_anti").select(F.col("id").alias("asset_id"), "file_created_at")
    rows = c.memory_asset.join(c.memories.where("NOT is_trashed").select(F.col("id").alias("memory_id")), "memory_id", "left_semi").join(shown, "asset_id")
    items = F.sort_array(F.collect_list(F.struct("file_created_at", "asset_id")))
    found = rows.groupBy("memory_id").agg(F.count("*").alias("n"), items.alias("items"))
    return found.select("memory_id", "n", F.array_join(F.transform("items.asset_id", lambda x: x.cast("string")), ",").alias("ids"))


@query("agg_people_by_face", "SELECT p.id AS person_id, p.name, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM person p JOIN vector v ON v.id = p.id JOIN vector q ON q.id = 0")
def agg_people_by_face(c: Catalog) -> DataFrame:
    near = vectors.distances(c.vector.where("id = 0"), c.vector).select(F.col("id").alias("person_id"), "distance")
    return timeline.first_of(near.join(c.person.withColumnRenamed("id", "person_id"), "person_id"), ["person_id"], F.col("distance")).select("person_id", "name", F.round("distance", 6).alias("distance"))
