"""The photo catalogue, derived by rule from the given tables, and the SQL that derives it.

Each catalogue table is one SELECT in SQL that both Spark and DuckDB run, so queries and
their SQL equivalents start from the same rows. Keys follow the source tables' keys and
every table grows with them. Nulls come in by remainders, as the sources have none.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plus(ts: str, seconds: str, spark: bool) -> str:
    return f"timestampadd(SECOND, CAST({seconds} AS INT), {ts})" if spark else f"({ts} + to_seconds(CAST({seconds} AS INTEGER)))"


def whole(expression: str) -> str:
    """Integer quotient in both dialects."""
    return f"CAST(floor({expression}) AS BIGINT)"


def _asset(spark: bool) -> str:
    k, owner = "o_orderkey", whole("o_custkey / 10")
    taken = plus("o_orderdate", f"({k} * 7919) % 86400", spark)
    ext = f"CASE WHEN {k} % 10 < 4 THEN '.jpg' WHEN {k} % 10 < 7 THEN '.raw' WHEN {k} % 10 < 9 THEN '.mp4' ELSE '.bin' END"
    return f"""
SELECT {k} AS id, {owner} AS owner_id,
  CASE WHEN {k} % 10 < 7 THEN 'IMAGE' WHEN {k} % 10 < 9 THEN 'VIDEO' ELSE 'OTHER' END AS type,
  CASE {k} % 20 WHEN 0 THEN 'archive' WHEN 1 THEN 'hidden' WHEN 2 THEN 'locked' ELSE 'timeline' END AS visibility,
  CASE WHEN {k} % 39 = 0 THEN 'deleted' WHEN {k} % 13 = 0 THEN 'trashed' ELSE 'active' END AS status,
  CASE WHEN {k} % 13 = 0 THEN {plus("o_orderdate", "86400 * 400", spark)} END AS deleted_at,
  {taken} AS file_created_at, {plus("o_orderdate", f"({k} * 7919) % 86400 + 600", spark)} AS file_modified_at,
  {plus("o_orderdate", f"({k} * 7919) % 86400 + (({k} % 5) - 2) * 3600", spark)} AS local_date_time,
  {plus("o_orderdate", f"86400 * 3 + {k} % 1000", spark)} AS created_at, {plus("o_orderdate", f"86400 * 5 + {k} % 777", spark)} AS updated_at,
  lpad(CAST({k} AS STRING), 12, '0') AS update_id,
  {k} % 9 = 0 AS is_favorite, {k} % 31 = 0 AS is_offline, {k} % 6 = 0 AS is_external, {k} % 14 = 0 AS is_edited,
  CASE WHEN {k} % 6 = 0 THEN {owner} * 10 + {k} % 3 END AS library_id,
  CASE WHEN {k} % 40 < 3 THEN {whole(f"{k} / 40")} END AS stack_id,
  CASE WHEN {k} % 25 < 3 THEN {whole(f"{k} / 25")} WHEN {k} % 25 = 5 THEN {whole(f"{k} / 25")} + 100000000 END AS duplicate_id,
  CASE WHEN {k} % 50 = 10 THEN {k} + 7 END AS live_photo_video_id,
  CASE WHEN {k} % 101 <> 0 THEN md5(CAST({whole(f"{k} / 2")} AS STRING)) END AS checksum,
  concat('/data/', CAST({owner} AS STRING), '/', CAST(year(o_orderdate) AS STRING), CASE WHEN {k} % 3 = 0 THEN '/raw' ELSE '' END, '/IMG_', CAST({k} AS STRING), {ext}) AS original_path,
  concat('IMG_', lpad(CAST({whole(f"{k} / 4")} % 500 AS STRING), 4, '0'), {ext}) AS original_file_name,
  CASE WHEN {k} % 17 <> 0 THEN CAST(1000 + {k} % 3000 AS INT) END AS width, CASE WHEN {k} % 23 = 0 THEN 0 ELSE CAST(500 + ({k} * 3) % 2500 AS INT) END AS height,
  CASE WHEN {k} % 10 IN (7, 8) THEN CAST({k} % 60000 AS INT) END AS duration,
  CASE WHEN {k} % 11 <> 0 THEN md5(CAST({k} AS STRING)) END AS thumbhash
FROM {{orders}}"""


def _exif(spark: bool) -> str:
    k = "o_orderkey"
    return f"""
SELECT {k} AS asset_id,
  CASE {k} % 6 WHEN 0 THEN 'Canon' WHEN 1 THEN 'Nikon' WHEN 2 THEN 'Sony' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'Leica' END AS make,
  CASE WHEN {k} % 6 <> 4 THEN concat('M-', CAST({k} % 12 AS STRING)) END AS model, CASE WHEN {k} % 7 <> 2 THEN concat('Lens ', CAST({k} % 8 AS STRING)) END AS lens_model,
  CASE WHEN {k} % 5 <> 1 THEN CAST({k} % 40 AS DOUBLE) / 2 END AS f_number, CASE WHEN {k} % 8 <> 5 THEN CAST(100 * (1 + {k} % 32) AS INT) END AS iso,
  CASE WHEN {k} % 7 <> 0 THEN CAST(({k} * 7919) % 18000 AS DOUBLE) / 100 - 90 END AS latitude,
  CASE WHEN {k} % 7 <> 0 THEN CAST(({k} * 104729) % 36000 AS DOUBLE) / 100 - 180 END AS longitude,
  CASE WHEN {k} % 7 <> 0 THEN concat('NATION_', CAST({k} % 25 AS STRING)) END AS country, CASE WHEN {k} % 7 <> 0 AND {k} % 3 <> 0 THEN concat('State ', CAST({k} % 40 AS STRING)) END AS state,
  CASE WHEN {k} % 7 <> 0 AND {k} % 4 <> 1 THEN concat(CASE WHEN {k} % 80 < 20 THEN 'Münster ' ELSE 'City ' END, CAST({k} % 80 AS STRING)) WHEN {k} % 7 = 0 THEN '' END AS city,
  CASE WHEN {k} % 5 = 0 THEN concat('Summer trip ', CAST({k} % 30 AS STRING)) ELSE '' END AS description,
  CASE WHEN {k} % 6 <> 0 THEN CAST({k} % 6 AS INT) END AS rating, {whole("o_totalprice * 100")} AS file_size,
  CASE WHEN {k} % 4 <> 0 THEN 'UTC+1' END AS time_zone, CASE WHEN {k} % 50 IN (10, 17) THEN concat('cid', CAST({whole("o_custkey / 10")} % 20 AS STRING), '-', CAST({whole(f"{k} / 50")} % 3 AS STRING)) END AS live_photo_cid,
  CAST(1 + {k} % 8 AS INT) AS orientation, CASE WHEN {k} % 9 = 4 THEN 'sRGB' WHEN {k} % 9 = 5 THEN 'Display P3' END AS profile_description, CASE WHEN {k} % 9 = 6 THEN 'Uncalibrated' WHEN {k} % 9 = 7 THEN 'sRGB' END AS colorspace,
  CASE WHEN {k} % 3 = 1 THEN CAST(8 * (1 + {k} % 2) AS INT) END AS bits_per_sample
FROM {{orders}}"""


def _face(spark: bool) -> str:
    return f"""
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS asset_id, CASE WHEN l_partkey % 6 <> 0 THEN l_suppkey END AS person_id,
  CAST(l_partkey % 300 AS INT) AS x1, CAST(l_partkey % 200 AS INT) AS y1, CAST(l_partkey % 300 + 20 + l_quantity AS INT) AS x2, CAST(l_partkey % 200 + 30 + l_quantity AS INT) AS y2,
  CAST(800 AS INT) AS image_width, CAST(600 AS INT) AS image_height,
  CASE l_partkey % 4 WHEN 0 THEN 'exif' ELSE 'machine-learning' END AS source_type, l_partkey % 10 <> 3 AS is_visible,
  CASE WHEN l_partkey % 15 = 2 THEN l_shipdate END AS deleted_at
FROM {{lineitem}} WHERE l_linenumber <= 2"""


TABLES = {
    "asset": _asset,
    "exif": _exif,
    "face": _face,
    "users": lambda s: f"""
SELECT {whole("c_custkey / 10")} AS id, c_name AS name, concat('user', CAST({whole("c_custkey / 10")} AS STRING), '@example.org') AS email,
  CASE WHEN c_custkey % 40 <> 0 THEN CAST(1000000000 AS BIGINT) END AS quota, CASE WHEN c_custkey % 170 = 0 THEN 'removed' ELSE 'active' END AS status, c_custkey % 170 = 0 AS is_deleted,
  CASE WHEN c_custkey % 30 = 0 THEN '{{{{"people":{{{{"minimumFaces":5}}}}}}}}' WHEN c_custkey % 30 = 10 THEN '{{{{"people":{{{{}}}}}}}}' END AS preferences
FROM {{customer}} WHERE c_custkey % 10 = 0""",
    "person": lambda s: f"""
SELECT s_suppkey AS id, s_suppkey % 10 AS owner_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('Jörg ', CAST(s_suppkey % 60 AS STRING)) END AS name,
  s_suppkey % 11 = 0 AS is_hidden, s_suppkey % 7 = 0 AS is_favorite, CASE WHEN s_suppkey % 5 = 0 THEN CAST(CONCAT(CAST(1950 + s_suppkey % 50 AS STRING), '-03-01') AS DATE) END AS birth_date
FROM {{supplier}}""",
    "asset_file": lambda s: """
SELECT o_orderkey * 4 AS id, o_orderkey AS asset_id, 'preview' AS type, concat('/thumbs/', CAST(o_orderkey AS STRING), '/preview.jpg') AS path FROM {orders} WHERE o_orderkey % 12 <> 5
UNION ALL SELECT o_orderkey * 4 + 1, o_orderkey, 'thumbnail', concat('/thumbs/', CAST(o_orderkey AS STRING), '/thumb.webp') FROM {orders} WHERE o_orderkey % 16 <> 3
UNION ALL SELECT o_orderkey * 4 + 2, o_orderkey, 'sidecar', concat('/data/side/IMG_', CAST(o_orderkey AS STRING), '.jpg.xmp') FROM {orders} WHERE o_orderkey % 18 = 7
UNION ALL SELECT o_orderkey * 4 + 3, o_orderkey, 'encoded_video', concat('/encoded/', CAST(o_orderkey AS STRING), '.mp4') FROM {orders} WHERE o_orderkey % 10 = 7 AND o_orderkey % 3 = 0""",
    "album": lambda s: f"""
SELECT p_partkey AS id, {whole("p_partkey / 13")} % 150 AS owner_id, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name, p_partkey % 19 = 0 AS is_deleted,
  CASE WHEN p_partkey % 4 = 0 THEN p_partkey * 3 END AS thumbnail_id FROM {{part}}""",
    "album_asset": lambda s: "SELECT DISTINCT l_partkey AS album_id, l_orderkey AS asset_id FROM {lineitem} WHERE l_partkey % 37 <> 5",
    "album_user": lambda s: f"""
SELECT p_partkey AS album_id, {whole("p_partkey / 13")} % 150 AS user_id, 'owner' AS role FROM {{part}}
UNION ALL SELECT p_partkey, ({whole("p_partkey / 13")} + 1 + p_partkey % 5) % 150, CASE WHEN p_partkey % 2 = 0 THEN 'editor' ELSE 'viewer' END FROM {{part}} WHERE p_partkey % 3 = 0""",
    "share": lambda s: f"""
SELECT album_id, user_id, lpad(CAST(album_id * 3 AS STRING), 12, '0') AS create_id, CASE WHEN album_id % 2 = 0 THEN lpad(CAST(album_id * 9 AS STRING), 12, '0') END AS delete_id FROM {{album_user}} WHERE role <> 'owner'
UNION ALL SELECT album_id, user_id, lpad(CAST(album_id * 12 AS STRING), 12, '0'), NULL FROM {{album_user}} WHERE role <> 'owner' AND album_id % 4 = 0""",
    "shared_link": lambda s: f"""
SELECT p_partkey AS id, {whole("p_partkey / 13")} % 150 AS user_id, CASE WHEN p_partkey % 10 = 0 THEN p_partkey END AS album_id FROM {{part}} WHERE p_partkey % 5 = 0""",
    "shared_link_asset": lambda s: "SELECT DISTINCT l_partkey AS link_id, l_orderkey AS asset_id FROM {lineitem} WHERE l_partkey % 5 = 0 AND l_partkey % 10 <> 0",
    "tag": lambda s: f"""
SELECT r_regionkey AS id, r_name AS value, CAST(NULL AS BIGINT) AS parent_id FROM {{region}}
UNION ALL SELECT 100 + n_nationkey, concat(r_name, '/', n_name), r_regionkey FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL SELECT 1000 + c_custkey, concat(r_name, '/', n_name, '/', c_name), 100 + n_nationkey FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey WHERE c_custkey % 10 = 3""",
    "tag_asset": lambda s: """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 100 + o_orderkey % 20 ELSE 1000 + o_custkey END AS tag_id, o_orderkey AS asset_id FROM {orders} WHERE o_custkey % 10 = 3 AND o_custkey % 40 <> 3
UNION ALL SELECT o_orderkey % 4, o_orderkey FROM {orders} WHERE o_orderkey % 30 = 0""",
    "stack": lambda s: f"""SELECT {whole("o_orderkey / 40")} AS id, {whole("o_custkey / 10")} AS owner_id, o_orderkey AS primary_asset_id FROM {{orders}} WHERE o_orderkey % 40 = 0""",
    "partner": lambda s: f"""SELECT {whole("c_custkey / 10")} AS shared_by, ({whole("c_custkey / 10")} + 3) % 150 AS shared_with, c_custkey % 20 = 0 AS in_timeline FROM {{customer}} WHERE c_custkey % 10 = 0 AND c_custkey % 30 <> 0""",
    "activity": lambda s: """
SELECT event_id AS id, event_id % 400 AS album_id, user_id, CASE WHEN event_id % 4 <> 0 THEN event_id % 900 END AS asset_id, event_type = 'click' AS is_liked,
  CASE WHEN event_type <> 'click' THEN concat('comment ', CAST(event_id AS STRING)) END AS comment FROM {events}""",
    "library": lambda s: f"""
SELECT {whole("c_custkey / 10")} * 10 + 0 AS id, {whole("c_custkey / 10")} AS owner_id, c_custkey % 50 = 0 AS is_deleted FROM {{customer}} WHERE c_custkey % 10 = 0
UNION ALL SELECT {whole("c_custkey / 10")} * 10 + 4, {whole("c_custkey / 10")}, false FROM {{customer}} WHERE c_custkey % 10 = 0""",
    "memories": lambda s: f"""
SELECT o_orderkey AS id, {whole("o_custkey / 10")} AS owner_id, concat('{{{{"year":', CAST(year(o_orderdate) AS STRING), '}}}}') AS data, o_orderkey % 8 = 0 AS is_saved, o_orderkey % 90 = 0 AS is_trashed, o_orderdate AS memory_at,
  CASE WHEN o_orderkey % 20 <> 0 THEN o_orderdate END AS show_at, CASE WHEN o_orderkey % 60 <> 0 THEN {plus("o_orderdate", "86400", s)} END AS hide_at, {plus("o_orderdate", "7200", s)} AS created_at
FROM {{orders}} WHERE o_orderkey % 10 = 0""",
    "memory_asset": lambda s: "SELECT DISTINCT l_orderkey AS memory_id, l_partkey * 7 AS asset_id FROM {lineitem} WHERE l_orderkey % 10 = 0",
    "job_status": lambda s: """
SELECT o_orderkey AS asset_id, CASE WHEN o_orderkey % 5 <> 1 THEN o_orderdate END AS faces_at, CASE WHEN o_orderkey % 7 <> 2 THEN o_orderdate END AS metadata_at,
  CASE WHEN o_orderkey % 9 <> 3 THEN o_orderdate END AS duplicates_at, CASE WHEN o_orderkey % 11 <> 4 THEN o_orderdate END AS ocr_at FROM {orders} WHERE o_orderkey % 50 <> 49""",
    "listing": lambda s: f"""
SELECT original_path AS path, file_modified_at AS modified_at, CAST(id AS BIGINT) AS size FROM {{asset}} WHERE id % 29 <> 4
UNION ALL SELECT path, {'CAST(NULL AS TIMESTAMP)'}, id FROM {{asset_file}} WHERE id % 33 <> 2
UNION ALL SELECT concat('/data/', CAST(id % 150 AS STRING), '/new/IMG_', CAST(id AS STRING), '.jpg'), file_modified_at, id FROM {{asset}} WHERE id % 21 = 0""",
    "local_asset": lambda s: f"""
SELECT o_orderkey AS id, {whole("o_custkey / 10")} AS owner_id, CASE WHEN o_orderkey % 45 <> 7 THEN md5(CAST(CASE WHEN o_orderkey % 4 = 1 THEN {whole("o_orderkey / 2")} ELSE {whole("o_orderkey / 3")} END AS STRING)) END AS checksum, o_orderdate AS created_at, o_orderkey % 16 = 0 AS is_favorite,
  CASE WHEN o_orderkey % 10 < 7 THEN 'IMAGE' ELSE 'VIDEO' END AS type, CASE WHEN o_orderkey % 4 <> 0 THEN CAST({whole("o_orderkey / 2")} AS STRING) END AS cloud_id,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 90 AS DOUBLE) END AS latitude, o_orderkey % 1000 AS size FROM {{orders}} WHERE o_orderkey % 2 = 1""",
    "trashed_local": lambda s: f"""
SELECT o_orderkey AS id, {whole("o_custkey / 10")} AS owner_id, md5(CAST(CASE WHEN o_orderkey % 4 = 2 THEN {whole("o_orderkey / 2")} ELSE {whole("o_orderkey / 3")} END AS STRING)) AS checksum, 20 * (o_orderkey % 60) AS album_id,
  CASE WHEN o_orderkey % 8 < 6 THEN 'remote_sync' ELSE 'local_user' END AS source FROM {{orders}} WHERE o_orderkey % 2 = 0""",
    "session": lambda s: f"""SELECT {whole("c_custkey / 10")} AS user_id, c_custkey % 70 = 0 AS elevated FROM {{customer}} WHERE c_custkey % 10 = 0 AND c_custkey % 110 <> 0""",
    "local_album": lambda s: "SELECT p_partkey AS id, CAST(p_partkey % 3 AS INT) AS backup_selection, p_partkey % 17 = 0 AS is_shared, p_name AS name FROM {part} WHERE p_partkey % 20 = 0",
    "local_album_asset": lambda s: "SELECT DISTINCT l_partkey AS album_id, l_orderkey AS asset_id FROM {lineitem} WHERE l_partkey % 20 = 0 AND l_orderkey % 2 = 1",
    "ocr_text": lambda s: """
SELECT o_orderkey AS asset_id, concat(CASE o_orderkey % 5 WHEN 0 THEN 'Grand Hotel Münster room ' WHEN 1 THEN 'Exit only, gate ' WHEN 2 THEN 'hotels and inns ' WHEN 3 THEN 'Speed limit ' ELSE 'Platform ' END, CAST(o_orderkey % 90 AS STRING)) AS text FROM {orders} WHERE o_orderkey % 8 = 1""",
    "place": lambda s: f"""
SELECT c_custkey AS id, concat('Town ', CAST(c_custkey AS STRING)) AS name, CAST((c_custkey * 7919) % 18000 AS DOUBLE) / 100 - 90 AS latitude, CAST((c_custkey * 104729) % 36000 AS DOUBLE) / 100 - 180 AS longitude,
  n_name AS country_code, CASE WHEN c_custkey % 5 <> 0 THEN concat('Admin ', CAST(c_custkey % 30 AS STRING)) END AS admin1_name, CASE WHEN c_custkey % 7 < 3 THEN concat('District ', CAST(c_custkey % 40 AS STRING)) END AS admin2_name, CASE WHEN c_custkey % 3 = 0 THEN concat('Old Town ', CAST(c_custkey % 100 AS STRING)) END AS alternate_names
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "report": lambda s: "SELECT path, CASE WHEN id % 3 = 0 THEN 'missing_file' WHEN id % 3 = 1 THEN 'untracked_file' ELSE 'checksum_mismatch' END AS type, asset_id, id FROM {asset_file} WHERE id % 7 = 0",
    "audit": lambda s: f"""
SELECT concat('9', lpad(CAST(event_id AS STRING), 11, '0')) AS id, event_id % 3000 AS asset_id, event_id % 150 AS owner_id, ts AS deleted_at FROM {{events}} WHERE event_id % 6 = 0""",
    "checkpoint": lambda s: f"""
SELECT {whole("c_custkey / 10")} AS user_id, 'AssetV1' AS type, lpad(CAST(c_custkey * 5 AS STRING), 12, '0') AS ack FROM {{customer}} WHERE c_custkey % 10 = 0""",
    "vector": lambda s: "SELECT vec_id AS id, label % 3 AS owner_id, embedding FROM {embeddings}",
}


class Catalog:
    """Catalogue tables as attributes: ``Catalog(spark, sf_dir).asset``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in TABLES:
            raise AttributeError(name)
        sql = TABLES[name](True)
        return self.spark.sql(sql, **{t: getattr(self, t) for t in needs(sql)})


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def _counted(sql: str) -> str:
    """``count_if`` gives a 128-bit number in DuckDB; the queries' counts have 64 bits."""
    out, at = [], 0
    while (start := sql.find("count_if(", at)) >= 0:
        end, depth = start + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:start], f"CAST({sql[start:end]} AS BIGINT)"]
        at = end
    return "".join([*out, sql[at:]])


def oracle(body: str) -> str:
    """``body``, which names catalogue tables, as DuckDB SQL over the given tables."""
    body = _counted(body)
    found: dict[str, str] = {}

    def add(name: str) -> None:
        if name in found or name not in TABLES:
            return
        sql = TABLES[name](False)
        for t in needs(sql):
            add(t)
        found[name] = sql.format(**{t: t for t in needs(sql)})

    for name in re.findall(r"\b[a-z_]+\b", body):
        add(name)
    body = body.strip()
    loops = body.upper().startswith("WITH RECURSIVE ")
    rest = ", " + body[len("WITH RECURSIVE") if loops else 4 :].lstrip() if body[:5].upper() == "WITH " else "\n" + body
    return ("WITH " + "RECURSIVE " * loops + ",\n".join(f"{n} AS ({s}\n)" for n, s in found.items()) + rest) if found else body
