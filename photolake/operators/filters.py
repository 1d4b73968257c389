"""Predicates and filters over catalogue rows."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolake.functions import scalar


def default_visible() -> Column:
    """Neither hidden nor locked."""
    return F.col("visibility").isin("archive", "timeline")


def compare(column: Column, **tests: Any) -> Column:
    """All of eq, ne, lt, lte, gt, gte, isin, not_in; a null under eq or ne tests for null.

    A null value passes none of the others, as in SQL.
    """
    build = {
        "eq": lambda v: column.isNull() if v is None else column == v,
        "ne": lambda v: column.isNotNull() if v is None else column != v,
        "lt": lambda v: column < v,
        "lte": lambda v: column <= v,
        "gt": lambda v: column > v,
        "gte": lambda v: column >= v,
        "isin": lambda v: column.isin(*v),
        "not_in": lambda v: ~column.isin(*v),
    }
    return reduce(lambda a, b: a & b, (build[k](v) for k, v in tests.items()), F.lit(True))


def pattern(column: Column, like: str | None = None, not_like: str | None = None, starts: str | None = None, ends: str | None = None) -> Column:
    """Containment, prefix and suffix without regard to case and marks; % and _ of the needle are wildcards."""
    text = F.lower(scalar.unaccent(column))

    tests = []
    if like is not None:
        tests.append(text.like(_fold(f"%{like}%")))
    if not_like is not None:
        tests.append(~text.like(_fold(f"%{not_like}%")))
    if starts is not None:
        tests.append(text.like(_fold(f"{starts}%")))
    if ends is not None:
        tests.append(text.like(_fold(f"%{ends}")))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _fold(s: str) -> str:
    table = dict(zip(*scalar._fold_table()))
    return "".join(table.get(c, c) for c in s).lower()


def having(df: DataFrame, bridge: DataFrame, wanted: bool = True, key: str = "asset_id") -> DataFrame:
    """Rows that have (or lack) a row in the bridge."""
    return df.join(bridge.select(F.col(key).alias("id")).distinct(), "id", "left_semi" if wanted else "left_anti")


def with_ids(df: DataFrame, bridge: DataFrame, value: str, any_of: list | None = None, all_of: list | None = None, none_of: list | None = None, key: str = "asset_id") -> DataFrame:
    """Rows linked to any, all or none of the given ids; repeated ids count once."""
    pairs = bridge.select(F.col(key).alias("id"), F.col(value).alias("v"))
    if any_of is not None:
        df = df.join(pairs.where(F.col("v").isin(*any_of)).select("id").distinct(), "id", "left_semi")
    if all_of is not None:
        ids = list(dict.fromkeys(all_of))
        full = pairs.where(F.col("v").isin(*ids)).groupBy("id").agg(F.count_distinct("v").alias("n")).where(F.col("n") == len(ids))
        df = df.join(full.select("id"), "id", "left_semi")
    if none_of is not None:
        df = df.join(pairs.where(F.col("v").isin(*none_of)), "id", "left_anti")
    return df


def in_bbox(west: float, south: float, east: float, north: float) -> Column:
    """Within a box of latitudes and longitudes, which wraps the antimeridian if west is over east."""
    lat = F.col("latitude").between(south, north)
    lon = F.col("longitude")
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat & inside


def in_cube(latitude: float, longitude: float, half_m: float) -> Column:
    """Within the cube of a half side around a place on the sphere."""
    here, there = scalar.earth(F.col("latitude"), F.col("longitude")), scalar.earth(F.lit(latitude), F.lit(longitude))
    return reduce(lambda a, b: a & b, (F.abs(here[k] - there[k]) <= half_m for k in "xyz"))


def in_folder(df: DataFrame, folder: str) -> DataFrame:
    """Direct children of folders whose path ends with ``folder``, by base name."""
    f = folder.strip("/")
    path = F.col("original_path")
    return df.where(path.like(f"%{f}/%") & ~path.like(f"%{f}/%/%")).orderBy(scalar.base_name(path).asc_nulls_last(), "id")


def detect_offline(assets: DataFrame, roots: DataFrame, exclusions: list[str]) -> DataFrame:
    """External assets that are online but stand under none of their library's roots, or match an exclusion.

    ``roots`` has library_id and root. The prefix test has no separator, so ``/a`` covers
    ``/ab``. Each asset meets only the roots of its own library.
    """
    live = assets.where("is_external AND NOT is_offline AND library_id IS NOT NULL")
    covered = live.join(roots, "library_id").where(F.col("original_path").startswith(F.col("root"))).select("id").distinct()
    excluded = reduce(lambda a, b: a | b, (F.col("original_path").like(scalar.glob_to_like(g)) for g in exclusions), F.lit(False))
    return live.join(covered.withColumn("covered", F.lit(True)), "id", "left").where(F.col("covered").isNull() | excluded).drop("covered")


def match_value(column: Column, value: str, kind: str = "contains", case_sensitive: bool = False) -> Column:
    """Whether a value contains, equals, begins with or matches ``value``; null does not."""
    text, want = (column, value) if case_sensitive else (F.lower(column), value.lower())
    test = {"contains": lambda: text.contains(want), "exact": lambda: text == want, "startsWith": lambda: text.startswith(want), "regex": lambda: column.rlike(value if case_sensitive else f"(?i){value}")}[kind]()
    return F.coalesce(test, F.lit(False))


def near(latitude: float, longitude: float, radius_km: float) -> Column:
    return scalar.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(latitude), F.lit(longitude)) <= radius_km


def located(country: str | None = None, state: str | None = None, city: str | None = None, latitude: float | None = None, longitude: float | None = None, radius_km: float = 0.0) -> Column:
    """In the named country, state and city, those of them that are given, and within the radius of a place, if one is given."""
    named = [F.coalesce(F.col(k) == v, F.lit(False)) for k, v in (("country", country), ("state", state), ("city", city)) if v]
    if latitude is not None and longitude is not None:
        named.append(F.coalesce(near(latitude, longitude, radius_km), F.lit(False)))
    return reduce(lambda a, b: a & b, named, F.lit(True))


def in_date_window(ts: Column, start: str, end: str, recurring: bool = False) -> Column:
    """From the start day to the end day, both included; recurring windows fall in every year and may pass New Year."""
    if not recurring:
        return ts.cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    day = F.month(ts) * 100 + F.dayofmonth(ts)
    a, b = int(start[5:7]) * 100 + int(start[8:10]), int(end[5:7]) * 100 + int(end[8:10])
    return day.between(a, b) if a <= b else (day >= a) | (day <= b)


def pending(assets: DataFrame, status: DataFrame, files: DataFrame, job: str, force: bool = False) -> DataFrame:
    """Assets that a background job has still to work on."""
    live = assets.where("deleted_at IS NULL")
    state = status.withColumnRenamed("asset_id", "id")
    if job == "thumbnails":
        kinds = files.groupBy(F.col("asset_id").alias("id")).agg(F.max((F.col("type") == "preview").cast("int")).alias("preview"), F.max((F.col("type") == "thumbnail").cast("int")).alias("thumbnail"))
        rows = live.where("visibility <> 'hidden'").join(kinds, "id", "left")
        return rows if force else rows.where("coalesce(preview, 0) = 0 OR coalesce(thumbnail, 0) = 0 OR thumbhash IS NULL")
    if job == "video":
        rows = live.where("type = 'VIDEO'")
        return rows if force else rows.where("visibility <> 'hidden'").join(files.where("type = 'encoded_video'").select(F.col("asset_id").alias("id")), "id", "left_anti")
    if job == "sidecar":
        return live if force else live.join(files.where("type = 'sidecar'").select(F.col("asset_id").alias("id")), "id", "left_anti")
    column = {"metadata": "metadata_at", "faces": "faces_at", "ocr": "ocr_at", "duplicates": "duplicates_at"}[job]
    rows = live.join(state, "id", "left")
    if job in ("faces", "ocr", "duplicates"):
        rows = rows.where("visibility <> 'hidden'") if job != "duplicates" else rows.where(default_visible()).where("stack_id IS NULL")
    return rows if force else rows.where(F.col(column).isNull())


def transcode_target(policy: str = "required", codecs: tuple[str, ...] = ("h264",), audio: tuple[str, ...] = ("aac",), side: int = 720, max_bitrate: int = 0) -> Column:
    """none, audio, video or all: which streams of a video have to be transcoded.

    Needs video_codec, pixel_format, audio_codec, width, height and bitrate.
    """
    small = F.least("width", "height")
    audio_bad = F.col("audio_codec").isNotNull() & ~F.col("audio_codec").isin(*audio)
    required = ~F.col("video_codec").isin(*codecs) | ~F.col("pixel_format").endswith("420p")
    larger = small > side
    over = (F.col("bitrate") > max_bitrate) if max_bitrate else F.lit(False)
    video = {"all": F.lit(True), "disabled": F.lit(False), "required": required, "optimal": required | larger, "bitrate": required | over}[policy]
    audio_bad = F.lit(False) if policy == "disabled" else F.lit(True) & audio_bad
    return F.when(video & audio_bad, "all").when(video, "video").when(audio_bad, "audio").otherwise("none")


#: Containers by the long names that streams bear.
CONTAINERS = {"QuickTime / MOV": "mov", "Matroska / WebM": "webm"}


def remux_required(policy: str = "required", accepted: tuple[str, ...] = ("mov", "ogg", "webm")) -> Column:
    """Whether a video's streams have to go into another container: it is neither MP4 nor accepted. Needs format_name and format_long_name."""
    known = F.create_map(*(F.lit(x) for pair in CONTAINERS.items() for x in pair))
    name = F.coalesce(known[F.coalesce("format_long_name", F.lit(""))], F.col("format_name"), F.lit(""))
    return F.lit(False) if policy == "disabled" else (name != "mp4") & ~name.isin(*accepted)


def active_memories(on: str) -> Column:
    """Memories shown on a day: open-ended where a bound is missing."""
    day = F.lit(on).cast("timestamp_ntz")
    return (F.col("show_at").isNull() | (F.col("show_at") <= day)) & (F.col("hide_at").isNull() | (F.col("hide_at") >= day))
