"""Workflows as data: ordered steps folded over an asset's state, so that a filter stops the rest and later steps see earlier changes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolake.functions import scalar

#: The methods of steps, and the source of events that a workflow's own writes raise.
METHODS = (
    "assetAddToAlbums", "assetArchive", "assetFavorite", "assetFileFilter", "assetLocationFilter", "assetExifFilter", "assetDateFilter", "assetLock",
    "assetMissingTimeZoneFilter", "assetTypeFilter", "assetVisibility", "webhook",
)
OWN_WRITE = "sidecar-write"
#: Settings of steps; each method looks at its own.
CONFIG = {
    "inverse": "boolean", "value": "string", "match": "string", "case_sensitive": "boolean", "property": "string", "types": "array<string>", "country": "string", "state": "string", "city": "string",
    "latitude": "double", "longitude": "double", "radius_km": "double", "start": "date", "end": "date", "recurring": "boolean", "visibility": "string", "album_ids": "array<bigint>", "album_name": "string", "url": "string", "http_method": "string",
}
STEP = f"struct<method: string, {', '.join(f'{k}: {v}' for k, v in CONFIG.items())}>"
STEPS = f"array<{STEP}>"


def step(method: str, **config: object) -> Column:
    """A step as a literal; settings may be columns."""
    if unknown := set(config) - set(CONFIG):
        raise ValueError(f"no such settings: {sorted(unknown)}")

    def literal(value: object) -> Column:
        return value if isinstance(value, Column) else F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)

    return F.struct(F.lit(method).alias("method"), *(literal(config.get(k)).cast(kind).alias(k) for k, kind in CONFIG.items())).cast(STEP)


def programs(workflows: DataFrame) -> DataFrame:
    """``(owner_id, trigger, program)``: the steps of all enabled workflows of an owner and trigger, by id, each with whether it begins a workflow.

    ``workflows`` has id, owner_id, trigger, enabled and steps. One owner has few workflows.
    """
    marked = F.transform("steps", lambda s, i: F.struct((i == 0).alias("first"), F.col("id").alias("workflow"), s.alias("step")))
    live = workflows.where("enabled AND size(steps) > 0").withColumn("marked", marked)
    return live.groupBy("owner_id", "trigger").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "marked"))), lambda w: w["marked"])).alias("program"))


def _matches(text: Column, s: Column) -> Column:
    """A value against a step's ``value``: contains (by default), exact, startsWith or regex; other kinds let all pass."""
    sensitive = F.coalesce(s["case_sensitive"], F.lit(False))
    have, want = (F.when(sensitive, x).otherwise(F.lower(x)) for x in (text, s["value"]))
    kinds = {"contains": F.contains(have, want), "exact": have == want, "startsWith": F.startswith(have, want), "regex": F.regexp_like(text, F.when(sensitive, s["value"]).otherwise(F.concat(F.lit("(?i)"), s["value"])))}
    return F.coalesce(reduce(lambda rest, k: F.when(F.coalesce(s["match"], F.lit("contains")) == k, kinds[k]).otherwise(rest), kinds, F.lit(True)), F.lit(False))


def _goes_on(s: Column, state: Column, exif: Iterable[str]) -> Column:
    """Whether a step lets the next one run, from its method, its settings and the asset's row."""
    region = reduce(Column.__and__, (F.coalesce(s[k], F.lit("")).isin("") | F.coalesce(s[k] == F.col(k), F.lit(False)) for k in ("country", "state", "city")))
    placed = F.coalesce(scalar.haversine_km(F.col("latitude"), F.col("longitude"), s["latitude"], s["longitude"]) <= F.coalesce(s["radius_km"], F.lit(0.0)), F.lit(False))
    day, month_day = F.col("local_date_time").cast("date"), lambda d: F.month(d) * 100 + F.dayofmonth(d)
    a, b, at = month_day(s["start"]), month_day(s["end"]), month_day(F.col("local_date_time"))
    yearly = F.when(a <= b, at.between(a, b)).otherwise((at >= a) | (at <= b))
    property_ = reduce(lambda rest, c: F.when(s["property"] == c, F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")).otherwise(rest), exif, F.lit(None).cast("string"))
    zone = F.coalesce(F.col("time_zone"), F.lit("")) != ""
    tests = {
        "assetFileFilter": _matches(F.coalesce("original_file_name", F.lit("")), s),
        "assetLocationFilter": region & (s["latitude"].isNull() | s["longitude"].isNull() | placed),
        "assetExifFilter": property_.isNotNull() & _matches(property_, s),
        "assetDateFilter": F.coalesce(F.when(F.coalesce(s["recurring"], F.lit(False)), yearly).otherwise(day.between(s["start"], s["end"])), F.lit(False)),
        "assetMissingTimeZoneFilter": zone == F.coalesce(s["inverse"], F.lit(False)),
        "assetTypeFilter": F.coalesce(F.array_contains(s["types"], F.col("type")), F.lit(False)),
    }
    known = s["method"].isin(*METHODS) | s["method"].startswith("noop")
    return reduce(lambda rest, m: F.when(s["method"] == m, tests[m]).otherwise(rest), tests, known)


def run(events: DataFrame, workflows: DataFrame, assets: DataFrame, exif: tuple[str, ...] = ("make", "model", "lens_model", "iso", "f_number", "rating", "description", "country", "state", "city")) -> DataFrame:
    """What workflows do to the assets of ``events`` (event_id, asset_id, trigger, source), a stream or not.

    Returns event_id, asset_id, visibility and is_favorite as they are then, ``changed``,
    whether a step wrote them, ``albums`` (album_id or name) the asset is put in,
    ``requests`` (url, method, workflow) and ``failed``, workflows with a step of no
    known method. ``assets`` has the asset's row with its camera data.

    The enabled workflows of the asset's owner for the trigger run one behind the other,
    by id, and each step sees what those before have changed. A filter that says no, or a
    step of no known method, ends its own workflow; what that has written stays. Events
    that come of a workflow's own writing start none, nor do those of unknown assets.
    """
    inside = [c for c in exif if c in assets.columns]
    rows = events.where(F.coalesce(F.col("source") != OWN_WRITE, F.lit(True))).join(assets.withColumnRenamed("id", "asset_id"), "asset_id")
    rows = rows.join(programs(workflows), ["owner_id", "trigger"])
    start = F.struct(
        F.lit(True).alias("on"), F.col("visibility").alias("visibility"), F.col("is_favorite").alias("is_favorite"), F.lit(False).alias("changed"),
        F.array().cast("array<struct<album_id: bigint, name: string>>").alias("albums"), F.array().cast("array<struct<url: string, method: string, workflow: bigint>>").alias("requests"), F.array().cast("array<bigint>").alias("failed"),
    )

    def merge(state: Column, item: Column) -> Column:
        s, method = item["step"], item["step"]["method"]
        on = state["on"] | item["first"]
        inverse = F.coalesce(s["inverse"], F.lit(False))

        def moved(name: str, to: str) -> Column:
            back = F.when(state["visibility"] == to, "timeline").otherwise(state["visibility"])
            return F.when(method == name, F.when(inverse, back).otherwise(F.lit(to)))

        visibility = F.coalesce(F.when(on, F.coalesce(moved("assetArchive", "archive"), moved("assetLock", "locked"), F.when(method == "assetVisibility", s["visibility"]))), state["visibility"])
        favorite = F.when(on & (method == "assetFavorite"), ~inverse).otherwise(state["is_favorite"])
        ids = F.transform(F.coalesce(s["album_ids"], F.array().cast("array<bigint>")), lambda i: F.struct(i.alias("album_id"), F.lit(None).cast("string").alias("name")))
        named = F.when(F.coalesce(s["album_name"], F.lit("")) != "", F.array(F.struct(F.lit(None).cast("bigint").alias("album_id"), s["album_name"].alias("name"))))
        albums = F.when(on & (method == "assetAddToAlbums"), F.concat(state["albums"], F.when(F.size(ids) > 0, ids).otherwise(F.coalesce(named, ids)))).otherwise(state["albums"])
        sent = F.array(F.struct(s["url"].alias("url"), F.coalesce(s["http_method"], F.lit("POST")).alias("method"), item["workflow"].cast("bigint").alias("workflow")))
        requests = F.when(on & (method == "webhook"), F.concat(state["requests"], sent)).otherwise(state["requests"])
        unknown = on & ~(method.isin(*METHODS) | method.startswith("noop"))
        failed = F.when(unknown, F.concat(state["failed"], F.array(item["workflow"].cast("bigint")))).otherwise(state["failed"])
        changed = state["changed"] | ~visibility.eqNullSafe(state["visibility"]) | ~favorite.eqNullSafe(state["is_favorite"]) | (on & (method == "assetVisibility"))
        return F.struct((on & _goes_on(s, state, inside)).alias("on"), visibility.alias("visibility"), favorite.alias("is_favorite"), changed.alias("changed"), albums.alias("albums"), requests.alias("requests"), failed.alias("failed"))

    done = rows.withColumn("state", F.aggregate("program", start, merge))
    return done.select("event_id", "asset_id", "state.visibility", "state.is_favorite", "state.changed", "state.albums", "state.requests", "state.failed")
