"""Statistics of users, libraries, albums, people and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolake.functions import scalar
from photolake.operators import filters


def count_if(test: Column | str) -> Column:
    return F.count_if(F.expr(test) if isinstance(test, str) else test)


def user_stats(users: DataFrame, assets: DataFrame, exif: DataFrame) -> DataFrame:
    """Photos, videos and bytes of every active user; those without assets stay, with zeros.

    Counts take what is not deleted and not hidden, bytes what is in no library.
    """
    sizes = exif.select(F.col("asset_id").alias("id"), "file_size")
    own = F.col("library_id").isNull()
    live = assets.where("deleted_at IS NULL").join(sizes, "id", "left")
    shown = F.col("visibility") != "hidden"
    sums = live.groupBy("owner_id").agg(
        count_if((F.col("type") == "IMAGE") & shown).alias("photos"),
        count_if((F.col("type") == "VIDEO") & shown).alias("videos"),
        F.sum(F.when(own, F.col("file_size")).otherwise(0)).alias("usage"),
        F.sum(F.when(own & (F.col("type") == "IMAGE"), F.col("file_size")).otherwise(0)).alias("usage_photos"),
        F.sum(F.when(own & (F.col("type") == "VIDEO"), F.col("file_size")).otherwise(0)).alias("usage_videos"),
    )
    rows = users.where("NOT is_deleted").join(sums, users["id"] == sums["owner_id"], "left")
    return rows.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("photos", "videos", "usage", "usage_photos", "usage_videos")), "quota")


def quota_usage(users: DataFrame, assets: DataFrame, exif: DataFrame) -> DataFrame:
    """Bytes in use by each active user, trashed assets included, libraries left out."""
    sizes = exif.select(F.col("asset_id").alias("id"), "file_size")
    sums = assets.where("library_id IS NULL").join(sizes, "id").groupBy("owner_id").agg(F.sum("file_size").alias("usage"))
    return users.where("NOT is_deleted").join(sums, users["id"] == sums["owner_id"], "left").select("id", F.coalesce("usage", F.lit(0)).alias("usage"))


def library_stats(libraries: DataFrame, assets: DataFrame, exif: DataFrame) -> DataFrame:
    """Photos, videos, all and bytes of each library; an empty one has zeros."""
    sizes = exif.select(F.col("asset_id").alias("id"), "file_size")
    live = assets.where("library_id IS NOT NULL AND deleted_at IS NULL").join(sizes, "id", "left")
    sums = live.groupBy("library_id").agg(
        count_if("type = 'IMAGE' AND visibility <> 'hidden'").alias("photos"), count_if("type = 'VIDEO' AND visibility <> 'hidden'").alias("videos"), F.sum("file_size").alias("usage"), F.count("*").alias("total")
    )
    rows = libraries.join(sums, libraries["id"] == sums["library_id"], "left")
    return rows.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("photos", "videos", "usage", "total")))


def album_metadata(members: DataFrame, assets: DataFrame) -> DataFrame:
    """First and last local day, last change and number of each album's visible assets that are not deleted."""
    live = assets.where("deleted_at IS NULL").where(filters.default_visible()).select(F.col("id").alias("asset_id"), "local_date_time", "updated_at")
    return members.join(live, "asset_id").groupBy("album_id").agg(
        F.min("local_date_time").cast("date").alias("start"), F.max("local_date_time").cast("date").alias("end"), F.max("updated_at").cast("date").alias("changed"), F.count("*").alias("count")
    )


def people(persons: DataFrame, faces: DataFrame, assets: DataFrame, users: DataFrame, default: int = 3) -> DataFrame:
    """People with a name, or with as many faces on timeline assets as their owner's preference asks for.

    In ``place`` order within an owner: favourites, then the named, then by faces.
    """
    shown = faces.where("is_visible AND deleted_at IS NULL AND person_id IS NOT NULL").join(
        assets.where("visibility = 'timeline' AND deleted_at IS NULL").select(F.col("id").alias("asset_id")), "asset_id", "left_semi"
    )
    counts = shown.groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("asset_id").alias("faces"))
    least = users.select(F.col("id").alias("owner_id"), scalar.preference(F.col("preferences"), "$.people.minimumFaces", default).alias("least"))
    rows = persons.join(counts, "id").join(least, "owner_id", "left")
    return rows.where((F.col("name") != "") | (F.col("faces") >= F.coalesce("least", F.lit(default)))).drop("least")


def buckets_by(rows: DataFrame, by: list[str], unit: str = "month") -> DataFrame:
    """Counts by bucket of the local time for one place, person or rectangle and so on."""
    return rows.groupBy(*by, scalar.truncated(F.col("local_date_time"), unit).alias("bucket")).agg(F.count("*").alias("count"))


def rollup(assets: DataFrame, exif: DataFrame) -> DataFrame:
    """Counts and bytes by owner, type and month with subtotals, in one pass; ``level`` tells the grouping."""
    rows = assets.where("deleted_at IS NULL").join(exif.select(F.col("asset_id").alias("id"), "file_size"), "id", "left")
    rows = rows.withColumn("month", scalar.truncated(F.col("local_date_time"), "month"))
    return rows.rollup("owner_id", "type", "month").agg(F.count("*").alias("count"), F.sum("file_size").alias("bytes"), F.grouping_id().alias("level"))
