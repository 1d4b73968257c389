"""Mutations as table transforms: upserts, locks, trash, cascades and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], columns: list[str] | None = None, keep: bool = False) -> DataFrame:
    """``base`` with the rows of ``delta`` put in; of repeated keys in ``delta`` any one counts.

    Known keys take ``columns`` (all others by default) from the delta, or with ``keep``
    nothing; new keys come in whole.
    """
    rest = [c for c in base.columns if c not in keys]
    take = set() if keep else set(columns if columns is not None else rest)
    new = delta.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in rest)).dropDuplicates(keys).withColumn("_new", F.lit(True))
    both = base.withColumn("_old", F.lit(True)).join(new, keys, "full")
    value = [F.when(F.col("_new").isNotNull() & (F.col("_old").isNull() | F.lit(c in take)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in rest]
    return both.select(*keys, *value)


def upsert_camera(base: DataFrame, delta: DataFrame, key: str, behavior: str, locks: str = "locked") -> DataFrame:
    """Camera data merged column by column under locks.

    ``override`` takes every column of the delta. ``skip`` leaves columns that the row has
    locked. ``append`` takes every column and locks those that the delta names. Columns
    that the delta lacks stay; rows it has first come in whole. Empty locks are null.
    """
    fields = [c for c in delta.columns if c not in (key, locks)]
    new = delta.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields), *([F.col(locks).alias("_new_locks")] if locks in delta.columns else []), F.lit(True).alias("_new")).dropDuplicates([key])
    both = base.withColumn("_old", F.lit(True)).join(new, key, "full")
    out = [F.col(key)]
    for c in base.columns:
        if c == key:
            continue
        if c == locks:
            added = F.coalesce(F.col("_new_locks"), F.array().cast("array<string>")) if locks in delta.columns else F.array().cast("array<string>")
            union = F.array_union(F.coalesce(F.col(c), F.array().cast("array<string>")), added)
            out.append((F.when(F.size(union) > 0, F.array_sort(union)) if behavior == "append" else F.col(c)).alias(c))
        elif c in fields:
            held = F.coalesce(F.array_contains(F.col(locks), c), F.lit(False)) & F.col("_old").isNotNull() if behavior == "skip" else F.lit(False)
            out.append(F.when(F.col("_new").isNotNull() & ~held, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def lock(column: str, names: list[str]) -> Column:
    """Locked names with more added; none is null."""
    union = F.array_sort(F.array_union(F.coalesce(F.col(column), F.array().cast("array<string>")), F.array(*map(F.lit, names)).cast("array<string>")))
    return F.when(F.size(union) > 0, union)


def unlock(column: str, names: list[str]) -> Column:
    rest = F.array_except(F.col(column), F.array(*map(F.lit, names)).cast("array<string>"))
    return F.when(F.size(rest) > 0, rest)


def apply_snapshot(base: DataFrame, snapshot: DataFrame, key: str, stamp: str, kept: str = "checksum") -> DataFrame:
    """``(key, change)`` and the new row: inserts, updates where the stamp differs, deletes of what is gone.

    A checksum that is known stays when the snapshot's is missing.
    """
    new = snapshot.select(key, F.col(stamp).alias("_stamp"), F.col(kept).alias("_kept"), F.lit(True).alias("_new"))
    both = base.select(key, stamp, kept, F.lit(True).alias("_old")).join(new, key, "full")
    change = F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull(), "insert").when(~F.col(stamp).eqNullSafe(F.col("_stamp")), "update").otherwise("same")
    return both.select(key, change.alias("change"), F.coalesce("_kept", kept).alias(kept))


def delete_assets(assets: DataFrame, stacks: DataFrame, doomed: DataFrame) -> dict[str, DataFrame]:
    """What goes with deleted assets.

    ``assets``: their ids and motion parts that no other asset shows. ``stacks``: of each
    stack that loses members ``dissolve`` (fewer than two stay) or its leading asset, the
    first that stays if the old one went.
    """
    gone = doomed.select("id").distinct()
    motion = assets.join(gone, "id", "left_semi").where("live_photo_video_id IS NOT NULL").select(F.col("live_photo_video_id").alias("id"))
    shown = assets.join(gone, "id", "left_anti").where("live_photo_video_id IS NOT NULL").select(F.col("live_photo_video_id").alias("id"))
    whole = gone.unionByName(motion.join(shown, "id", "left_anti")).distinct()
    members = assets.where("stack_id IS NOT NULL").select("id", "stack_id").join(whole.withColumn("gone", F.lit(True)), "id", "left")
    left = members.groupBy("stack_id").agg(F.count_if(F.col("gone").isNull()).alias("left"), F.count_if(F.col("gone").isNotNull()).alias("lost"), F.min(F.when(F.col("gone").isNull(), F.col("id"))).alias("first")).where("lost > 0")
    led = left.join(stacks.select(F.col("id").alias("stack_id"), "primary_asset_id"), "stack_id").join(whole.select(F.col("id").alias("primary_asset_id"), F.lit(True).alias("lead_gone")), "primary_asset_id", "left")
    lead = F.when(F.col("left") >= 2, F.when(F.col("lead_gone").isNotNull(), F.col("first")).otherwise(F.col("primary_asset_id")))
    return {"assets": whole, "stacks": led.select("stack_id", (F.col("left") < 2).alias("dissolve"), lead.alias("primary_asset_id"))}


def deleted_files(gone: DataFrame, assets: DataFrame, files: DataFrame, on_disk: bool = True) -> DataFrame:
    """``(asset_id, path)``: files that go with assets: what was made from them, and, ``on_disk``, the originals and sidecars of those that are online."""
    rows = assets.join(gone.select("id"), "id", "left_semi").select(F.col("id").alias("asset_id"), "original_path", "is_offline")
    made = files.join(rows, "asset_id")
    own = F.lit(on_disk) & ~F.col("is_offline")
    made = made.where((F.col("type") != "sidecar") | own).select("asset_id", "path")
    return made.unionByName(rows.where(own).select("asset_id", F.col("original_path").alias("path"))).where("path IS NOT NULL")


def usage_freed(gone: DataFrame, assets: DataFrame, exif: DataFrame) -> DataFrame:
    """``(owner_id, bytes)`` that owners' usage falls by: assets of libraries were never counted."""
    rows = assets.where("library_id IS NULL").join(gone.select("id"), "id", "left_semi").select("id", "owner_id")
    sizes = exif.select(F.col("asset_id").alias("id"), "file_size")
    return rows.join(sizes, "id", "left").groupBy("owner_id").agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def last_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(o).desc() for o in order)))
    return df.withColumn("_last", rank).where("_last = 1").drop("_last")
