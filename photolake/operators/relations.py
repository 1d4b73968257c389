"""Assets with the rows that belong to them, nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lists(rows: DataFrame, key: str, name: str, *fields: str) -> DataFrame:
    """One row a key with its rows as a sorted array of structs."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def with_relations(assets: DataFrame, faces: DataFrame, people: DataFrame, tags: DataFrame, tag_assets: DataFrame, files: DataFrame, edits: DataFrame, owners: DataFrame, libraries: DataFrame, stacks: DataFrame) -> DataFrame:
    """``assets`` (id, owner_id, library_id, stack_id) with faces, people, tags, files, edits (arrays), owner, library and stack (structs).

    Faces and people are those of faces that are visible and not deleted; a person comes
    once. A stack has its primary asset and the ids of its assets, the primary one first.
    Each side is one row an asset before it joins; an asset without rows has an empty
    array, one without owner, library or stack a null.
    """
    shown = faces.where("deleted_at IS NULL AND is_visible")
    sides = [
        _lists(shown.withColumnRenamed("id", "face_id"), "asset_id", "faces", "face_id", "person_id", "x1", "y1", "x2", "y2"),
        _lists(shown.select("asset_id", F.col("person_id")).distinct().join(people.select(F.col("id").alias("person_id"), "name", "is_hidden"), "person_id"), "asset_id", "people", "person_id", "name", "is_hidden"),
        _lists(tag_assets.join(tags.select(F.col("id").alias("tag_id"), "value"), "tag_id"), "asset_id", "tags", "value", "tag_id"),
        _lists(files, "asset_id", "files", "type", "path"),
        _lists(edits, "asset_id", "edits", "sequence", "action"),
    ]
    rows = assets.withColumn("asset_id", F.col("id"))
    for side in sides:
        rows = rows.join(side, "asset_id", "left")
    rows = rows.withColumns({x: F.coalesce(x, F.array()) for x in ("faces", "people", "tags", "files", "edits")})
    rows = rows.join(owners.select(F.col("id").alias("owner_id"), F.struct("id", "name", "email").alias("owner")), "owner_id", "left")
    rows = rows.join(libraries.select(F.col("id").alias("library_id"), F.struct("id", F.col("owner_id").alias("library_owner")).alias("library")), "library_id", "left")
    primary = stacks.select(F.col("id").alias("stack_id"), "primary_asset_id")
    in_stack = assets.where("stack_id IS NOT NULL").join(primary, "stack_id").groupBy("stack_id", "primary_asset_id").agg(F.sort_array(F.collect_list(F.struct((F.col("id") != F.col("primary_asset_id")).alias("other"), "id"))).alias("items"))
    stack = in_stack.select("stack_id", F.struct(F.col("stack_id").alias("id"), "primary_asset_id", F.col("items.id").alias("asset_ids")).alias("stack"))
    return rows.join(stack, "stack_id", "left").drop("asset_id")


def flat(column: str, *fields: str) -> Column:
    """An array of structs as text: fields apart by colons, rows by commas."""
    return F.array_join(F.transform(column, lambda r: F.concat_ws(":", *(F.coalesce(r[f].cast("string"), F.lit("-")) for f in fields))), ",")


def duplicate_groups(assets: DataFrame, exif: DataFrame, tags: DataFrame, tag_assets: DataFrame) -> DataFrame:
    """``(duplicate_id, owner_id, items)``: groups of more than one asset, each with its exif and tags, by local time, then id.

    ``assets`` are those that count; stacked ones are left out.
    """
    rows = assets.where("duplicate_id IS NOT NULL AND stack_id IS NULL").select("id", "owner_id", "duplicate_id", "local_date_time")
    of_tags = _lists(tag_assets.join(tags.select(F.col("id").alias("tag_id"), "value"), "tag_id").withColumnRenamed("asset_id", "id"), "id", "tags", "value", "tag_id")
    of_exif = exif.select(F.col("asset_id").alias("id"), F.struct(*[c for c in exif.columns if c != "asset_id"]).alias("exif"))
    rows = rows.join(of_exif, "id", "left").join(of_tags, "id", "left").withColumn("tags", F.coalesce("tags", F.array()))
    groups = rows.groupBy("duplicate_id", "owner_id").agg(F.sort_array(F.collect_list(F.struct("local_date_time", "id", "exif", "tags"))).alias("items"))
    return groups.where(F.size("items") > 1)
