"""Search over assets: the filter tree, sort orders and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.operators import filters

SCALARS = {
    "type": "type", "visibility": "visibility", "favorite": "is_favorite", "offline": "is_offline", "library": "library_id", "owner": "owner_id",
    "make": "make", "model": "model", "lens": "lens_model", "city": "city", "state": "state", "country": "country", "rating": "rating", "iso": "iso",
    "size": "file_size", "taken": "local_date_time", "created": "created_at", "id": "id", "checksum": "checksum", "path": "original_path", "name": "original_file_name", "description": "description",
}


def wide(assets: DataFrame, exif: DataFrame, albums: DataFrame, faces: DataFrame, tags: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each asset with its camera data and flags of what it is linked to.

    Each bridge is reduced to one row an asset before it is joined.
    """
    people = faces.where("person_id IS NOT NULL AND is_visible AND deleted_at IS NULL")

    def flag(bridge: DataFrame, name: str) -> DataFrame:
        return bridge.select(F.col("asset_id").alias("id")).distinct().withColumn(name, F.lit(True))

    rows = assets.join(exif.withColumnRenamed("asset_id", "id"), "id", "left")
    for bridge, name in ((albums, "has_albums"), (people, "has_people"), (tags, "has_tags"), (files.where("type = 'encoded_video'"), "is_encoded")):
        rows = rows.join(flag(bridge, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows


def condition(tree: dict) -> Column:
    """A filter tree as one predicate over ``wide`` rows.

    Fields hold tests (``eq``, ``gte``, ``isin``, ``like`` and so on); all of them hold,
    and with ``or`` at least one of its branches, each again a tree.
    """
    tests = []
    for name, ops in tree.items():
        if name == "or":
            branches = [condition(b) for b in ops]
            tests.append(reduce(lambda a, b: a | b, branches, F.lit(False)) if branches else F.lit(True))
            continue
        column = F.col(SCALARS.get(name, name))
        text = {k: v for k, v in ops.items() if k in ("like", "not_like", "starts", "ends")}
        rest = {k: v for k, v in ops.items() if k not in text}
        if text:
            tests.append(filters.pattern(column, **text))
        if rest:
            tests.append(filters.compare(column, **rest))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def ordered(df: DataFrame, by: str = "taken", descending: bool = True) -> DataFrame:
    """Sorted by time taken, time added, size or rating and then id; camera data sort nulls last."""
    column = F.col({"taken": "file_created_at", "local": "local_date_time", "added": "created_at", "size": "file_size", "rating": "rating"}[by])
    last = by in ("size", "rating")
    sort = (column.desc_nulls_last() if last else column.desc_nulls_first()) if descending else column.asc_nulls_last()
    return df.orderBy(sort, F.col("id").desc() if descending else F.col("id").asc())


def page(df: DataFrame, number: int, size: int, by: str = "taken", descending: bool = True) -> DataFrame:
    """Page ``number`` (from 1), and in ``has_next`` whether more follow: one row more than a page is asked for."""
    rows = ordered(df, by, descending).offset((number - 1) * size).limit(size + 1)
    # the window sees at most one page and a row
    n = F.count("*").over(Window.partitionBy())
    column = F.col({"taken": "file_created_at", "local": "local_date_time", "added": "created_at", "size": "file_size", "rating": "rating"}[by])
    last = by in ("size", "rating")
    sort = (column.desc_nulls_last() if last else column.desc_nulls_first()) if descending else column.asc_nulls_last()
    at = F.row_number().over(Window.orderBy(sort, F.col("id").desc() if descending else F.col("id").asc()))
    return rows.withColumn("has_next", n > size).withColumn("at", at).where(F.col("at") <= size)


def keyset(df: DataFrame, cursor: int | None, size: int) -> DataFrame:
    """Rows from an id downwards; the last row's ``next`` is the id that the next page begins with."""
    rows = (df if cursor is None else df.where(F.col("id") <= cursor)).orderBy(F.col("id").desc()).limit(size + 1)
    at = Window.orderBy(F.col("id").desc())
    return rows.withColumn("at", F.row_number().over(at)).withColumn("next", F.lead("id").over(at)).where(F.col("at") <= size)


def sample(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """A random sample of ``n`` rows by a seeded digest of the id, so that reruns agree."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), "id").limit(n)


def suggestions(df: DataFrame, field: str) -> DataFrame:
    """Distinct values of a field that are not empty."""
    return df.select(F.col(field).alias("value")).where("value IS NOT NULL AND value <> ''").distinct()
