"""Readers of place dumps, country outlines and file listings, and a writer of files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.functions import scalar


def load_places(spark: SparkSession, cities: str, admin1: str, admin2: str) -> DataFrame:
    """Places of a tab-separated dump with the names of their regions.

    Columns 0, 1, 3, 4, 5, 7, 8, 10, 11 and 18 count. Sections of places (PPLX) stay in
    Australia only, historical ones (PPLH) go. Unknown regions are null.
    """
    raw = spark.read.schema(", ".join(f"c{k} string" for k in range(19))).csv(cities, sep="\t", quote="")
    rows = raw.where("c7 IS NULL OR (c7 <> 'PPLH' AND (c7 <> 'PPLX' OR c8 = 'AU'))")

    def names(path: str, name: str) -> DataFrame:
        return spark.read.schema(f"key_{name} string, {name}_name string").csv(path, sep="\t", quote="").dropDuplicates([f"key_{name}"])

    rows = rows.withColumn("key_admin1", F.concat_ws(".", "c8", "c10")).withColumn("key_admin2", F.concat_ws(".", "c8", "c10", "c11"))
    rows = rows.join(names(admin1, "admin1"), "key_admin1", "left").join(names(admin2, "admin2"), "key_admin2", "left")
    return rows.select(
        F.col("c0").cast("long").alias("id"), F.col("c1").alias("name"), F.nullif("c3", F.lit("")).alias("alternate_names"), F.col("c4").cast("double").alias("latitude"), F.col("c5").cast("double").alias("longitude"),
        F.col("c8").alias("country_code"), F.col("c10").alias("admin1_code"), F.col("c11").alias("admin2_code"), "admin1_name", "admin2_name", F.col("c18").cast("date").alias("modified"),
    )


def load_countries(spark: SparkSession, path: str) -> DataFrame:
    """``(admin, admin_a3, part, ring)`` of a feature collection: the outer ring of each polygon."""
    shape = "features array<struct<properties: struct<ADMIN: string, ADM0_A3: string>, geometry: string>>"
    features = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("features").alias("f"))
    kind = F.get_json_object("f.geometry", "$.type")
    text = F.get_json_object("f.geometry", "$.coordinates")
    many = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).otherwise(F.from_json(text, "array<array<array<array<double>>>>"))
    parts = features.select(F.col("f.properties.ADMIN").alias("admin"), F.col("f.properties.ADM0_A3").alias("admin_a3"), F.posexplode(many).alias("part", "polygon"))
    ring = F.transform(F.element_at("polygon", 1), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return parts.select("admin", "admin_a3", "part", ring.alias("ring"))


def file_listing(spark: SparkSession, paths: list[str], exclusions: list[str] = ()) -> DataFrame:
    """``(path, length, modified_at)`` of all files below the paths; hidden ones and those of an exclusion glob are left out.

    The globs do not regard case. Contents are not read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", F.col("modificationTime").alias("modified_at"))
    # a file counts as some MB, so a scan has a task for every few; here a row is all there is of it
    rows = rows.coalesce(spark.sparkContext.defaultParallelism)
    # only what is below a root can be hidden, not the root itself
    roots = [re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", p).rstrip("/") for p in paths]
    below = F.coalesce(*(F.when(F.instr("path", r) > 0, F.substr("path", F.instr("path", r) + len(r))) for r in roots), F.col("path"))
    rows = rows.where(~below.rlike(r"(^|/)\.[^/]"))
    for glob in exclusions:
        rows = rows.where(~F.lower("path").like(scalar.glob_to_like(glob).lower()))
    return rows


def write_files(rows: DataFrame, root: str) -> int:
    """Writes each ``content`` (binary) of ``rows`` as the file ``name`` below ``root``, and returns how many.

    Tasks write their files themselves, so nothing is gathered or moved on the driver; equal
    names are in one task. A task that is tried again writes the same files again.
    """
    parts = rows.sparkSession.sparkContext.defaultParallelism

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pf.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                path = f"{top.rstrip('/')}/{name}"
                if (folder := path.rpartition("/")[0]) not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(path, compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = rows.select("name", "content").repartition(parts, "name").mapInArrow(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
