"""Timelines: buckets, pages, heatmaps, memories and first-of-group picks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.functions import scalar
from photolake.operators import filters
from photolake.session import stored


def timeline_assets(assets: DataFrame, trashed: bool = False, visibility: str | None = None, **tests: dict) -> DataFrame:
    """Assets of the timeline: not deleted (or only the trashed), visible by default or of one visibility.

    ``tests`` are comparisons of further columns, as ``is_favorite={"eq": True}``.
    """
    rows = assets.where(F.col("deleted_at").isNotNull() & (F.col("status") != "deleted") if trashed else F.col("deleted_at").isNull())
    for name, test in tests.items():
        rows = rows.where(filters.compare(F.col(name), **test))
    return rows.where(filters.default_visible() if visibility is None else F.col("visibility") == visibility)


def stacked(assets: DataFrame, stacks: DataFrame, members: DataFrame) -> DataFrame:
    """Assets that have no stack or lead it, with ``stack``: its id and how many of ``members`` on the timeline it has, as text; null without such."""
    n = members.where("stack_id IS NOT NULL AND deleted_at IS NULL AND visibility = 'timeline'").groupBy("stack_id").agg(F.count("*").alias("n"))
    pair = F.when(F.col("n").isNotNull(), F.array(F.col("stack_id").cast("string"), F.col("n").cast("string")))
    return stack_primaries(assets, stacks).join(n, "stack_id", "left").withColumn("stack", pair).drop("n")


def stack_primaries(assets: DataFrame, stacks: DataFrame) -> DataFrame:
    """Assets without a stack, and those that lead theirs."""
    lead = stacks.select(F.col("id").alias("stack_id"), F.col("primary_asset_id").alias("lead"))
    return assets.join(lead, "stack_id", "left").where("stack_id IS NULL OR lead = id").drop("lead")


def time_buckets(assets: DataFrame, unit: str = "month", by: str = "local_date_time", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts by bucket of local or creation time, and by ``keys``."""
    return assets.groupBy(*keys, scalar.truncated(F.col(by), unit).alias("bucket")).agg(F.count("*").alias("count"))


def _field(name: str, x: Column) -> Column:
    return x[name]


def bucket_page(assets: DataFrame, exif: DataFrame, viewer: Column | None = None, most: int = 10_000) -> DataFrame:
    """One row for each owner and month: parallel arrays in the order of local day, then time taken, newest first.

    Arrays stay aligned because whole structs are collected, nulls included. A page holds
    at most ``most`` assets, the newest; further ones form pages 1, 2 and so on, so no
    month, however large, is collected into one row. Assets of ``stacked`` have a column
    ``stack``, which is then an array of the page as well.
    """
    month = scalar.truncated(F.col("local_date_time"), "month")
    place = exif.select(F.col("asset_id").alias("id"), "city", "country")
    rows = assets.withColumn("bucket", month).join(place, "id", "left")
    order = Window.partitionBy("owner_id", "bucket").orderBy(F.col("local_date_time").cast("date").desc(), F.col("file_created_at").desc(), F.col("id").desc())
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("page", F.floor((F.col("at") - 1) / most))
    own = F.lit(True) if viewer is None else F.col("owner_id") == viewer
    more = ["stack"] if "stack" in assets.columns else []
    item = F.struct(
        "at", "id", (F.col("is_favorite") & own).alias("is_favorite"), scalar.aspect_ratio(F.col("width"), F.col("height")).alias("ratio"),
        scalar.offset_hours(F.col("local_date_time"), F.col("file_created_at")).alias("offset"), F.base64(F.unhex("thumbhash")).alias("thumbhash"), "city", "country", *more,
    )
    page = rows.groupBy("owner_id", "bucket", "page").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return page.select("owner_id", "bucket", "page", *(F.transform("items", partial(_field, c)).alias(c) for c in ("id", "is_favorite", "ratio", "offset", "thumbhash", "city", "country", *more)))


def heatmap(assets: DataFrame, start: str, end: str, by: str = "local_date_time") -> DataFrame:
    """Assets a day and owner from ``start`` up to ``end``, whatever their visibility."""
    rows = assets.where("deleted_at IS NULL").where((F.col(by) >= F.lit(start).cast("timestamp_ntz")) & (F.col(by) < F.lit(end).cast("timestamp_ntz")))
    return rows.groupBy("owner_id", F.col(by).cast("date").alias("day")).agg(F.count("*").alias("count"))


def on_this_day(assets: DataFrame, files: DataFrame, days: list[str], per_year: int = 20) -> DataFrame:
    """For each target day, owner and earlier year up to 20 timeline assets with a preview taken on that month and day.

    Days meet by month and day, so 29 February needs no date of a common year.
    """
    spark = assets.sparkSession
    targets = spark.createDataFrame([(d, int(d[:4]), int(d[5:7]), int(d[8:10])) for d in days], "day string, target_year int, m int, d int")
    rows = assets.where("deleted_at IS NULL AND visibility = 'timeline'").select("id", "owner_id", "local_date_time", F.year("local_date_time").alias("year"), F.month("local_date_time").alias("m"), F.dayofmonth("local_date_time").alias("d"))
    rows = rows.join(F.broadcast(targets), ["m", "d"]).where("year < target_year")
    rows = rows.join(files.where("type = 'preview'").select(F.col("asset_id").alias("id")).distinct(), "id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("day", "owner_id", "year").orderBy(F.col("local_date_time").desc(), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_year).select("day", "owner_id", "year", "rank", "id")


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each group, the first by ``order``."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")


def recent(assets: DataFrame, n: int) -> DataFrame:
    """The newest images of each owner."""
    rank = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.col("created_at").desc(), "id"))
    return assets.where("deleted_at IS NULL AND type = 'IMAGE'").where(filters.default_visible()).withColumn("rank", rank).where(F.col("rank") <= n)


def archive_names(assets: DataFrame) -> DataFrame:
    """Names inside an owner's archive: repeats become ``name+1.ext``, in the order of ids."""
    name = F.col("original_file_name")
    n = F.row_number().over(Window.partitionBy("owner_id", "original_file_name").orderBy("id")) - 1
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return assets.withColumn("n", n).withColumn("archive_name", F.when(F.col("n") > 0, F.concat(stem, F.lit("+"), F.col("n").cast("string"), ext)).otherwise(name)).drop("n")


def storage_paths(assets: DataFrame, template: str) -> DataFrame:
    """Destination of each asset; where several have the same, all but the first get ``+1``, ``+2``."""
    ext = scalar.extension(F.col("original_file_name"))
    ext = F.when(ext == "jpeg", "jpg").when(ext == "tiff", "tif").otherwise(ext)
    base = scalar.storage_path(template, F.col("local_date_time"), filename=F.regexp_replace("original_file_name", r"\.[^.]*$", ""))
    rows = assets.select("id", "owner_id", base.alias("base"), ext.alias("ext"))
    n = F.row_number().over(Window.partitionBy("owner_id", "base", "ext").orderBy("id")) - 1
    return rows.withColumn("n", n).select("id", "owner_id", F.concat(F.lit("/library/"), F.col("owner_id").cast("string"), F.lit("/"), "base", F.when(F.col("n") > 0, F.concat(F.lit("+"), F.col("n").cast("string"))).otherwise(""), F.lit("."), "ext").alias("path"))


def _next_bins(sums: np.ndarray, target: int) -> np.ndarray:
    """Where the bin after one that begins at each place begins; as many as there are sizes where none does."""
    return np.minimum(np.searchsorted(sums, sums[:-1] + target, side="right"), len(sums) - 1)


def _block_steps(sums: np.ndarray, target: int) -> tuple[list[int], list[int | None], list[int]]:
    """What a block does with each size carried into its first bin, from running sums (0 first): ``(above, left, closed)``.

    The first entry below a carried size says what is left in the open bin (null: the
    carried size and the whole block) and how many bins the block closes.
    """
    n = len(sums) - 1
    jump, places = _next_bins(sums, target), np.arange(n)
    jump = np.where(jump < n, jump, places)
    closed = (jump != places).astype(np.int64)
    while closed[jump].any():
        closed, jump = closed + closed[jump], jump[jump]
    left = sums[n] - sums[jump]
    # a carried size over the target closes its bin at once, others at the first sum that takes them over it
    ends = np.arange(1, n)
    ends = ends[(sums[1:n] > sums[: n - 1]) & (sums[: n - 1] <= target)]
    above = [target, *(target - sums[ends]).tolist(), -1]
    lefts = [*left[:1].tolist(), *left[ends].tolist(), None]
    bins = [*(closed[:1] + 1).tolist(), *(closed[ends] + 1).tolist(), 0]
    keep = [i for i in range(len(above)) if i + 1 == len(above) or (lefts[i], bins[i]) != (lefts[i + 1], bins[i + 1])]
    return [above[i] for i in keep], [lefts[i] for i in keep], [bins[i] for i in keep]


def split_archives(assets: DataFrame, target: int, block: int = 1_000_000) -> DataFrame:
    """``(owner_id, id, archive)``: greedy bins in the order of ids; a bin closes once its size is over the target.

    A running sum that starts anew is no plain window, so rows are range-sorted into
    blocks of about ``block``, which all at once work out what each size carried into
    them leads to. Only these steps, few as greedy bins soon fall in step, are gone
    through in an owner's order; then all blocks number their rows. Null sizes are 0.
    """
    rows = assets.select("owner_id", "id", F.coalesce("file_size", F.lit(0)).cast("long").alias("size"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / block))
    blocks = stored(rows.repartitionByRange(parts, "owner_id", "id").withColumn("part", F.spark_partition_id()), "archive-blocks")

    def sums_of(rows: pd.DataFrame) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(rows["size"].to_numpy(np.int64))])

    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        sums = sums_of(rows)
        above, left, closed = _block_steps(sums, target)
        return pd.DataFrame({"owner_id": [rows["owner_id"].iloc[0]], "part": [rows["part"].iloc[0]], "total": [sums[-1]], "above": [above], "left": [left], "closed": [closed]})

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, used, archive = None, 0, 0
        for batch in batches:
            entries = []
            for row in batch.to_pylist():
                if row["owner_id"] != owner:
                    owner, used, archive = row["owner_id"], 0, 0
                entries.append((used, archive))
                i = next(i for i, a in enumerate(row["above"]) if used > a)
                used = used + row["total"] if row["left"][i] is None else row["left"][i]
                archive += row["closed"][i]
            found = [pa.array(x, pa.int64()) for x in zip(*entries)] if entries else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("owner_id"), batch.column("part"), *found], names=["owner_id", "part", "used", "archive"])

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        sums, used = sums_of(rows), int(rows["used"].iloc[0])
        n, then = len(rows), _next_bins(sums, target).tolist()
        at = 0 if used > target else int(np.searchsorted(sums, target - used, side="right"))
        begins = np.zeros(n, np.int64)
        while at < n:
            begins[at] = 1
            at = then[at]
        return rows[["owner_id", "id"]].assign(archive=rows["archive"].to_numpy() + np.cumsum(begins))

    kinds = {x: rows.schema[x].dataType.simpleString() for x in ("owner_id", "id")}
    found = blocks.groupBy("owner_id", "part").applyInPandas(steps, f"owner_id {kinds['owner_id']}, part int, total long, above array<long>, left array<long>, closed array<long>")
    entries = found.repartition("owner_id").sortWithinPartitions("owner_id", "part").mapInArrow(carry, f"owner_id {kinds['owner_id']}, part int, used long, archive long")
    entries = entries.withColumnsRenamed({"owner_id": "of", "part": "in"})
    joined = blocks.join(entries, blocks["owner_id"].eqNullSafe(entries["of"]) & (blocks["part"] == entries["in"])).drop("of", "in")
    return joined.groupBy("owner_id", "part").applyInPandas(number, f"owner_id {kinds['owner_id']}, id {kinds['id']}, archive long")
