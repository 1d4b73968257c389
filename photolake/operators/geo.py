"""Places: nearest-place and country lookups by grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolake.functions import scalar


def reverse_geocode(points: DataFrame, places: DataFrame, radius_m: float = 25_000) -> DataFrame:
    """``(id, place_id, city, state, country)``: the nearest place to each point, if one is near.

    A place is near if it lies in the cube around the point whose half side is the chord
    of the radius; the nearest by distance on the sphere counts, then the smallest id.
    Space is cut into cells of that size; each place stands in its own cell and the 26
    around, so a point meets all near places by an equality join and nothing else.
    """
    half = 2 * scalar.EARTH_RADIUS * math.sin(radius_m / (2 * scalar.EARTH_RADIUS))

    def cell(p: Column) -> list[Column]:
        return [F.floor(p[k] / half).alias(f"c{k}") for k in "xyz"]

    here = points.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("id", scalar.earth(F.col("latitude"), F.col("longitude")).alias("p"))
    here = here.select("id", "p", *cell(F.col("p")))
    there = places.select(F.col("id").alias("place_id"), "name", "admin1_name", "country_code", scalar.earth(F.col("latitude"), F.col("longitude")).alias("q")).select("*", *cell(F.col("q")))
    for k in "xyz":
        there = there.withColumn(f"c{k}", F.explode(F.array(*(F.col(f"c{k}") + d for d in (-1, 0, 1)))))
    near = here.join(there, ["cx", "cy", "cz"])
    for k in "xyz":
        near = near.where(F.abs(F.col("p")[k] - F.col("q")[k]) <= half)
    best = near.groupBy("id").agg(F.min_by(F.struct("place_id", "name", "admin1_name", "country_code"), F.struct(scalar.chord(F.col("p"), F.col("q")), F.col("place_id"))).alias("b"))
    return best.select("id", "b.place_id", F.col("b.name").alias("city"), F.col("b.admin1_name").alias("state"), F.col("b.country_code").alias("country"))


def inside(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether a point is inside a closed ring of structs lon, lat: an odd number of edges is crossed."""
    edges = F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)).alias("b"))

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        x = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lon"]
        return F.coalesce(spans & (lon < x), F.lit(False))

    return F.size(F.filter(edges, crossed)) % 2 == 1


def countries(points: DataFrame, polygons: DataFrame, step: int = 10) -> DataFrame:
    """``(id, country)``: the polygon that holds each point, the smallest name of several.

    Polygons stand in every cell of ``step`` degrees that their box meets, so a point is
    tested against those of its own cell.
    """
    lon, lat = F.col("ring.lon"), F.col("ring.lat")
    box = polygons.select("country", "ring", F.array_min(lon).alias("w"), F.array_max(lon).alias("e"), F.array_min(lat).alias("s"), F.array_max(lat).alias("n"))
    box = box.withColumn("cx", F.explode(F.sequence(F.floor(F.col("w") / step), F.floor(F.col("e") / step)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("s") / step), F.floor(F.col("n") / step))))
    here = points.select("id", "latitude", "longitude", F.floor(F.col("longitude") / step).alias("cx"), F.floor(F.col("latitude") / step).alias("cy"))
    hit = here.join(box, ["cx", "cy"]).where(inside(F.col("ring"), F.col("longitude"), F.col("latitude")))
    return hit.groupBy("id").agg(F.min("country").alias("country"))
