"""Functions by name: SQL functions of a session, and the steps of workflows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from photolake.functions import scalar
from photolake.operators import filters


def register(spark: SparkSession) -> list[str]:
    """Makes ``pl_unaccent``, ``pl_ratio`` and ``pl_offset_hours`` known to SQL, as SQL expressions and not as Python."""
    source, target = scalar._fold_table()
    made = {
        "pl_unaccent": ("s STRING", "STRING", f"translate(s, '{source}', '{target}')"),
        "pl_ratio": ("w INT, h INT", "DOUBLE", "CASE WHEN coalesce(w, 0) <> 0 AND coalesce(h, 0) <> 0 THEN CAST(round(CAST(w AS DECIMAL(20, 6)) / CAST(h AS DECIMAL(20, 6)), 3) AS DOUBLE) ELSE 1.0D END"),
        "pl_offset_hours": ("l TIMESTAMP, t TIMESTAMP", "DOUBLE", "(unix_timestamp(l) - unix_timestamp(t)) / 3600.0D"),
    }
    for name, (arguments, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(made)


#: Filters say whether a workflow goes on; each takes its own settings.
FILTERS: dict[str, Callable[..., Column]] = {
    "match_name": lambda **o: filters.match_value(F.col("original_file_name"), **o),
    "match_field": lambda field, **o: filters.match_value(F.col(field), **o),
    "near": filters.near,
    "date_window": lambda **o: filters.in_date_window(F.col("local_date_time"), **o),
    "type_in": lambda types: F.col("type").isin(*types),
    "missing_zone": lambda inverse=False: F.col("time_zone").isNotNull() if inverse else F.col("time_zone").isNull(),
}
#: Actions are what changes on an asset that all filters let through.
ACTIONS: dict[str, Callable[..., dict[str, Column]]] = {
    "archive": lambda: {"visibility": F.lit("archive")},
    "lock": lambda: {"visibility": F.lit("locked")},
    "timeline": lambda: {"visibility": F.lit("timeline")},
    "favorite": lambda value=True: {"is_favorite": F.lit(value)},
    "visibility": lambda value: {"visibility": F.lit(value)},
    "album": lambda album_id: {"album_id": F.lit(album_id)},
}


def steps(names: list[tuple[str, dict]]) -> tuple[Column, dict[str, Column]]:
    """The condition of all filters among the steps, and the changes of the actions; later ones win."""
    passes, changes = F.lit(True), {}
    for name, options in names:
        if name in FILTERS:
            passes = passes & F.coalesce(FILTERS[name](**options), F.lit(False))
        else:
            changes |= ACTIONS[name](**options)
    return passes, changes
