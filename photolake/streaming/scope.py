"""What members of albums are sent: updates of what they were given, while they are members, and the history of what is new to them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Updates of a range of ids, and how many ranges there are at most.
RANGE_ROWS, RANGES = 1_000_000, 64
#: The extra id that tells that a share's history has been sent to its end.
COMPLETE = "complete"


def _bounds(ids: DataFrame, column: str) -> list[str]:
    """Ids that part all of ``ids`` into about equal ranges of ``RANGE_ROWS``, few enough to travel with tasks."""
    n = min(RANGES, math.ceil(ids.count() / RANGE_ROWS))
    if n < 2:
        return []
    parts = ids.select(column).repartitionByRange(n, column).groupBy(F.spark_partition_id().alias("p")).agg(F.min(column).alias("low"))
    return sorted(r.low for r in parts.collect())[1:]


def _range(column: Column, bounds: list[str]) -> Column:
    """The range that an id lies in."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= column)) if bounds else F.lit(0)


def during(events: DataFrame, spans: DataFrame, key: str, at: str = "update_id", since: str = "create_id", until: str = "delete_id") -> DataFrame:
    """Events of ``key`` with each span of it that they lie in: after ``since``, and before ``until`` or with that null.

    Ids are parted into ranges; an event is in one and a span in those that it reaches.
    They are joined by key and range, so the rows of one key, however hot, are spread
    over the ranges, and an event only meets spans that are open about its own time.
    Events without an id, and spans without a beginning, match nothing.
    """
    bounds = _bounds(events, at)
    last = F.when(F.col(until).isNull(), len(bounds)).otherwise(_range(F.col(until), bounds))
    open_in = spans.where(F.col(since).isNotNull()).withColumn("_range", F.explode(F.sequence(_range(F.col(since), bounds), F.greatest(last, _range(F.col(since), bounds)))))
    found = events.where(F.col(at).isNotNull()).withColumn("_range", _range(F.col(at), bounds)).join(open_in, [key, "_range"])
    return found.where((F.col(at) > F.col(since)) & (F.col(until).isNull() | (F.col(at) < F.col(until)))).drop("_range")


def member_updates(assets: DataFrame, album_assets: DataFrame, shares: DataFrame, acks: DataFrame) -> DataFrame:
    """``(user_id, album_id, asset_id, update_id, is_favorite)``: updates of assets of shared albums, for each member.

    ``assets`` has id, owner_id, update_id and is_favorite; ``album_assets`` album_id,
    asset_id and update_id, that of the asset's coming in; ``shares`` album_id, user_id,
    create_id and delete_id, null while it lasts, any number for a member; ``acks``
    user_id, the last membership (``members``) and update (``updates``) acknowledged.

    An update is sent if the member was given the asset, so if its coming in is
    acknowledged, if the update is not, and if it lies between a share's beginning and its
    end. Members who acknowledged no membership are sent none. A favourite shows only to
    the asset's owner.
    """
    given = album_assets.select("album_id", F.col("asset_id").alias("id"), F.col("update_id").alias("added"))
    updates = assets.select("id", "owner_id", "update_id", "is_favorite").join(given, "id")
    known = shares.join(acks.where("members IS NOT NULL").select("user_id", "members", "updates"), "user_id")
    sent = during(updates, known, "album_id").where("added <= members AND (updates IS NULL OR update_id > updates)")
    mine = F.col("is_favorite") & (F.col("owner_id") == F.col("user_id"))
    # spans of a member that touch give an update once
    return sent.select("user_id", "album_id", F.col("id").alias("asset_id"), "update_id", F.coalesce(mine, F.lit(False)).alias("is_favorite")).distinct()


def backfill(shares: DataFrame, rows: DataFrame, acks: DataFrame, now: str) -> DataFrame:
    """``(user_id, create_id, update_id, ...)``: the history of each share that is new to its member, and behind it its ``COMPLETE`` mark.

    ``shares`` has album_id, user_id and create_id; ``rows`` album_id, update_id and what
    is to be sent; ``acks`` user_id, ``upto``, the last acknowledged update of the kind,
    and ``at`` and ``resume``, the backfill's: the share that it stands at and the last
    update of that one, or ``COMPLETE``. Shares before ``at`` are done, and so is it if it
    is complete; else it goes on behind ``resume``. A row's update is at most ``upto``, as
    all later ones come with the feed itself; a member without ``upto`` is sent the whole
    feed and no history. Ids at or past ``now`` wait. A mark has the mark as update_id.
    """
    due = shares.where(F.col("create_id") < now).join(acks.where("upto IS NOT NULL"), "user_id")
    due = due.where("at IS NULL OR create_id >= at").where(~((F.col("create_id") == F.col("at")) & F.coalesce(F.col("resume") == COMPLETE, F.lit(False))) | F.col("at").isNull())
    behind = F.when(F.col("create_id") == F.col("at"), F.col("resume"))
    due = due.withColumn("behind", behind)
    fields = [c for c in rows.columns if c not in ("album_id", "update_id")]
    found = due.join(rows.where(F.col("update_id") < now), "album_id").where("update_id <= upto AND (behind IS NULL OR update_id > behind)")
    marks = due.select("user_id", "album_id", "create_id", F.lit(COMPLETE).alias("update_id"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in fields))
    return found.select("user_id", "album_id", "create_id", "update_id", *fields).unionByName(marks)
