"""The change feed and streams of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolake.streaming.changes import REQUESTS, position


def upserts(rows: DataFrame, acks: DataFrame, now_id: str, kind: str, owner: str = "owner_id", stamp: str = "update_id") -> DataFrame:
    """``(user_id, type, update_id, id)``: rows changed since each user's last acknowledgement and before ``now_id``.

    The upper bound leaves rows of transactions in flight to the next round, so none is skipped.
    """
    mine = acks.where(F.col("type") == kind).select("user_id", "ack")
    fresh = rows.where(F.col(stamp) < now_id).withColumnRenamed(owner, "user_id").join(mine, "user_id", "left")
    return fresh.where(F.col("ack").isNull() | (F.col(stamp) > F.col("ack"))).select("user_id", F.lit(kind).alias("type"), F.col(stamp).alias("update_id"), "id")


def change_feed(changes: DataFrame, store: DataFrame, now_id) -> DataFrame:
    """``changes`` that each user has not acknowledged, with their ``position`` in the order of ``REQUESTS``.

    ``changes`` has user_id, type, update_id, id and is_delete; deletes come from the
    audit log, whose own ids stand in update_id and are acknowledged apart (their type in
    the store ends in ``Delete``). ``store`` has session_id, type and ack. Rows at or past
    ``now_id`` wait for the next round, and kinds that are no request are never sent.
    """
    rows = changes.withColumn("position", F.array_position(F.array(*map(F.lit, REQUESTS)), F.col("type"))).where((F.col("position") > 0) & (F.col("update_id") < now_id))
    rows = rows.withColumn("ack_type", F.when(F.col("is_delete"), F.concat("type", F.lit("Delete"))).otherwise(F.col("type")))
    acks = store.select(F.col("session_id").alias("user_id"), F.col("type").alias("ack_type"), "ack")
    rows = rows.join(acks, ["user_id", "ack_type"], "left").where("ack IS NULL OR update_id > ack")
    return rows.select("user_id", "position", "type", "update_id", "id", "is_delete")


def ack_store(store: DataFrame, acks: DataFrame) -> DataFrame:
    """``(session_id, type, ack)`` after ``acks`` (session_id, line, at): the last line of each session and type wins, smaller or not.

    A line is ``type|update_id[|extra]``, and what follows the type is kept whole.
    """
    cut_at = F.instr("line", "|")
    said = acks.where(cut_at > 1).select("session_id", F.expr("substr(line, 1, instr(line, '|') - 1)").alias("type"), F.expr("substr(line, instr(line, '|') + 1)").alias("ack"), "at")
    new = said.groupBy("session_id", "type").agg(F.max_by("ack", F.struct("at", "ack")).alias("new"))
    return store.select("session_id", "type", "ack").join(new, ["session_id", "type"], "full").select("session_id", "type", F.coalesce("new", "ack").alias("ack"))


def now_id(now_ms):
    """The upper bound of a round that starts at ``now_ms``: the smallest id of the millisecond before it, so rows in flight wait."""
    from photolake.functions.scalar import uuid7_from_ms

    return uuid7_from_ms(now_ms - 1)


def feed_line(data: Column, kind: Column, update_id: Column, extra: Column | None = None) -> Column:
    """One JSON line: type, data and the acknowledgement ``type|update_id[|extra]``."""
    ack = F.concat_ws("|", kind, update_id, *([extra] if extra is not None else []))
    return F.to_json(F.struct(kind.alias("type"), data.alias("data"), ack.alias("ack")))


def _lines(df: DataFrame) -> DataFrame:
    """``(user_id, value)``: JSON lines, a user's together in the order of ``position``, or else of the feed's entities."""
    lines = df.withColumn("order", F.col("position") if "position" in df.columns else position(F.col("type"))).repartition("user_id").sortWithinPartitions("user_id", "order", "update_id")
    return lines.select("user_id", feed_line(F.col("data"), F.col("type"), F.col("update_id")).alias("value"))


def write_feed(df: DataFrame, path: str) -> None:
    """Writes rows with user_id, type, update_id and data as JSON lines.

    Lines stand in the order of ``position``, or else of the feed's entities. A user's lines are one file, but for users with
    very many, whose lines AQE may deal over more, each in order.
    """
    _lines(df).write.partitionBy("user_id").text(path)


def write_batch(df: DataFrame, path: str) -> None:
    """As ``write_feed`` for a batch of a stream: Parquet (user_id, value) in which a user's lines stand together, so there are not as many files as users and batches.

    The folder is written anew if the batch comes again.
    """
    _lines(df).write.mode("overwrite").parquet(path)


def backfill(shares: DataFrame, rows: DataFrame) -> DataFrame:
    """History of newly shared albums: rows after ``after_id`` up to ``end_id`` of each share."""
    return shares.join(rows, "album_id").where((F.col("after_id").isNull() | (F.col("update_id") > F.col("after_id"))) & (F.col("update_id") <= F.col("end_id")))


def needs_reset(acks: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Whether each user's last acknowledgement (milliseconds in ``acked_ms``) is too old to go on from."""
    return acks.withColumn("reset", F.coalesce(F.col("acked_ms") < now_ms - days * 86_400_000, F.lit(False)))


def apply_feed(table: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """``table`` after the feed: of each key the last event counts, an upsert or a delete."""
    from photolake.operators.tables import last_per_key

    last = last_per_key(feed, [key], "update_id")
    columns = [c for c in table.columns if c != key]
    kept = table.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("NOT is_delete").select(key, *columns))


def deletions(old: DataFrame, new: DataFrame, key: str, parent: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """Rows of ``old`` that ``new`` lacks; with a parent table only those whose parent is still there."""
    gone = old.join(new.select(key), key, "left_anti")
    if parent is None:
        return gone
    table, column, parent_key = parent
    return gone.join(table.select(F.col(parent_key).alias(column)), column, "left_semi")


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of rows that are new or differ in any other column."""
    columns = sorted(c for c in old.columns if c != key)

    def stamped(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.xxhash64(*columns, *(F.col(c).isNull() for c in columns)).alias(name))

    both = stamped(new, "now").join(stamped(old, "was"), key, "left")
    return both.where(~F.col("now").eqNullSafe(F.col("was"))).select(key)


def windows(events: DataFrame, ts: str, length: str, slide: str | None, *keys: str, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window and keys; rows later than ``late`` no longer count."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "value")


def unique_uploads(uploads: DataFrame, ts: str, keys: list[str], known: DataFrame | None = None, late: str = "1 day") -> DataFrame:
    """The first upload of each checksum of an owner within the watermark that the catalogue does not hold."""
    rows = uploads.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return rows if known is None else rows.join(known.select(*keys).distinct(), keys, "left_anti")
