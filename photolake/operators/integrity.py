"""Checks of stored files against their recorded digests, and what may be deleted by age."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of files that one task reads, but for a larger file, which has a task of its own; bytes read at once.
TASK_BYTES, CHUNK = 1 << 30, 1 << 22


def _last_of_budget(rows: DataFrame, budget: int) -> tuple | None:
    """(created_at, id) of the file with which the bytes reach ``budget``; None if all files fit.

    Sums of days, then of the seconds of the day in which the budget ends, are short
    lists; rows are only put in order within the second in which it ends.
    """
    left = budget
    within = rows.where("length IS NOT NULL")
    for unit in ("day", "second"):
        sums = sorted((r[0], r[1]) for r in within.groupBy(F.date_trunc(unit, "created_at").alias("u")).agg(F.sum("length")).collect() if r[0] is not None)
        for at, n in sums:
            if n >= left:
                within = within.where(F.date_trunc(unit, "created_at") == F.lit(at))
                break
            left -= n
        else:
            return None
    ahead = F.coalesce(F.sum("length").over(Window.orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = within.withColumn("ahead", ahead).where(F.col("ahead") < left).agg(F.max(F.struct("created_at", "id"))).first()[0]
    return tuple(last)


def checksum_scan(assets: DataFrame, listing: DataFrame, after: tuple | None = None, budget: int | None = None) -> DataFrame:
    """``(created_at, id, path, length, outcome)`` of the next ``budget`` bytes of files: ``ok``, ``mismatch`` or ``missing``.

    ``assets`` has id, path, checksum (SHA-1, hexadecimal), created_at and is_external;
    ``listing`` path and length, as ``sources.files.file_listing`` gives them without
    reading. External assets and those without a checksum are skipped. A scan goes by
    (created_at, id): it begins behind ``after``, and the file with which the bytes reach
    the budget is its last, so the largest (created_at, id) of a result is where to go on.

    Only those files are read, by tasks of about ``TASK_BYTES``, in chunks, so files may
    have any size. A file that is not there has no bytes and is ``missing``; one that
    cannot be read is a ``mismatch``.
    """
    rows = assets.where("NOT is_external AND checksum IS NOT NULL").select("created_at", "id", "path", "checksum").join(listing.select("path", "length"), "path", "left")
    if after is not None:
        rows = rows.where((F.col("created_at") > F.lit(after[0])) | ((F.col("created_at") == F.lit(after[0])) & (F.col("id") > F.lit(after[1]))))
    if budget is not None and (last := _last_of_budget(rows, budget)) is not None:
        rows = rows.where((F.col("created_at") < F.lit(last[0])) | ((F.col("created_at") == F.lit(last[0])) & (F.col("id") <= F.lit(last[1]))))
    total = rows.agg(F.sum("length")).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    # small files are dealt by a hash, large ones one by one
    task = F.when(F.col("length") >= TASK_BYTES // 4, F.xxhash64("path")).otherwise(F.pmod(F.xxhash64("path"), F.lit(parts)))
    dealt = rows.withColumn("task", task).repartition(parts, "task").drop("task")

    def digest(path: str) -> str | None:
        fs, name = pf.FileSystem.from_uri(path)
        sha = hashlib.sha1()
        try:
            with fs.open_input_stream(name) as file:
                while chunk := file.read(CHUNK):
                    sha.update(chunk)
        except FileNotFoundError:
            return None
        except OSError as error:
            return f"unreadable: {error}"
        return sha.hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, there = batch.column("path").to_pylist(), batch.column("length").is_valid().to_pylist()
            found = pa.array([digest(p) if t else None for p, t in zip(paths, there)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "found"])

    found = dealt.mapInArrow(read, T.StructType([*dealt.schema.fields, T.StructField("found", T.StringType())]))
    outcome = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.lower("checksum"), "ok").otherwise("mismatch")
    return found.select("created_at", "id", "path", "length", outcome.alias("outcome"))


def checksum_reports(outcomes: DataFrame, reports: DataFrame) -> dict[str, DataFrame]:
    """After a scan: ``cleared``, ids of checksum reports of files that are whole or gone, and ``new``, mismatches without one.

    ``reports`` has id, path, type.
    """
    held = reports.where("type = 'checksum_mismatch'")
    return {
        "cleared": held.join(outcomes.where("outcome <> 'mismatch'").select("path"), "path", "left_semi").select("id"),
        "new": outcomes.where("outcome = 'mismatch'").join(held.select("path"), "path", "left_anti").select("path", F.lit("checksum_mismatch").alias("type"), F.col("id").alias("asset_id")),
    }


def _days(now: Column, days: int) -> Column:
    return now - F.expr(f"INTERVAL {days} DAYS")


def stale_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions (updated_at, expires_at) not used for 90 days, or expired."""
    return sessions.where((F.col("updated_at") <= _days(now, 90)) | (F.col("expires_at") <= now))


def stale_notifications(notifications: DataFrame, now: Column) -> DataFrame:
    """Notifications (created_at, read_at, deleted_at): deleted 3 days ago, read ones of 15 days, unread ones of 30 days.

    One that was read in the last two days stays.
    """
    deleted = F.coalesce(F.col("deleted_at") < _days(now, 3), F.lit(False))
    read = F.coalesce(F.col("read_at") <= _days(now, 2), F.lit(False)) & (F.col("created_at") < _days(now, 15))
    unread = F.col("read_at").isNull() & (F.col("created_at") < _days(now, 30))
    return notifications.where(deleted | read | unread)


def stale_audit(audit: DataFrame, now: Column, days: int = 31) -> DataFrame:
    """Audit rows (deleted_at) that no client can still ask for."""
    return audit.where(F.col("deleted_at") < _days(now, days))


def deletable_users(users: DataFrame, now: Column, delay: int = 7) -> DataFrame:
    """Users whose deletion was asked for ``delay`` days ago."""
    return users.where(F.col("deleted_at") <= _days(now, delay))
