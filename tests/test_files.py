"""Files written by tasks, and their listing."""

import math
from pathlib import Path

from pyspark.sql import functions as F

from photolake.sources import files


def test_files_of_many_rows(spark, tmp_path):
    """Each row a file in the folder that its name says, again the same; a listing has no task for every few files (Spark leaves out empty ones)."""
    rows = [(f"{k % 7}/{k}.bin", bytes([k % 256]) * (k % 50)) for k in range(300)] + [("empty.bin", b""), ("umlaut ü.bin", "ü\n".encode())]
    frame = spark.createDataFrame(rows, "name string, content binary")
    for _ in range(2):
        assert files.write_files(frame, f"file:{tmp_path}/stored") == 302
    found = {str(p.relative_to(tmp_path / "stored")): p.read_bytes() for p in (tmp_path / "stored").rglob("*") if p.is_file()}
    assert found == dict(rows)
    listing = files.file_listing(spark, [f"{tmp_path}/stored"])
    assert listing.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert {r.name: r.length for r in listing.select(F.regexp_extract("path", "/stored/(.*)$", 1).alias("name"), "length").collect()} == {n: len(b) for n, b in rows if b}
    assert files.write_files(frame.limit(0), f"file:{tmp_path}/none") == 0


def test_checksum_query_makes_few_folders(spark, tmp_path):
    """The files of ``jn_checksum`` share folders; contents of all characters and null ones keep their digests."""
    import __spark_entry__
    from photolake.session import shared_dir

    html = [None, "", "a\nb", "ü", "\r\n"]
    pages = spark.createDataFrame([(k - 5, None if k % 2 else "u", html[k % 5]) for k in range(700)] + [(None, "u", "x")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    top = Path(shared_dir(spark).removeprefix("file:"))
    before = set(top.glob("stored-*"))
    found = {r.id: r.outcome for r in __spark_entry__.queries()["jn_checksum"](spark, str(tmp_path)).collect()}
    (root,) = set(top.glob("stored-*")) - before
    assert len([p for p in root.rglob("*") if p.is_dir()]) <= 256
    taken = [k - 5 for k in range(700) if (k - 5) % 6 and math.fmod(k - 5, 31) != 5]
    assert found == {k: "missing" if math.fmod(k, 29) == 4 else "mismatch" if math.fmod(k, 40) == 11 else "ok" for k in taken}
