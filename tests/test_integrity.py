"""Checksum scans of real files: outcomes, budgets in bytes, resumption, what is not read."""

import datetime
import hashlib
import os

import pytest

from photolake.operators import integrity
from photolake.sources import files

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    """40 files of 10 to 49 bytes; some changed, some gone, some of one second."""
    root = tmp_path / "lib"
    root.mkdir()
    rows, outcome = [], {}
    for i in range(40):
        data = b"x" * (10 + i)
        path = root / f"f{i}.jpg"
        sha = hashlib.sha1(data).hexdigest()
        path.write_bytes(data if i % 5 else b"y" * (10 + i))
        at = DAY + datetime.timedelta(days=i // 12, seconds=i // 4, microseconds=7 * (i % 4))
        rows.append((i, f"file:{path}", None if i == 13 else sha.upper() if i % 2 else sha, at, i % 11 == 0))
        if i % 9 == 4:
            path.unlink()
        outcome[i] = "missing" if i % 9 == 4 else "ok" if i % 5 else "mismatch"
    assets = spark.createDataFrame(rows, "id long, path string, checksum string, created_at timestamp_ntz, is_external boolean")
    checked = {i: outcome[i] for i in range(40) if i % 11 and i != 13}
    return assets, root, checked


def test_outcomes(spark, folder):
    assets, root, checked = folder
    found = integrity.checksum_scan(assets, files.file_listing(spark, [str(root)])).collect()
    assert {r.id: r.outcome for r in found} == checked
    assert all(r.length == (None if r.outcome == "missing" else 10 + r.id) for r in found)


def test_budgets_and_resumption(spark, folder):
    assets, root, checked = folder
    listing = files.file_listing(spark, [str(root)])
    after, seen, steps = None, {}, 0
    while found := integrity.checksum_scan(assets, listing, after, 150).collect():
        sizes = [r.length or 0 for r in sorted(found, key=lambda r: (r.created_at, r.id))]
        read = sum(sizes)
        # the file that reaches the budget is the last with bytes
        assert read >= 150 or max(r.id for r in found) == max(checked)
        assert read - next((x for x in reversed(sizes) if x), 0) < 150
        assert not seen.keys() & {r.id for r in found}
        seen |= {r.id: r.outcome for r in found}
        after, steps = max((r.created_at, r.id) for r in found), steps + 1
    assert seen == checked and steps > 5


def test_files_past_the_budget_are_not_opened(spark, folder):
    assets, root, checked = folder
    listing = spark.createDataFrame(files.file_listing(spark, [str(root)]).collect())
    first = integrity.checksum_scan(assets, listing, None, 120)
    last = max(r.id for r in first.collect())
    # a file that was opened and is not there would be missing, yet the listing has it
    for i in range(last + 1, 40):
        (root / f"f{i}.jpg").unlink(missing_ok=True)
    assert {r.id: r.outcome for r in integrity.checksum_scan(assets, listing, None, 120).collect()} == {i: o for i, o in checked.items() if i <= last}


def test_unreadable_files_are_reported(spark, folder):
    assets, root, checked = folder
    os.unlink(root / "f1.jpg")
    (root / "f1.jpg").mkdir()
    listing = spark.createDataFrame([(f"file:{root}/f1.jpg", 11), (f"file:{root}/f2.jpg", 12)], "path string, length long")
    found = {r.id: r.outcome for r in integrity.checksum_scan(assets.where("id IN (1, 2, 3)"), listing).collect()}
    assert found == {1: "mismatch", 2: "ok", 3: "missing"}


def test_reports(spark):
    outcomes = spark.createDataFrame([(1, "/a", "ok"), (2, "/b", "mismatch"), (3, "/c", "missing"), (4, "/d", "mismatch")], "id long, path string, outcome string")
    reports = spark.createDataFrame([(10, "/a", "checksum_mismatch"), (11, "/b", "checksum_mismatch"), (12, "/c", "checksum_mismatch"), (13, "/a", "missing_file")], "id long, path string, type string")
    found = integrity.checksum_reports(outcomes, reports)
    assert sorted(r.id for r in found["cleared"].collect()) == [10, 12]
    assert [tuple(r) for r in found["new"].collect()] == [("/d", "checksum_mismatch", 4)]


def test_no_assets_and_no_files(spark, folder):
    assets, root, checked = folder
    empty = spark.createDataFrame([], "path string, length long")
    assert integrity.checksum_scan(assets.limit(0), empty, None, 100).collect() == []
    assert {r.outcome for r in integrity.checksum_scan(assets, empty, None, 100).collect()} == {"missing"}
