"""Filter trees over bitmaps of asset ids: a word of 64 bits for each page of 64 ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolake.functions import scalar, similarity
from photolake.operators import filters
from photolake.operators.groups import tag_closure
from photolake.session import stored

#: The fields of a filter. Columns that are compared, and those that patterns are allowed for.
COLUMNS = {
    "id": "id", "libraryId": "library_id", "type": "type", "visibility": "visibility", "isFavorite": "is_favorite", "isOffline": "is_offline",
    "rating": "rating", "fileSizeInBytes": "file_size", "takenAt": "file_created_at", "createdAt": "created_at", "updatedAt": "updated_at", "trashedAt": "deleted_at", "checksum": "checksum",
    "city": "city", "state": "state", "country": "country", "make": "make", "model": "model", "lensModel": "lens_model",
    "description": "description", "originalFileName": "original_file_name", "originalPath": "original_path",
}
PATTERNS = ("description", "originalFileName", "originalPath")
FLAGS = ("isMotion", "isEncoded", "hasAlbums", "hasPeople", "hasTags")
IDS = ("albumIds", "personIds", "tagIds")
FIELDS = (*COLUMNS, *FLAGS, *IDS, "ocr", "encodedVideoPath")
NAMES = {"in": "isin", "notIn": "not_in", "like": "like", "notLike": "not_like", "startsWith": "starts", "endsWith": "ends"}
#: How similar a text must be to what is looked for in pictures.
OCR_LEAST = 0.5


def word(asset: Column) -> Column:
    """The page of an asset's id, which is 0 or more."""
    return F.shiftright(asset, 6)


def bit(asset: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), asset.bitwiseAND(63).cast("int"))


def postings(album_assets: DataFrame, faces: DataFrame, tags: DataFrame, tag_assets: DataFrame, files: DataFrame) -> DataFrame:
    """``(field, value, word, bits)``: the assets of each album, visible person and tag (with all tags below it), and those that have any; stored in this order.

    A posting has a row for each page, so one that holds a third of all assets is as well
    spread as any.
    """
    shown = faces.where("is_visible AND deleted_at IS NULL")
    above = tag_assets.join(tag_closure(tags).withColumnRenamed("descendant", "tag_id"), "tag_id")
    none = F.lit(None).cast("long")
    rows = [
        album_assets.select(F.lit("albumIds").alias("field"), F.col("album_id").alias("value"), "asset_id"),
        shown.where("person_id IS NOT NULL").select(F.lit("personIds").alias("field"), F.col("person_id").alias("value"), "asset_id"),
        above.select(F.lit("tagIds").alias("field"), F.col("ancestor").alias("value"), "asset_id"),
        *(df.select(F.lit(name).alias("field"), none.alias("value"), "asset_id") for df, name in ((album_assets, "hasAlbums"), (shown, "hasPeople"), (tag_assets, "hasTags"), (files.where("type = 'encoded_video'"), "isEncoded"))),
    ]
    every = reduce(DataFrame.unionByName, (df.select("field", F.col("value").cast("long").alias("value"), F.col("asset_id").cast("long").alias("asset_id")) for df in rows))
    pages = every.groupBy("field", "value", word(F.col("asset_id")).alias("word")).agg(F.bit_or(bit(F.col("asset_id"))).alias("bits"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(pages.repartitionByRange(parts, "field", "value", "word").sortWithinPartitions("field", "value", "word"), "postings")


@dataclass
class Tables:
    """What a tree is evaluated over; ``ocr`` has asset_id and text."""

    assets: DataFrame
    exif: DataFrame
    files: DataFrame
    ocr: DataFrame
    postings: DataFrame


class _Leaves:
    """The tests of a tree by where their rows come from; equal tests are one."""

    def __init__(self) -> None:
        self.sides: dict[str, dict[str, tuple[str, Any]]] = {"assets": {}, "postings": {}, "files": {}, "ocr": {}}

    def add(self, side: str, name: str, test: Any) -> Column:
        own = self.sides[side]
        key = f"{name} {test!r}"
        if key not in own:
            own[key] = (f"{side}_{len(own)}", (name, test))
        return F.coalesce(F.col(own[key][0]), F.lit(0).cast("long"))

    def tests(self, side: str) -> list[tuple[str, Any]]:
        return list(self.sides[side].values())


def _node(tree: dict, leaves: _Leaves) -> Column:
    """A tree as operations on words: all of its fields' bits, and those of at least one branch of ``or``."""
    every = F.lit(-1).cast("long")
    parts = []
    for name, tests in tree.items():
        if name == "or":
            if tests:
                parts.append(reduce(Column.bitwiseOR, (_node(branch, leaves) for branch in tests)))
        elif name in IDS:
            if "any" in tests:
                parts.append(leaves.add("postings", name, tuple(sorted(set(tests["any"])))))
            parts += [leaves.add("postings", name, (value,)) for value in sorted(set(tests.get("all", ())))]
            if "none" in tests:
                parts.append(F.bitwise_not(leaves.add("postings", name, tuple(sorted(set(tests["none"]))))))
        elif name in FLAGS:
            has = leaves.add("assets", name, None) if name == "isMotion" else leaves.add("postings", name, None)
            parts.append(has if tests["eq"] else F.bitwise_not(has))
        elif name == "encodedVideoPath":
            parts.append(leaves.add("files", name, tests))
        elif name == "ocr":
            parts.append(leaves.add("ocr", name, tests["matches"]))
        elif name in COLUMNS:
            if name not in PATTERNS and (wrong := {"like", "notLike", "startsWith", "endsWith"} & set(tests)):
                raise ValueError(f"{name} has no {sorted(wrong)}")
            parts.append(leaves.add("assets", name, tests))
        else:
            raise ValueError(f"{name} is no field of a filter")
    return reduce(Column.bitwiseAND, parts, every)


def _compared(column: Column, tests: dict) -> Column:
    named = {NAMES.get(k, k): v for k, v in tests.items()}
    text = {k: v for k, v in named.items() if k in ("like", "not_like", "starts", "ends")}
    rest = {k: v for k, v in named.items() if k not in text}
    return (filters.pattern(column, **text) if text else F.lit(True)) & filters.compare(column, **rest)


def _pages(rows: DataFrame, asset: str, tests: list[tuple[str, Any]], condition: Callable[[str, Any], Column], more: tuple[Column, ...] = ()) -> DataFrame:
    """The pages of ``rows`` with the bits of those that pass each test."""
    found = [F.bit_or(F.when(condition(*test), bit(F.col(asset)))).alias(column) for column, test in tests]
    return rows.groupBy(word(F.col(asset)).alias("word")).agg(*more, *found)


def search(tables: Tables, tree: dict, owners: list[int] | None = None, with_stacked: bool = True) -> DataFrame:
    """``(word, bits)``: pages of the assets that pass a filter tree.

    A tree has fields of ``FIELDS`` with their tests, and may have ``or`` with a list of
    trees. Ids of albums, people and tags take ``any``, ``all`` and ``none``; a tag stands
    for those below it. However many branches name ids, postings are read once, cut to
    the fields and ids that are named, and come in by one join on pages; the same holds
    for the files and texts of pictures. Nulls pass no test but those for null.
    """
    leaves = _Leaves()
    result = _node(tree, leaves)
    rows = tables.assets
    if owners is not None:
        rows = rows.where(F.col("owner_id").isin(owners))
    if not with_stacked:
        rows = rows.where("stack_id IS NULL")
    named = {COLUMNS[name] for _, (name, _) in leaves.tests("assets") if name in COLUMNS}
    if camera := [c for c in tables.exif.columns if c in named and c not in rows.columns]:
        rows = rows.join(tables.exif.select(F.col("asset_id").alias("id"), *camera), "id", "left")
    of_asset = lambda name, tests: F.col("live_photo_video_id").isNotNull() if name == "isMotion" else _compared(F.col(COLUMNS[name]), tests)
    pages = _pages(rows, "id", leaves.tests("assets"), of_asset, (F.bit_or(bit(F.col("id"))).alias("live"),))

    if tests := leaves.tests("postings"):
        hit = lambda name, ids: (F.col("field") == name) & (F.lit(True) if ids is None else F.col("value").isin(*ids))
        wanted = reduce(Column.__or__, (hit(*test) for _, test in tests))
        found = tables.postings.where(wanted).groupBy("word").agg(*(F.bit_or(F.when(hit(*test), F.col("bits"))).alias(column) for column, test in tests))
        pages = pages.join(found, "word", "left")
    if tests := leaves.tests("files"):
        files = tables.files.where("type = 'encoded_video'")
        if "is_edited" in files.columns:
            files = files.where("NOT is_edited")
        pages = pages.join(_pages(files, "asset_id", tests, lambda _, t: _compared(F.col("path"), t)), "word", "left")
    if tests := leaves.tests("ocr"):
        read = _read(tables.ocr, [needle for _, (_, needle) in tests])
        pages = pages.join(_pages(read, "asset_id", tests, lambda _, needle: F.col("needle") == needle), "word", "left")
    return pages.select("word", result.bitwiseAND(F.col("live")).alias("bits")).where("bits <> 0")


def _read(ocr: DataFrame, needles: list[str]) -> DataFrame:
    """``(asset_id, needle)``: texts that are like a needle by whole words; only those with enough of its trigrams are compared."""
    each = F.array(*(F.struct(F.lit(n).alias("needle"), F.array_join(scalar.tokens(F.lit(n)), " ").alias("words")) for n in needles))
    asked = ocr.select("asset_id", "text", F.explode(each).alias("n")).select("asset_id", "text", "n.*")
    grams = [scalar.trigrams(similarity.folded(F.col(c))) for c in ("words", "text")]
    enough = asked.where(F.size(F.array_intersect(*grams)) >= F.size(grams[0]) * OCR_LEAST - 1e-9)
    return enough.withColumn("near", similarity.similarities(F.col("words"), F.col("text"))).where(F.col("near.strict") >= OCR_LEAST).select("asset_id", "needle")


def ids(bitmaps: DataFrame) -> DataFrame:
    """The ids whose bits are set."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftright", F.col("bits"), b).bitwiseAND(1) == 1)
    return bitmaps.select(F.explode(F.transform(places, lambda b: F.col("word") * 64 + b)).alias("id"))


def count(bitmaps: DataFrame) -> DataFrame:
    """How many bits are set: ids are not made."""
    return bitmaps.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("total"))
