"""Tags, stacks, duplicate groups, JPG/RAW pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.functions import scalar
from photolake.operators.graph import connected_components


def tag_paths(paths: DataFrame, column: str = "value") -> DataFrame:
    """``(value, name, parent)`` of every prefix of the paths; empty parts are dropped."""
    parts = F.filter(F.split(column, "/"), lambda x: x != "")
    prefix = F.explode(F.sequence(F.lit(1), F.size("parts")))
    rows = paths.select(parts.alias("parts")).where(F.size("parts") > 0).select("parts", prefix.alias("n"))

    def joined(n: Column) -> Column:
        return F.array_join(F.slice("parts", 1, n), "/")

    return rows.select(joined(F.col("n")).alias("value"), F.element_at("parts", F.col("n")).alias("name"), F.when(F.col("n") > 1, joined(F.col("n") - 1)).alias("parent")).distinct()


def tag_closure(tags: DataFrame) -> DataFrame:
    """``(ancestor, descendant)``: each tag with itself and all tags above it, from its path."""
    parts = F.split("value", "/")
    rows = tags.select(F.col("id").alias("descendant"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("value"))
    return rows.join(tags.select("value", F.col("id").alias("ancestor")), "value").select("ancestor", "descendant")


def exif_count(exif: DataFrame, left_out: tuple[str, ...] = ("asset_id",)) -> Column:
    """How many camera fields are neither missing, empty, zero nor false."""
    tests = []
    for name, kind in exif.dtypes:
        if name not in left_out:
            c = F.col(name)
            full = c.isNotNull() & ((c != "") if kind == "string" else (c != 0) if kind in ("int", "bigint", "double", "float") else F.lit(True))
            tests.append(F.coalesce(full, F.lit(False)).cast("int"))
    return sum(tests[1:], tests[0])


def suggest_keep(members: DataFrame, key: str = "duplicate_id") -> DataFrame:
    """The member of each group to keep: the largest file, then most camera fields, then the last by ``position``.

    ``members`` has the key, id, file_size, fields and position.
    """
    best = F.max_by("id", F.struct(F.coalesce("file_size", F.lit(0)), "fields", "position"))
    return members.groupBy(key).agg(best.alias("keep"))


def resolve(members: DataFrame, key: str = "duplicate_id") -> DataFrame:
    """What the one kept asset of a group takes over from all.

    ``members`` has the key, id, action (keep or trash), is_favorite, visibility, rating,
    description, latitude, longitude, albums and tags (arrays). ``status`` is ``ok`` only
    for groups with exactly one asset to keep and at least one to trash. Coordinates are
    taken if all that are known agree. Lines of descriptions are kept once each, by id.
    """
    level = F.array_position(F.array(*map(F.lit, ("locked", "archive", "timeline", "hidden"))), F.col("visibility"))
    groups = members.groupBy(key).agg(
        F.count_if(F.col("action") == "keep").alias("kept"),
        F.count_if(F.col("action") == "trash").alias("trashed"),
        F.max(F.when(F.col("action") == "keep", F.col("id"))).alias("keeper"),
        F.bool_or("is_favorite").alias("is_favorite"),
        F.min(level).cast("int").alias("level"),
        F.max(F.coalesce("rating", F.lit(0))).alias("rating"),
        F.array_sort(F.collect_list(F.struct("id", "description"))).alias("texts"),
        F.collect_set("latitude").alias("latitudes"),
        F.collect_set("longitude").alias("longitudes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("albums", F.array().cast("array<bigint>")))))).alias("albums"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<bigint>")))))).alias("tags"),
    )
    lines = F.array_distinct(F.filter(F.transform(F.flatten(F.transform("texts", lambda t: F.split(F.coalesce(t["description"], F.lit("")), "\n"))), lambda x: F.trim(x)), lambda x: x != ""))
    one = (F.size("latitudes") == 1) & (F.size("longitudes") == 1)
    status = F.when(F.col("kept") != 1, "one asset must be kept").when(F.col("trashed") < 1, "nothing to trash").otherwise("ok")
    return groups.select(
        key, status.alias("status"), "keeper", "is_favorite", F.element_at(F.array(*map(F.lit, ("locked", "archive", "timeline", "hidden"))), F.col("level")).alias("visibility"),
        F.when(F.col("rating") > 0, F.col("rating")).alias("rating"), F.array_join(lines, "\n").alias("description"),
        F.when(one, F.element_at("latitudes", 1)).alias("latitude"), F.when(one, F.element_at("longitudes", 1)).alias("longitude"), "albums", "tags",
    )


def assign_duplicates(pairs: DataFrame, assets: DataFrame) -> DataFrame:
    """``(id, duplicate_id)`` after linked pairs and groups that exist already merge.

    A group's id is the smallest existing one of its members, else its smallest member.
    Existing groups move as a whole: their members link through the group. The reference's
    result hangs on the order of its jobs; this one does not.
    """
    named = assets.where("duplicate_id IS NOT NULL").select("id", "duplicate_id")
    group = named.groupBy("duplicate_id").agg(F.min("id").alias("hub"))
    through = named.join(group, "duplicate_id").select(F.col("id").alias("src"), F.col("hub").alias("dst"))
    edges = pairs.select("src", "dst").unionByName(through)
    parts = connected_components(edges).withColumnRenamed("node", "id")
    least = parts.join(named, "id", "left").groupBy("component").agg(F.coalesce(F.min("duplicate_id"), F.min("id")).alias("duplicate_id"))
    return parts.join(least, "component").select("id", "duplicate_id")


def merge_stacks(assets: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request, id, primary_id)``: members of the stacks that requests make.

    ``requests`` has request, position and id. The first id leads; the members of stacks
    that a requested asset leads are absorbed. ``assets`` has id, stack_id and lead (the
    primary of its stack, if any).
    """
    first = requests.groupBy("request").agg(F.min_by("id", "position").alias("primary_id"))
    led = assets.where("lead IS NOT NULL AND deleted_at IS NULL").select(F.col("lead").alias("led_by"), F.col("id").alias("member"))
    absorbed = requests.join(led, requests["id"] == led["led_by"]).select("request", F.col("member").alias("id"))
    return requests.select("request", "id").unionByName(absorbed).distinct().join(first, "request")


def pair_jpg_raw(assets: DataFrame) -> DataFrame:
    """One decision for each owner, stem and local second (or stem alone where the time is not verified).

    ``assets`` has id, owner_id, name, second (null: not verified). Exactly one JPG and
    one RAW are a CANDIDATE; several of one are AMBIGUOUS; a missing one is REJECTED.
    """
    ext = scalar.extension(F.col("name"))
    role = F.when(ext.isin("jpg", "jpeg"), "JPG").when(ext.isin("raw", "arw", "dng", "cr2", "nef"), "RAW")
    rows = assets.select("id", "owner_id", scalar.stem(F.col("name")).alias("stem"), "second", role.alias("role")).where("role IS NOT NULL")
    jpg, raw = F.col("role") == "JPG", F.col("role") == "RAW"
    groups = rows.groupBy("owner_id", "stem", "second").agg(F.count_if(jpg).alias("jpgs"), F.count_if(raw).alias("raws"), F.min(F.when(jpg, F.col("id"))).alias("jpg"), F.min(F.when(raw, F.col("id"))).alias("raw"))
    status = F.when(F.col("second").isNull(), "UNVERIFIED").when((F.col("jpgs") == 1) & (F.col("raws") == 1), "CANDIDATE").when((F.col("jpgs") > 1) | (F.col("raws") > 1), "AMBIGUOUS").otherwise("REJECTED")
    reasons = F.array_compact(F.array(
        F.when(F.col("status") == "CANDIDATE", "RULES_MATCH"), F.when(F.col("status") == "UNVERIFIED", "TIME_UNVERIFIED"),
        *(F.when(F.col("status").isin("AMBIGUOUS", "REJECTED") & test, name) for name, test in (("DUPLICATE_JPG", F.col("jpgs") > 1), ("DUPLICATE_RAW", F.col("raws") > 1), ("MISSING_JPG", F.col("jpgs") == 0), ("MISSING_RAW", F.col("raws") == 0))),
    ))
    single = [F.when(F.col(n) == 1, F.col(c)).alias(c) for n, c in (("jpgs", "jpg"), ("raws", "raw"))]
    out = groups.withColumn("status", status).select("owner_id", "stem", "second", "status", *single, F.array_join(reasons, ",").alias("reasons"))
    return out.withColumn("pair_id", F.sha2(F.concat_ws("|", F.col("owner_id").cast("string"), "stem", F.coalesce(F.col("jpg").cast("string"), F.lit("")), F.coalesce(F.col("raw").cast("string"), F.lit(""))), 256))


def classify_stacks(pairs: DataFrame, assets: DataFrame) -> DataFrame:
    """What stacks already say of each candidate pair; ``assets`` has id, stack_id, lead and members (of its stack)."""
    side = assets.select("id", "stack_id", "lead", "members")
    rows = pairs.join(side.select(*(F.col(c).alias(f"j_{c}") for c in side.columns)), F.col("jpg") == F.col("j_id"), "left")
    rows = rows.join(side.select(*(F.col(c).alias(f"r_{c}") for c in side.columns)), F.col("raw") == F.col("r_id"), "left")
    j, r = F.col("j_stack_id"), F.col("r_stack_id")
    state = (
        F.when(F.col("j_id").isNull() | F.col("r_id").isNull(), "UNKNOWN")
        .when(j.isNull() & r.isNull(), "NO_STACK")
        .when(j.isNull() | r.isNull(), "STACK_PARTIAL_CONFLICT")
        .when(j != r, "STACK_SPLIT_CONFLICT")
        .when(F.col("j_members") > 2, "STACK_HAS_OTHER_ASSETS")
        .when(F.col("j_lead") == F.col("jpg"), "EXTERNAL_EQUIVALENT")
        .otherwise("EXTERNAL_PRIMARY_CONFLICT")
    )
    return rows.select(*pairs.columns, state.alias("state"))


def with_stack_size(assets: DataFrame, stacks: DataFrame) -> DataFrame:
    """Assets with their stack's leading asset and number of members."""
    lead = stacks.select(F.col("id").alias("stack_id"), F.col("primary_asset_id").alias("lead"))
    n = assets.where("stack_id IS NOT NULL").groupBy("stack_id").agg(F.count("*").alias("members"))
    return assets.join(lead, "stack_id", "left").join(n, "stack_id", "left")


def inventory_stable(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: rows and repeated ids of both listings, ids in one only, and whether nothing changed."""
    a = first.agg(F.count("*").alias("first"), (F.count("*") - F.count_distinct("id")).alias("first_repeats"))
    b = second.agg(F.count("*").alias("second"), (F.count("*") - F.count_distinct("id")).alias("second_repeats"))
    both = first.select("id").distinct().withColumn("a", F.lit(1)).join(second.select("id").distinct().withColumn("b", F.lit(1)), "id", "full")
    diff = both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("different"))
    one = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").join(diff.withColumn("k", F.lit(1)), "k").drop("k")
    return one.withColumn("stable", F.expr("first_repeats = 0 AND second_repeats = 0 AND different = 0"))


def stack_plan(pairs: DataFrame, assets: DataFrame) -> DataFrame:
    """The outcome of each candidate pair: PLANNED, or the first reason against a stack.

    ``assets`` has id, scope, stack_id, is_trashed, is_offline and second.
    """
    side = {n: assets.select(*(F.col(c).alias(f"{n}_{c}") for c in assets.columns)) for n in ("jpg", "raw")}
    rows = pairs.join(side["jpg"], F.col("jpg") == F.col("jpg_id")).join(side["raw"], F.col("raw") == F.col("raw_id"))
    outcome = (
        F.when(~F.col("jpg_scope").eqNullSafe(F.col("raw_scope")), "SCOPE_MISMATCH")
        .when(F.col("jpg_stack_id").isNotNull() | F.col("raw_stack_id").isNotNull(), "CURRENT_STACK_BLOCKER")
        .when(F.col("jpg_is_trashed") | F.col("raw_is_trashed") | F.col("jpg_is_offline") | F.col("raw_is_offline"), "ASSET_NOT_HEALTHY")
        .when(~F.col("jpg_second").eqNullSafe(F.col("raw_second")), "TIME_EVIDENCE_MISMATCH")
        .otherwise("PLANNED")
    )
    return rows.select(*pairs.columns, outcome.alias("outcome"))


def write_plan(details: DataFrame) -> dict[str, DataFrame]:
    """The plan of stacks to write, and the groups that have none.

    ``details`` has a row for each asset that was to be looked at: owner_id, id, name,
    status (SUCCESS, FAILURE, or null if it was never scheduled), reason (of a failure),
    second (null: not verified), scope, stack_id, is_trashed, is_offline. A group is an
    owner's assets of one stem. It is incomplete if one of them was not seen or has no
    verified time, and then none of them is paired, so nothing is planned by half of a
    group.

    ``plan`` has owner_id, stem, jpg, raw, second, pair_id; ``excluded`` owner_id, stem,
    status, reasons (sorted, joined by commas) and assets. In both ``position`` orders the
    rows of an owner from 1: pairs by stem, then pair id; excluded ones by stem, status
    and reasons.
    """
    rows = details.withColumn("stem", scalar.stem(F.col("name")))
    seen = F.coalesce(F.col("status") == "SUCCESS", F.lit(False))
    why = F.when(F.col("status").isNull(), "DETAIL_UNSCHEDULED").when(~seen, F.coalesce("reason", F.lit("DETAIL_FAILURE"))).when(F.col("second").isNull(), "DETAIL_GROUP_TIME_UNPROVEN")
    sizes = rows.groupBy("owner_id", "stem").agg(F.count("*").alias("assets"), F.collect_set(why).alias("why"))
    complete = rows.join(sizes.where(F.size("why") == 0).select("owner_id", "stem"), ["owner_id", "stem"], "left_semi")
    unseen = sizes.where(F.size("why") > 0).select("owner_id", "stem", F.lit("UNVERIFIED").alias("status"), F.array_join(F.array_sort(F.array_union("why", F.array(F.lit("DETAIL_GROUP_INCOMPLETE")))), ",").alias("reasons"))

    decided = pair_jpg_raw(complete.select("id", "owner_id", "name", "second"))
    outcomes = stack_plan(decided.where("status = 'CANDIDATE'"), complete.select("id", "scope", "stack_id", "is_trashed", "is_offline", "second"))
    sorted_reasons = F.array_join(F.array_sort(F.split("reasons", ",")), ",").alias("reasons")
    others = decided.where("status <> 'CANDIDATE'").select("owner_id", "stem", "status", sorted_reasons)
    blocked = outcomes.where("outcome <> 'PLANNED'").select("owner_id", "stem", F.lit("REJECTED").alias("status"), F.col("outcome").alias("reasons"))
    excluded = others.unionByName(unseen).unionByName(blocked).join(sizes.select("owner_id", "stem", "assets"), ["owner_id", "stem"])

    def placed(df: DataFrame, *order: str) -> DataFrame:
        return df.withColumn("position", F.row_number().over(Window.partitionBy("owner_id").orderBy(*order)))

    plan = outcomes.where("outcome = 'PLANNED'").select("owner_id", "stem", "jpg", "raw", "second", "pair_id")
    return {"plan": placed(plan, "stem", "pair_id"), "excluded": placed(excluded, "stem", "status", "reasons")}


def plan_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(rows, digest)``: one SHA-256 of all rows in order of ``columns``, the same however they are partitioned.

    Each row's digest goes into one of 65,536 lists by its first bytes, the lists' digests
    into 256, and those into one; each list is sorted. As the order of a plan follows from
    its rows, two plans have equal digests if and only if they have equal rows in equal
    order, repeats included, and no rows are moved to compare them. An empty plan has the
    digest of the empty text.
    """
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u2400")) for c in columns))
    digests = rows.select(F.sha2(text.cast("binary"), 256).alias("h"))

    def of(items: Column) -> Column:
        return F.sha2(F.array_join(F.array_sort(items), "").cast("binary"), 256).alias("h")

    lists = digests.groupBy(F.substring("h", 1, 4).alias("k")).agg(F.count("*").alias("n"), of(F.collect_list("h")))
    lists = lists.groupBy(F.substring("k", 1, 2).alias("j")).agg(F.sum("n").alias("n"), of(F.collect_list(F.concat("k", "h"))))
    return lists.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), of(F.collect_list(F.concat("j", "h"))).alias("digest"))
