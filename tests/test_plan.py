"""Plans of stacks: groups seen in part are left out whole, order, and a digest that tells plans apart."""

from photolake.operators import groups

SCHEMA = "owner_id long, id long, name string, status string, reason string, second long, scope string, stack_id long, is_trashed boolean, is_offline boolean"


def details(spark, *rows):
    base = dict(owner_id=1, status="SUCCESS", reason=None, second=5, scope="a", stack_id=None, is_trashed=False, is_offline=False)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], SCHEMA)


def pair(i, name, **more):
    return [dict(id=i, name=f"{name}.JPG", **more), dict(id=i + 1, name=f"{name}.arw", **more)]


def test_plan_and_exclusions(spark):
    given = [*pair(10, "b"), *pair(20, "a"), *pair(30, "stacked", stack_id=3), *pair(40, "gone", is_trashed=True), dict(id=50, name="single.jpg")]
    given += [*pair(60, "failed"), dict(id=62, name="failed.mp4", status="FAILURE", reason="TIMEOUT", second=None), *pair(70, "unseen"), dict(id=72, name="unseen.dng", status=None)]
    given += [dict(id=80, name="untimed.jpg", second=None), dict(id=81, name="untimed.arw"), dict(id=90, name="c.jpg", scope="a"), dict(id=91, name="c.arw", scope="b"), dict(id=95, name="lost.jpg", status="FAILURE")]
    found = groups.write_plan(details(spark, *given, *pair(100, "b", owner_id=2)))
    plan = sorted((r.owner_id, r.position, r.stem, r.jpg, r.raw) for r in found["plan"].collect())
    assert plan == [(1, 1, "a", 20, 21), (1, 2, "b", 10, 11), (2, 1, "b", 100, 101)]
    excluded = sorted((r.position, r.stem, r.status, r.reasons, r.assets) for r in found["excluded"].collect())
    assert [e[1:] for e in excluded] == [
        ("c", "REJECTED", "SCOPE_MISMATCH", 2),
        ("failed", "UNVERIFIED", "DETAIL_GROUP_INCOMPLETE,TIMEOUT", 3),
        ("gone", "REJECTED", "ASSET_NOT_HEALTHY", 2),
        ("lost", "UNVERIFIED", "DETAIL_FAILURE,DETAIL_GROUP_INCOMPLETE", 1),
        ("single", "REJECTED", "MISSING_RAW", 1),
        ("stacked", "REJECTED", "CURRENT_STACK_BLOCKER", 2),
        ("unseen", "UNVERIFIED", "DETAIL_GROUP_INCOMPLETE,DETAIL_UNSCHEDULED", 3),
        ("untimed", "UNVERIFIED", "DETAIL_GROUP_INCOMPLETE,DETAIL_GROUP_TIME_UNPROVEN", 2),
    ]


def test_digest(spark):
    rows = [(i % 7, f"s{i}", None if i % 5 else i) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b string, c long")
    digest = lambda d: tuple(groups.plan_digest(d, ["a", "b", "c"]).first())
    one = digest(df)
    assert one[0] == 500 and digest(df.repartition(9, "b")) == one and digest(df.coalesce(1)) == one
    assert digest(df.where("b <> 's3'")) != one and digest(df.unionByName(df.where("b = 's3'"))) != one
    # a null is no text, and columns do not run into each other
    assert digest(spark.createDataFrame([(1, "2", None)], df.schema)) != digest(spark.createDataFrame([(1, "", 2)], df.schema))
    assert digest(df.limit(0)) == (0, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
