"""Filter trees over bitmaps: every field against a row-by-row evaluation, nested branches, ids any, all and none."""

import random

import pytest

from photolake.operators import bitmaps

ASSET = "id long, owner_id long, library_id long, type string, visibility string, is_favorite boolean, is_offline boolean, live_photo_video_id long, stack_id long, file_created_at string, created_at string, updated_at string, deleted_at string, checksum string, original_file_name string, original_path string"
EXIF = "asset_id long, city string, state string, country string, make string, model string, lens_model string, description string, rating int, file_size long"
TAGS = [(1, "a"), (2, "a/b"), (3, "a/b/c"), (4, "d")]
BELOW = {1: {1, 2, 3}, 2: {2, 3}, 3: {3}, 4: {4}}


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    pick = lambda *values: rng.choice(values)
    assets, exif, albums, faces, tagged, files, ocr = [], [], [], [], [], [], []
    for n in range(400):
        i = n * 3 + 61
        day = lambda: f"20{rng.randrange(10, 20)}-01-01"
        assets.append((i, n % 3, pick(None, 1, 2), pick("IMAGE", "VIDEO"), pick("timeline", "archive"), pick(True, False), pick(True, False), pick(None, 5), pick(None, None, 9), day(), day(), day(), pick(None, day()), pick(None, "c1", "c2"), pick("IMG_1.JPG", "Ärger.png"), pick("/x/a.jpg", "/y/b.jpg")))
        if n % 10:
            exif.append((i, pick(None, "Bonn", "Ulm"), pick(None, "S"), pick(None, "DE"), pick(None, "Canon"), pick(None, "M1"), pick(None, "L"), pick(None, "Größe", "trip"), pick(None, 1, 3, 5), rng.randrange(100)))
        albums += [(rng.randrange(6), i) for _ in range(rng.randrange(3))]
        faces += [(pick(None, 1, 2, 3), i, rng.random() < 0.8, pick(None, None, "d")) for _ in range(rng.randrange(3))]
        tagged += [(rng.randrange(1, 5), i) for _ in range(rng.randrange(2))]
        files += [(i, t, pick("/e/1.mp4", "/e/2.mp4")) for t in ("preview", "encoded_video") if rng.random() < 0.4]
        if rng.random() < 0.5:
            ocr.append((i, pick("Grand Hotel Münster", "exit only", "hotels", None)))
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((assets, ASSET), (exif, EXIF), (albums, "album_id long, asset_id long"), (faces, "person_id long, asset_id long, is_visible boolean, deleted_at string"), (TAGS, "id long, value string"), (tagged, "tag_id long, asset_id long"), (files, "asset_id long, type string, path string"), (ocr, "asset_id long, text string"))]
    tables = bitmaps.Tables(frames[0], frames[1], frames[6], frames[7], bitmaps.postings(frames[2], frames[3], frames[4], frames[5], frames[6]))
    names = [f.split()[0] for f in ASSET.split(", ")]
    rows = {r[0]: dict(zip(names, r)) for r in assets}
    for r in rows.values():
        r |= dict.fromkeys(f.split()[0] for f in EXIF.split(", "))
        r |= {"albumIds": set(), "personIds": set(), "tagIds": set(), "shown": False, "paths": set(), "texts": set()}
    for e in exif:
        rows[e[0]] |= dict(zip((f.split()[0] for f in EXIF.split(", ")), e))
    for album, i in albums:
        rows[i]["albumIds"].add(album)
    for person, i, visible, deleted in faces:
        if visible and not deleted:
            rows[i]["shown"] = True
            rows[i]["personIds"] |= {person} - {None}
    for tag, i in tagged:
        rows[i]["tagIds"] |= {a for a, below in BELOW.items() if tag in below}
    for i, kind, path in files:
        if kind == "encoded_video":
            rows[i]["paths"].add(path)
    for i, text in ocr:
        rows[i]["texts"].add(text)
    return tables, rows


def fold(s):
    return s.replace("Ä", "A").replace("ö", "o").replace("ü", "u").lower()


def compares(v, tests):
    for op, x in tests.items():
        if op in ("eq", "ne") and x is None:
            ok = (v is None) == (op == "eq")
        elif v is None:
            ok = False
        else:
            ok = {
                "eq": lambda: v == x, "ne": lambda: v != x, "lt": lambda: v < x, "lte": lambda: v <= x, "gt": lambda: v > x, "gte": lambda: v >= x, "in": lambda: v in x, "notIn": lambda: v not in x,
                "like": lambda: fold(x) in fold(v), "notLike": lambda: fold(x) not in fold(v), "startsWith": lambda: fold(v).startswith(fold(x)), "endsWith": lambda: fold(v).endswith(fold(x)),
            }[op]()
        if not ok:
            return False
    return True


def passes(r, tree):
    for name, tests in tree.items():
        if name == "or":
            ok = not tests or any(passes(r, b) for b in tests)
        elif name in bitmaps.IDS:
            own = r[name]
            ok = ("any" not in tests or bool(own & set(tests["any"]))) and set(tests.get("all", ())) <= own and not own & set(tests.get("none", ()))
        elif name in bitmaps.FLAGS:
            ok = tests["eq"] == {"isMotion": r["live_photo_video_id"] is not None, "isEncoded": bool(r["paths"]), "hasAlbums": bool(r["albumIds"]), "hasPeople": r["shown"], "hasTags": bool(r["tagIds"])}[name]
        elif name == "encodedVideoPath":
            ok = any(compares(p, tests) for p in r["paths"])
        elif name == "ocr":
            ok = any(t in {"hotel": ("Grand Hotel Münster", "hotels"), "munster": ("Grand Hotel Münster",), "zzz": ()}[tests["matches"]] for t in r["texts"])
        else:
            ok = compares(r[bitmaps.COLUMNS[name]], tests)
        if not ok:
            return False
    return True


SINGLE = [
    {"id": {"lt": 500}}, {"libraryId": {"eq": None}}, {"type": {"in": ["IMAGE"]}}, {"visibility": {"ne": "archive"}}, {"isFavorite": {"eq": True}}, {"isMotion": {"eq": False}}, {"isOffline": {"eq": False}},
    {"isEncoded": {"eq": True}}, {"hasAlbums": {"eq": False}}, {"hasPeople": {"eq": True}}, {"hasTags": {"eq": False}}, {"city": {"notIn": ["Ulm"]}}, {"state": {"ne": None}}, {"country": {"eq": "DE"}}, {"make": {"eq": None}}, {"model": {"in": ["M1"]}},
    {"lensModel": {"ne": "L"}}, {"description": {"like": "GROß"}}, {"description": {"notLike": "tri"}}, {"originalFileName": {"startsWith": "arg", "endsWith": ".PNG"}}, {"originalPath": {"eq": "/x/a.jpg"}}, {"ocr": {"matches": "hotel"}}, {"ocr": {"matches": "zzz"}},
    {"rating": {"gte": 3, "lt": 5}}, {"fileSizeInBytes": {"gt": 50}}, {"takenAt": {"lte": "2014-01-01"}}, {"createdAt": {"gte": "2014-01-01"}}, {"updatedAt": {"lt": "2013-01-01"}}, {"trashedAt": {"eq": None}}, {"checksum": {"eq": "c1"}}, {"encodedVideoPath": {"ne": "/e/1.mp4"}},
    {"albumIds": {"any": [1, 2, 2]}}, {"albumIds": {"all": [1, 1]}}, {"albumIds": {"all": [1, 2]}}, {"albumIds": {"none": [0, 3]}}, {"albumIds": {"any": [77]}}, {"personIds": {"any": [1], "none": [2]}}, {"tagIds": {"all": [1, 3]}}, {"tagIds": {"none": [2]}}, {},
]


def test_every_field(data):
    tables, rows = data
    assert len(bitmaps.FIELDS) == 32 and {name for tree in SINGLE for name in tree} == set(bitmaps.FIELDS)
    # all trees in one, told apart by their own runs only where the whole differs
    for tree in SINGLE:
        want = sorted(i for i, r in rows.items() if passes(r, tree))
        assert sorted(r.id for r in bitmaps.ids(bitmaps.search(tables, tree)).collect()) == want, tree


def test_nested_branches(data):
    tables, rows = data
    rng = random.Random(2)
    for _ in range(6):
        branch = lambda depth: dict(item for _ in range(rng.randrange(1, 3)) for item in rng.choice(SINGLE).items()) | ({"or": [branch(depth - 1) for _ in range(2)]} if depth and rng.random() < 0.8 else {})
        tree = branch(0) | {"or": [branch(2), branch(1), branch(0)]}
        found = bitmaps.search(tables, tree)
        want = sorted(i for i, r in rows.items() if passes(r, tree))
        assert sorted(r.id for r in bitmaps.ids(found).collect()) == want, tree
        assert bitmaps.count(found).first().total == len(want)


def test_owners_and_stacks(data):
    tables, rows = data
    tree = {"albumIds": {"any": [1, 2, 3]}}
    found = bitmaps.ids(bitmaps.search(tables, tree, owners=[1, 2], with_stacked=False))
    assert sorted(r.id for r in found.collect()) == sorted(i for i, r in rows.items() if passes(r, tree) and r["owner_id"] in (1, 2) and r["stack_id"] is None)


def test_one_join_for_all_ids(data, capsys):
    tables, _ = data
    tree = {"or": [{"albumIds": {"any": [k], "none": [k + 1]}, "personIds": {"all": [1, 2]}, "tagIds": {"any": [k]}} for k in range(1, 5)]}
    bitmaps.search(tables, tree).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") == 1 and plan.count("Join ") == 1 and "PushedFilters" in plan


def test_unknown_fields_and_tests_are_refused(data):
    for tree in ({"nothing": {"eq": 1}}, {"or": [{"city": {"like": "x"}}]}):
        with pytest.raises(ValueError):
            bitmaps.search(data[0], tree)
