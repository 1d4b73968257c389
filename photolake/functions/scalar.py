"""Scalar functions of the catalogue as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378168.0


def truncated(ts: Column, unit: str) -> Column:
    """The UTC month or day that a timestamp falls in."""
    return F.date_trunc(unit, ts).cast("date")


def offset_hours(local: Column, taken: Column) -> Column:
    """Hours by which the local wall clock is ahead."""
    return (_seconds(local) - _seconds(taken)) / 3600.0


def _seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def aspect_ratio(width: Column, height: Column) -> Column:
    """Width over height to three places; 1 if a side is 0 or missing."""
    ok = (F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0)
    return F.when(ok, F.round(width.cast("decimal(20,6)") / height.cast("decimal(20,6)"), 3).cast("double")).otherwise(1.0)


def directory(path: Column) -> Column:
    """What stands before the last slash."""
    return F.regexp_replace(path, "/[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def stem(name: Column) -> Column:
    """Lower-case name without its last extension; a leading dot is no extension."""
    return F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]*)$", 1))


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks and the letters that they fold to, by Unicode decomposition."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccent(text: Column) -> Column:
    """Letters without their marks."""
    return F.translate(text, *_fold_table())


def earth(latitude: Column, longitude: Column) -> Column:
    """A struct x, y, z of a place on a sphere."""
    a, o = F.radians(latitude), F.radians(longitude)
    return F.struct((EARTH_RADIUS * F.cos(a) * F.cos(o)).alias("x"), (EARTH_RADIUS * F.cos(a) * F.sin(o)).alias("y"), (EARTH_RADIUS * F.sin(a)).alias("z"))


def chord(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) + F.pow(a["z"] - b["z"], 2))


def arc(chord_length: Column) -> Column:
    """Distance along the sphere of points whose straight distance is given."""
    return 2 * EARTH_RADIUS * F.asin(F.least(chord_length / (2 * EARTH_RADIUS), F.lit(1.0)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, diameter: float = 12742.0) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return diameter * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def preference(document: Column, path: str, default: int) -> Column:
    """An integer of a JSON document, or the default where it or the document is missing."""
    return F.coalesce(F.get_json_object(document, path).cast("int"), F.lit(default))


def rating(value: Column) -> Column:
    """Ratings 1 to 5; others are none."""
    return F.when(value.between(1, 5), value)


def bits_per_sample(value: Column) -> Column:
    """Totals of three channels count as one channel's."""
    return F.when(value >= 24, (value / 3).cast("int")).otherwise(value)


def duration_ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("int")


def sideways(orientation: Column) -> Column:
    """Whether an EXIF orientation swaps width and height."""
    return F.coalesce(orientation.isin(5, 6, 7, 8), F.lit(False))


def is_srgb(colorspace: Column, profile: Column, bits: Column) -> Column:
    """sRGB if a colour space or profile is named and says so; else if not over 8 bits."""
    named = F.coalesce(colorspace, profile).isNotNull()
    says = F.lower(F.coalesce(colorspace, F.lit(""))).contains("srgb") | F.lower(F.coalesce(profile, F.lit(""))).contains("srgb")
    return F.when(named, says).otherwise(F.coalesce(bits, F.lit(8)) <= 8)


def uuid7_ms(value: Column) -> Column:
    """Milliseconds since 1970 that the first 48 bits of a version 7 UUID hold."""
    return F.conv(F.substring(F.regexp_replace(value, "-", ""), 1, 12), 16, 10).cast("long")


def box_visible(x1: Column, y1: Column, x2: Column, y2: Column, crop: tuple[int, int, int, int], least: float = 0.5) -> Column:
    """Whether at least half of a box lies in a crop (left, top, right, bottom)."""
    w = F.greatest(F.least(x2, F.lit(crop[2])) - F.greatest(x1, F.lit(crop[0])), F.lit(0))
    h = F.greatest(F.least(y2, F.lit(crop[3])) - F.greatest(y1, F.lit(crop[1])), F.lit(0))
    return w * h >= least * (x2 - x1) * (y2 - y1)


def tokens(text: Column) -> Column:
    """Words, and overlapping pairs of the characters of Chinese, Japanese and Korean runs (one such alone stays)."""
    cjk = r"぀-ヿ㐀-䶿一-鿿가-힯"
    runs = F.regexp_extract_all(text, F.lit(f"[{cjk}]+|[^\\s{cjk}]+"), F.lit(0))
    pairs = F.transform(
        runs,
        lambda r: F.when(r.rlike(f"^[{cjk}]") & (F.length(r) > 1), F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array(r)),
    )
    return F.flatten(pairs)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words (two spaces in front, one behind)."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams as a share of all trigrams of both."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) > 0, shared / F.size(F.array_union(a, b))).otherwise(0.0)


def glob_to_like(glob: str) -> str:
    """A path glob as a LIKE pattern: stars become %, ? becomes _, underscores are escaped."""
    import re

    out = []
    for token in re.findall(r"\*\*?|\?|_|[^*?_]", glob):
        out.append("%" if token[0] == "*" else "_" if token == "?" else "\\_" if token == "_" else token)
    return "".join(x for x in out if x in ("%", "_", "\\_") or re.fullmatch(r"[\w\s./@-]", x))


FORMAT = {"y": "yyyy", "yy": "yy", "M": "M", "MM": "MM", "MMM": "MMM", "MMMM": "MMMM", "d": "d", "dd": "dd", "H": "H", "HH": "HH", "m": "m", "mm": "mm", "s": "s", "ss": "ss", "SSS": "SSS"}


def storage_path(template: str, taken: Column, **values: Column) -> Column:
    """A destination path: ``{{y}}``-like date tokens and named values filled in."""
    import re

    parts = []
    for literal, token in re.findall(r"([^{]+)|\{\{(\w+)\}\}", template):
        if literal:
            parts.append(F.lit(literal))
        elif token in values:
            parts.append(F.coalesce(values[token].cast("string"), F.lit("")))
        elif token == "W":
            parts.append(F.weekofyear(taken).cast("string"))
        elif token == "WW":
            parts.append(F.lpad(F.weekofyear(taken).cast("string"), 2, "0"))
        else:
            parts.append(F.date_format(taken, FORMAT[token]))
    return F.concat(*parts)


#: The tags that may hold when a photo was taken, in order.
DATE_TAGS = (
    "SubSecDateTimeOriginal",
    "SubSecCreateDate",
    "DateTimeOriginal",
    "CreationDate",
    "CreateDate",
    "MediaCreateDate",
    "DateTimeCreated",
    "GPSDateTime",
    "DateTimeUTC",
    "SonyDateTime2",
    "SourceImageCreateTime",
)
_TAKEN = r"^(\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2})(?:\.\d+)?(Z|[+-]\d{2}:\d{2})?$"


def tag_time(raw: Column) -> Column:
    """The wall-clock time of a date tag, null if it is none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(raw, _TAKEN, 1), F.lit("")), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def first_date(tags: dict[str, Column]) -> Column:
    """``(tag, raw, at)`` of the first tag of ``DATE_TAGS`` that is a date; null if none is."""
    found = [F.when(tag_time(tags[t]).isNotNull(), F.struct(F.lit(t).alias("tag"), tags[t].alias("raw"), tag_time(tags[t]).alias("at"))) for t in DATE_TAGS if t in tags]
    return F.coalesce(*found)


def taken_dates(raw: Column, zone: Column, created: Column, modified: Column, birth: Column) -> Column:
    """``(zone, original, local)``: when a photo was taken, in UTC and on the clock of its zone.

    A date without an offset is read as UTC. The zone (a name or an offset) is the given
    one, else ``UTC+0`` for a date that ends in Z or +00:00, else none, which is UTC.
    Without a date both times are the earliest of the file's times; a null birth time
    does not count.
    """
    offset = F.regexp_extract(raw, _TAKEN, 2)
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    minutes = F.when(F.length(offset) == 6, sign * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int"))).otherwise(0)
    own = F.coalesce(zone, F.when(raw.rlike(r"(Z|\+00:00)$"), F.lit("UTC+0")))
    utc = F.timestamp_add("MINUTE", -minutes, tag_time(raw))
    # read and shown in the session's zone, so only the difference counts
    here = F.from_utc_timestamp(F.to_utc_timestamp(utc.cast("timestamp"), F.lit("UTC")), F.coalesce(own, F.lit("UTC"))).cast("timestamp_ntz")
    earliest = F.least(created, modified, birth)
    return F.struct(own.alias("zone"), F.coalesce(utc, earliest).alias("original"), F.coalesce(here, earliest).alias("local"))


def ocr_rows(box: Column, box_score: Column, text: Column, text_score: Column) -> Column:
    """``array<(x1, y1, .., x4, y4, box_score, text_score, text)>`` of flat OCR results: eight coordinates for each text."""
    names = [f"{a}{k}" for k in (1, 2, 3, 4) for a in "xy"]

    def row(t: Column, i: Column) -> Column:
        return F.struct(*(F.get(box, i * 8 + k).alias(n) for k, n in enumerate(names)), F.get(box_score, i).alias("box_score"), F.get(text_score, i).alias("text_score"), t.alias("text"))

    return F.transform(text, row)


def checksum_hex(given: Column) -> Column:
    """A SHA-1 in lower-case hexadecimal, given so or (28 characters) in base64."""
    return F.lower(F.hex(F.when(F.length(given) == 28, F.unbase64(given)).otherwise(F.unhex(given))))


def tag_list(tags: Column, subjects: Column, keywords: Column) -> Column:
    """A file's tags: its list, else its hierarchical subjects with slashes and bars swapped, else its keywords."""
    return F.coalesce(tags, F.transform(subjects, lambda s: F.translate(s, "/|", "|/")), keywords)


def dimensions(size: Column, width: Column, height: Column) -> Column:
    """``(width, height)``: of ``size`` (``640x480``) where it is given, else the two columns."""
    part = F.split(size, "x")
    return F.struct(F.coalesce(F.get(part, F.lit(0)).cast("int"), width).alias("width"), F.coalesce(F.get(part, F.lit(1)).cast("int"), height).alias("height"))


def auto_stack_id(burst: Column, uuid: Column, camera: Column, media: Column) -> Column:
    """The id that groups shots of one burst: the first of four tags that a file has."""
    return F.coalesce(burst, uuid, camera, media)


def uuid7_from_ms(ms: Column) -> Column:
    """The smallest version 7 UUID of a millisecond."""
    head = F.lpad(F.lower(F.hex(ms)), 12, "0")
    return F.concat(F.substring(head, 1, 8), F.lit("-"), F.substring(head, 9, 4), F.lit("-7000-8000-000000000000"))
