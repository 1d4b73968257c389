"""Shards along a Hilbert curve through several metadata dimensions, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photolake.llm.common import fresh
from photolake.session import stored, table

SHARDS = 8
#: Each dimension has 2**BITS cells.
BITS = 8
#: How the dimensions are quantised: by the share of rows before a value, by size, by place between least and most.
DIMS = {"source": "rank", "lang": "rank", "size": "log", "doc_id": "range"}
#: Rows of a bin, the least unit of running sums, as a power of two.
BIN = 10


def curve_steps(n: int) -> list[int]:
    """For each state and digit of the curve through ``n`` dimensions: rank of the digit + 2**n * next state.

    A state is an entry corner e and a direction d, as e * n + d (Hamilton's form of
    Butz's algorithm): the digit is reflected by e, rotated by d + 1, and its place in
    the Gray code is the rank; the next state is that of the sub-cube with that rank.
    """
    full = (1 << n) - 1
    rotate = lambda x, r: ((x << r % n) | (x >> (n - r % n))) & full
    trailing = lambda x: (x ^ (x + 1)).bit_length() - 1
    out = []
    for e in range(1 << n):
        for d in range(n):
            for digit in range(1 << n):
                gray, rank = rotate(digit ^ e, n - (d + 1) % n), 0
                while gray:
                    rank, gray = rank ^ gray, gray >> 1
                first = 2 * ((rank - 1) // 2) if rank else 0
                turn = trailing(rank - 1 if rank % 2 == 0 else rank) % n if rank else 0
                corner = e ^ rotate(first ^ (first >> 1), d + 1)
                out.append(rank + ((corner * n + (d + turn + 1) % n) << n))
    return out


def curve_index(cells: list[str], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of the cube of columns ``cells``, each from 0 to 2**bits - 1; ``len(cells) * bits`` is 63 at most."""
    n = len(cells)
    steps = f"array({', '.join(map(str, curve_steps(n)))})"
    digit = " + ".join(f"shiftleft(shiftright({c}, level) & 1, {j})" for j, c in enumerate(cells))
    walk = f"aggregate(sequence({bits - 1}, 0, -1), named_struct('at', 0L, 'step', 0), (a, level) -> named_struct('at', shiftleft(a.at, {n}) | (a.step & {(1 << n) - 1}), 'step', %s), a -> a.at)"
    # a step holds the rank of the digit before, so the last rank is added behind
    step = f"element_at({steps}, shiftleft(shiftright(a.step, {n}), {n}) + {digit} + 1)"
    walk = walk.replace("a -> a.at)", f"a -> shiftleft(a.at, {n}) | (a.step & {(1 << n) - 1}))") % step
    return F.expr(walk)


def running(rows: DataFrame, order: list[Column], size: str) -> DataFrame:
    """``rows`` with ``rank``, gapless from 0 in ``order``, and ``ahead``, the sum of ``size`` before each.

    Rows are sorted by ranges, ties dealt by their place in ``rows``, which should be
    stored. Sums are carried over bins of 1,024 rows within a range, and over the ranges,
    of which there is one a million rows or one a shuffle partition.
    """
    spark, names = rows.sparkSession, rows.columns
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / 1_000_000))
    keys = [*order, F.col("tie")]
    sorted_ = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    seat = F.monotonically_increasing_id()
    placed = sorted_.select(*names, seat.alias("seat"))
    placed = placed.select(*names, F.shiftright("seat", 33).alias("part"), F.col("seat").bitwiseAND((1 << 33) - 1).alias("seat"))
    placed = stored(placed.withColumn("bin", F.shiftright("seat", BIN)), "curve-order")

    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    bins = placed.groupBy("part", "bin").agg(F.sum(size).alias("size"), F.count("*").alias("n"))
    in_part = bins.select("part", "bin", ahead("size", Window.partitionBy("part").orderBy("bin")).alias("bin_ahead"))
    over = Window.orderBy("part")
    ranges = bins.groupBy("part").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).select("part", ahead("size", over).alias("part_ahead"), ahead("n", over).alias("part_rank"))
    inside = placed.withColumn("in_bin", ahead(size, Window.partitionBy("part", "bin").orderBy("seat")))
    found = inside.join(in_part, ["part", "bin"]).join(ranges, "part")
    return found.select(*names, (F.col("part_rank") + F.col("seat")).alias("rank"), (F.col("part_ahead") + F.col("bin_ahead") + F.col("in_bin")).alias("ahead"))


def with_curve(rows: DataFrame, dims: dict[str, str] = DIMS, bits: int = BITS, name: str = "curve") -> DataFrame:
    """``rows`` with their place on the curve through ``dims``, columns of ``rows``, as column ``name``.

    A ``rank`` column (any type, null last) has the cell of the share of rows before its
    value; a ``log`` column of numbers from 0 has 2**bits / 32 cells an octave; a
    ``range`` column of numbers is cut evenly from least to most, null in cell 0.
    """
    cells, top = [], (1 << bits) - 1
    ends = [c for c, kind in dims.items() if kind == "range"]
    stats = rows.agg(F.count("*").alias("n"), *(f(c).cast("double").alias(f"{k}_{i}") for i, c in enumerate(ends) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    for c, kind in dims.items():
        cells.append(cell := fresh(f"cell_{len(cells)}", rows.columns))
        if kind == "rank":
            values = running(stored(rows.groupBy(c).agg(F.count("*").alias("n_rows")), "curve-values"), [F.col(c).asc_nulls_last()], "n_rows")
            share = F.expr(f"cast(ahead * {top + 1} div {max(1, stats['n'])} as int)")
            values = values.select(F.col(c).alias(value := fresh("value", rows.columns)), share.alias(cell))
            rows = rows.join(values, rows[c].eqNullSafe(values[value]), "left").drop(value)
        elif kind == "log":
            v, fine = f"greatest(cast({c} as bigint), 1L)", max(1, (top + 1) // 32)
            rows = rows.withColumn(cell, F.expr(f"cast(least({top}, (length(bin({v})) - 1) * {fine} + shiftright({v} * {fine}, length(bin({v})) - 1) - {fine}) as int)"))
        else:
            lo, hi = (stats[f"{k}_{ends.index(c)}"] or 0.0 for k in ("lo", "hi"))
            share = (F.col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo + 1) * F.lit(top + 1.0)
            rows = rows.withColumn(cell, F.coalesce(F.least(F.lit(top), F.floor(share)), F.lit(0)).cast("int"))
    return rows.withColumn(name, curve_index(cells, bits)).drop(*cells)


def size() -> Column:
    """UTF-8 bytes of ``text`` (null: none) plus 1."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def text_crc32() -> Column:
    return F.crc32(F.coalesce("text", F.lit("")).cast("binary"))


ORDER = ("curve", "doc_id", "size", "text_crc32")


def curve_shards(docs: DataFrame, shards: int = SHARDS, dims: dict[str, str] = DIMS, bits: int = BITS) -> DataFrame:
    """``doc_id, size, text_crc32, curve, shard, slot``: documents in curve order, cut into runs of near equal bytes.

    ``dims`` are columns of ``docs``, or ``size``. A document lies in the shard that the
    middle of its bytes falls in, so a shard's size is off its share by less than the
    largest document, and ``slot`` counts a shard's documents from 0 along the curve.
    Null texts have size 1; null sources, languages and ids have cells of their own or
    the first; repeated rows are rows; an empty table gives no row. Rows that tie in all
    that is ordered are alike in every column returned. Texts are read once, whole, and
    never shuffled; other columns are left out. A hot source is no group: the size and
    the id part its rows on the curve, and sorted ranges cut through equal places.
    """
    named = [F.col(c) for c in dims if c not in ("size", "doc_id")]
    rows = stored(docs.select("doc_id", *named, size().alias("size"), text_crc32().alias("text_crc32")), "curve-rows")
    curved = stored(with_curve(rows, dims, bits).select("doc_id", "size", "text_crc32", "curve"), "curve-places")
    total = curved.agg(F.sum("size")).first()[0] or 1
    ranked = running(curved, [F.col(c) for c in ORDER], "size")
    cut = stored(ranked.withColumn("shard", F.expr(f"cast((2 * ahead + size) * {shards} div {2 * total} as int)")), "curve-shards")
    firsts = F.broadcast(cut.groupBy("shard").agg(F.min("rank").alias("first")))  # one row a shard
    return cut.join(firsts, "shard").select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def write_curve(docs: DataFrame, folder: str, file_bytes: int = 1 << 28, dims: dict[str, str] = DIMS, bits: int = BITS) -> None:
    """Writes ``docs``, all columns, as Parquet files of about ``file_bytes`` of text, each a run of the curve.

    Each file spans a narrow range of every dimension, so that the statistics in its
    footer let a reader leave it out for filters on any of them. Texts are shuffled once.
    """
    size_, curve = fresh("curve_size", docs.columns), fresh("curve", docs.columns)
    dims = {size_ if c == "size" else c: kind for c, kind in dims.items()}
    sized = docs.withColumn(size_, size())
    files = math.ceil((sized.agg(F.sum(size_)).first()[0] or 1) / file_bytes)
    # the rows' order decides between those at one place
    tie = [F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in docs.columns if c in ("doc_id", "text")]
    ranged = with_curve(sized, dims, bits, curve).repartitionByRange(files, curve, *tie)
    ranged.sortWithinPartitions(curve).select(*docs.columns).write.parquet(folder)


def file_ranges(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Least and greatest value of ``columns`` in each file of ``folder``."""
    found = spark.read.parquet(folder).groupBy(F.input_file_name().alias("file"))
    return found.agg(*(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("min", F.min), ("max", F.max))))


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; the law is ``bytes``."""
    found = curve_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _levels() -> str:
    """Steps of the curve in SQL, from bit operations: digit, rank, corner and direction of each level."""
    out, last = [], "celled"
    for level in reversed(range(BITS)):
        digit = " + ".join(f"(((c{j} >> {level}) & 1) << {j})" for j in range(len(DIMS)))
        out.append(f"""
), d{level} AS (
  SELECT *, xor({digit}, e) AS x FROM {last}
), r{level} AS (
  SELECT * EXCLUDE (x), ((x >> (d + 1)) | (x << (3 - d))) & 15 AS x FROM d{level}
), w{level} AS (
  SELECT * EXCLUDE (x), xor(xor(x, x >> 1), xor(x >> 2, x >> 3)) AS w FROM r{level}
), g{level} AS (
  SELECT *, CASE WHEN w = 0 THEN 0 ELSE xor(2 * ((w - 1) // 2), (w - 1) // 2) END AS corner,
    CASE WHEN w = 0 THEN 0 ELSE [0, 1, 0, 2, 0, 1, 0, 3, 0, 1, 0, 2, 0, 1, 0, 4][w - (w + 1) % 2 + 1] % 4 END AS turn FROM w{level}
), s{level} AS (
  SELECT doc_id, size, text_crc32, c0, c1, c2, c3, place * 16 + w AS place, xor(e, ((corner << (d + 1)) | (corner >> (3 - d))) & 15) AS e, (d + turn + 1) % 4 AS d FROM g{level}""")
        last = f"s{level}"
    return "".join(out)


SQL = rf"""
WITH RECURSIVE bits(k, i, v) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT k, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE i < 8
), bytes AS (
  SELECT list(v ORDER BY k) AS t FROM bits WHERE i = 8
), sized AS (
  SELECT doc_id, source, lang, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM documents, bytes
), sources AS (
  SELECT source, CAST((sum(n) OVER (ORDER BY source NULLS LAST) - n) * 256 // sum(n) OVER () AS BIGINT) AS cell FROM (SELECT source, count(*) AS n FROM sized GROUP BY source)
), langs AS (
  SELECT lang, CAST((sum(n) OVER (ORDER BY lang NULLS LAST) - n) * 256 // sum(n) OVER () AS BIGINT) AS cell FROM (SELECT lang, count(*) AS n FROM sized GROUP BY lang)
), ends AS (
  SELECT min(doc_id)::DOUBLE AS lo, max(doc_id)::DOUBLE AS hi FROM sized
), celled AS (
  SELECT doc_id, size, text_crc32, s.cell AS c0, l.cell AS c1, least(255, (len(bin(size)) - 1) * 8 + ((size * 8) >> (len(bin(size)) - 1)) - 8)::BIGINT AS c2,
    coalesce(least(255, floor((doc_id::DOUBLE - lo) / (hi - lo + 1) * 256)), 0)::BIGINT AS c3, 0::BIGINT AS place, 0::BIGINT AS e, 0::BIGINT AS d
  FROM sized JOIN sources s ON sized.source IS NOT DISTINCT FROM s.source JOIN langs l ON sized.lang IS NOT DISTINCT FROM l.lang, ends{_levels()}
), ranked AS (
  SELECT doc_id, size, text_crc32, row_number() OVER o - 1 AS rank, sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead, sum(size) OVER () AS total
  FROM s0 WINDOW o AS (ORDER BY place, doc_id NULLS FIRST, size, text_crc32)
), cut AS (
  SELECT *, CAST((2 * ahead + size) * 8 // (2 * total) AS INTEGER) AS shard FROM ranked
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""
