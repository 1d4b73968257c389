"""The curve itself, shards against SQL on odd tables, and files that prune on every dimension."""

import duckdb
import pytest
from pyspark.sql import functions as F

from photolake.llm import hilbert


@pytest.mark.parametrize("n,bits", [(1, 5), (2, 5), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    cells = [F.expr(f"cast(shiftright(id, {j * bits}) & {(1 << bits) - 1} as int) AS c{j}") for j in range(n)]
    rows = sorted(spark.range(1 << n * bits).select(*cells).select(hilbert.curve_index([f"c{j}" for j in range(n)], bits).alias("h"), "*").collect())
    assert [r[0] for r in rows] == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:])) == 1 for x, y in zip(rows, rows[1:]))


def compare(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({hilbert.SQL})").fetchall()
    got = [tuple(r) for r in hilbert.op11_hilbert_shards(spark, str(folder)).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_odd_rows_equal_sql(spark, tmp_path):
    rows = [(i, ["plain text", None, "", "żółw 😀 日本", "x" * 50_000][i % 5], [None, "en", "de"][i % 3], [None, "hot", "hot", "hot", f"s{i}"][i % 5], "clash", -i) for i in range(300)]
    rows += rows[:20] + rows[:1] * 40 + [(None, None, None, None, None, None), (None, "text", "en", "hot", None, None), (-(2**62), "low", "en", "hot", None, 1), (2**62, "high", "en", "hot", None, 1)]
    got = compare(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, curve string, shard int"), tmp_path)
    assert len(got) == len(rows)
    sizes = [sum(r[1] for r in got if r[4] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * 50_001
    for s in range(8):
        assert sorted(r[5] for r in got if r[4] == s) == list(range(sum(r[4] == s for r in got)))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(i, "a" * (1 if i else 100_000), "en", "s") for i in range(9)]], ids=["empty", "one", "one large"])
def test_few_rows(spark, tmp_path, rows):
    assert len(compare(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), tmp_path)) == len(rows)


def test_many_bins_and_ranges(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 5_000).alias("k"), (F.col("id") % 13).alias("size"))
    found = hilbert.running(rows, [F.col("k")], "size").orderBy("rank").collect()
    ahead = 0
    for i, r in enumerate(found):
        assert (r["rank"], r["ahead"]) == (i, ahead)
        ahead += r["size"]
    assert [r["k"] for r in found] == sorted(r["k"] for r in found)


def test_files_prune_on_every_dimension(spark, tmp_path):
    docs = spark.range(8_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("s"), (F.xxhash64("id") % 16).cast("string")).alias("source"),
        F.element_at(F.array(*map(F.lit, ("de", "en", "fr", "pl"))), (F.abs(F.xxhash64("id", F.lit(1))) % 4 + 1).cast("int")).alias("lang"),
        F.repeat(F.lit("x"), (F.pow(F.lit(2.0), F.abs(F.xxhash64("id", F.lit(2))) % 11)).cast("int")).alias("text"),
        F.lit("kept").alias("curve"),
    )
    folder = f"{tmp_path}/files"
    hilbert.write_curve(docs, folder, file_bytes=16_000)
    assert spark.read.parquet(folder).exceptAll(docs).count() == 0 and spark.read.parquet(folder).count() == 8_000
    files = hilbert.file_ranges(spark, folder, ["source", "lang", "doc_id"]).collect()
    assert len(files) > 60
    touched = {
        "source": sum(r.min_source <= "s3" <= r.max_source for r in files),
        "lang": sum(r.min_lang <= "fr" <= r.max_lang for r in files),
        "doc_id": sum(r.min_doc_id <= 3_000 <= r.max_doc_id for r in files),
    }
    # sorted by one column, only a filter on it would leave files out
    assert all(n < 0.75 * len(files) for n in touched.values()), (len(files), touched)
    both = sum(r.min_source <= "s3" <= r.max_source and r.min_lang <= "fr" <= r.max_lang and r.min_doc_id <= 3_000 <= r.max_doc_id for r in files)
    assert both < 0.3 * len(files)
