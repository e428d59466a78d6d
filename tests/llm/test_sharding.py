from collections import Counter
from math import comb

from pyspark.sql import functions as F

from pagemill.llm.sharding import hypergeometric, op1_hypergeometric_shards, shuffle_into_shards


def test_hypergeometric_follows_its_law(spark):
    for good, total, draws in ((30, 100, 40), (70, 100, 25), (500, 1200, 900), (3, 50, 20), (40, 60, 4)):
        n = 2500
        rows = spark.range(n).select(
            hypergeometric(*[F.lit(v).cast("bigint") for v in (good, total, draws)], F.col("id")).alias("k")
        )
        seen = Counter(r.k for r in rows.collect())
        stat = cells = 0
        for k in range(max(0, draws - total + good), min(draws, good) + 1):
            expected = n * comb(good, k) * comb(total - good, draws - k) / comb(total, draws)
            if expected >= 8:
                stat += (seen[k] - expected) ** 2 / expected
                cells += 1
        assert stat < cells + 5 * (2 * cells) ** 0.5, (good, total, draws, stat, cells)


def test_rows_law_and_slots(spark):
    df = spark.range(0, 1003, 1, 7).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("shard")
    )
    out = shuffle_into_shards(df, 24, block_bits=5, bucket_rows=16).collect()
    assert len(out) == 1003
    per = Counter(r.shard for r in out)
    assert set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(per[s]))
    assert Counter(r.doc_id for r in out)[None] == sum(1 for i in range(1003) if i % 3 == 0)


def test_query_over_a_whole_table(spark, tmp_path):
    import zlib

    texts = ["", None, "é" * 5000, "same", "same", *(f"text {i}" for i in range(300))]
    rows = [(i if i % 9 else None, t, i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, shard int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = op1_hypergeometric_shards(spark, f"file://{tmp_path}").collect()
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for i, t, _ in rows]
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in out) == Counter(want)
    per = Counter(r.shard for r in out)
    assert set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in per.items())


def test_empty(spark):
    assert shuffle_into_shards(spark.range(0)).count() == 0
