"""Shards of documents next to a border, in totals far above what a quotient of six digits tells apart."""

from pyspark.sql import functions as F

from revlume.llm.op8_hilbert_shards import _shard_of, place_on_shards, sharded_documents


def test_middle_bytes(spark):
    cases = []
    for total in (40_000_000, 10**14, 10**18 // 2):
        for size in (1, 2, 3, 1000):
            for k in range(17):
                border = total * k // 16
                cases += [(start, size, total) for start in (border - size, border - 1, border, border + 1) if 0 <= start <= total - size]
    frame = spark.createDataFrame(cases, "start long, size long, total long")
    rows = frame.withColumn("shard", _shard_of("start", "size", "total", 16)).collect()
    assert all(r.shard == (2 * r.start + r.size) * 16 // (2 * r.total) and 0 <= r.shard < 16 for r in rows)


def test_short_documents_in_a_large_table(spark):
    long = spark.range(40).select("id", F.repeat(F.lit("0123456789"), 100_000).alias("text"), F.lit("a").alias("source"))
    short = spark.range(40, 120).select("id", F.when(F.col("id") % 2 == 0, F.lit("")).alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    docs = long.unionByName(short).select(F.col("id").alias("doc_id"), "text", "source", F.lit("en").alias("lang"))
    for found in (place_on_shards(docs), sharded_documents(docs)):
        counts = {r.shard: r["count"] for r in found.groupBy("shard").count().collect()}
        assert set(counts) <= set(range(16)) and sum(counts.values()) == 120
