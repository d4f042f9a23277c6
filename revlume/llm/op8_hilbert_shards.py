"""Sharding along a Hilbert curve.

Source, language and size are quantised to cells of a cube, the cells are put in the order of the
Hilbert curve through the cube, and the documents in that order are cut into runs of nearly equal
bytes.  Neighbours on the curve are neighbours in all three dimensions, so each shard covers a small
box of them and readers skip the others by file statistics.

Only narrow rows are sorted, in three levels: the cell, a hashed bucket inside the cell, and the rows of
the bucket.  Sums of the first two levels give every bucket its place, so no sort covers the table and a
cell with a third of all rows is spread over as many tasks as there are buckets.

Defined results: null texts have size 1 and checksum 0; null sources and languages are a value of their
own, the last; ties go by id, then checksum; equal rows take the next places in any order; an empty
table gives an empty result; extra columns are ignored or carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from revlume.llm.cluster import ship
from revlume.session import staged

SHARDS = 16
#: Bits of each dimension; the cube has 2^(3 x BITS) cells.
BITS = 5
BUCKETS = 4096

_BEFORE = (Window.unboundedPreceding, -1)


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``axes``, whole numbers below 2^bits.

    After J. Skilling, Programming the Hilbert curve (2004): undo the turns and mirrorings of each
    level, then decode the Gray code.
    """
    x = axes.astype(np.int64).copy()
    n = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            mirrored = (x[:, i] & level) > 0
            swap = np.where(mirrored, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(mirrored, low, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[:, n - 1] & level) > 0, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[:, i] >> bit) & 1)
    return place


def _curve(bits: int):
    @F.pandas_udf("long")
    def run(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for parts in frames:
            yield pd.Series(hilbert_index(np.stack([p.to_numpy(np.int64) for p in parts], axis=1), bits))

    return run


def _named(column: Column) -> Column:
    """A text that sorts by code point with null last, and is never null."""
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), column.cast("string")))


def _cells(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """Each value of a text column with its cell: values in order, cut where equal shares of the rows end."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(column).rowsBetween(*_BEFORE)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    share = ((F.lit(2) * before + F.col("n")) * F.lit(1 << bits) / (F.lit(2) * total)).cast("int")
    return counts.select(column, share.alias(f"{column}_cell"))


def measured(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, dimensions, size in bytes and checksum of its text."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id"),
        _named(F.col("source")).alias("src"),
        _named(F.col("lang")).alias("lng"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )


def _shard_of(start: str, size: str, total: str, shards: int) -> Column:
    """The run that holds a document's middle byte; whole numbers throughout, as a quotient of decimals is rounded."""
    exact = lambda c: f"cast({c} AS decimal(38,0))"
    return F.expr(f"(2 * {exact(start)} + {exact(size)}) * {shards} div (2 * {exact(total)})").cast("int")


def place_on_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, buckets: int = BUCKETS) -> DataFrame:
    """One row per document with its shard, its gapless slot in the shard and its curve index."""
    ship(docs.sparkSession)
    rows = staged(measured(docs), "op8-measured")
    # One cell for each doubling of the size, the last one open.
    doublings = F.least(F.length(F.bin("size")) - 1, F.lit((1 << bits) - 1))
    combos = rows.withColumn("size_cell", doublings).groupBy("src", "lng", "size_cell").agg(F.count(F.lit(1)).alias("n"))
    combos = combos.join(_cells(rows, "src", bits), "src").join(_cells(rows, "lng", bits), "lng")
    combos = combos.select("src", "lng", "size_cell", _curve(bits)("src_cell", "lng_cell", "size_cell").alias("curve"))
    salt = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(64)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(63)))
    keys = ["src", "lng", "size_cell", "salt"]
    placed = rows.withColumn("size_cell", doublings).withColumn("salt", salt).join(combos.withColumn("salt", salts), keys)
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int")
    placed = staged(placed.select("doc_id", "size", "text_crc32", "curve", bucket.alias("bucket")), "op8-curve")

    sums = placed.groupBy("curve", "bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    cells = sums.groupBy("curve").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    by_curve = Window.orderBy("curve").rowsBetween(*_BEFORE)
    cells = cells.select(
        "curve",
        F.coalesce(F.sum("bytes").over(by_curve), F.lit(0)).alias("c_bytes"),
        F.coalesce(F.sum("n").over(by_curve), F.lit(0)).alias("c_n"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    by_bucket = Window.partitionBy("curve").orderBy("bucket").rowsBetween(*_BEFORE)
    offsets = sums.select(
        "curve", "bucket",
        F.coalesce(F.sum("bytes").over(by_bucket), F.lit(0)).alias("b_bytes"),
        F.coalesce(F.sum("n").over(by_bucket), F.lit(0)).alias("b_n"),
    ).join(cells, "curve")
    inside = Window.partitionBy("curve", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(*_BEFORE)
    ordered = placed.withColumn("i_bytes", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn(
        "i_n", F.count(F.lit(1)).over(inside)
    )
    ordered = ordered.join(offsets, ["curve", "bucket"])
    start = F.col("c_bytes") + F.col("b_bytes") + F.col("i_bytes")
    ordered = ordered.withColumn("start", start)
    ordered = ordered.select(
        "doc_id", "size", "text_crc32", "curve", _shard_of("start", "size", "total", shards).alias("shard"),
        (F.col("c_n") + F.col("b_n") + F.col("i_n")).alias("position"),
    )
    # The first position of each run; there are no more runs than shards.
    ordered = staged(ordered, "op8-ordered")
    firsts = ordered.groupBy("shard").agg(F.min("position").alias("first"))
    return ordered.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` added (existing columns of these names are replaced).

    Rows of equal id and text are interchangeable: they take the slots of their group in any order.
    """
    order = Window.partitionBy("p_id", "p_crc", "p_size").orderBy("shard", "slot")
    plan = place_on_shards(docs, shards).select(
        F.col("doc_id").alias("p_id"), F.col("text_crc32").alias("p_crc"), F.col("size").alias("p_size"), "shard", "slot"
    )
    plan = plan.withColumn("copy", F.row_number().over(order))
    whole = docs.select(F.struct("*").alias("row"), *_identity(docs))
    whole = whole.withColumn("r_copy", F.row_number().over(Window.partitionBy("r_id", "r_crc", "r_size").orderBy("r_src", "r_lng")))
    same = (
        F.col("r_id").eqNullSafe(F.col("p_id")) & (F.col("r_crc") == F.col("p_crc"))
        & (F.col("r_size") == F.col("p_size")) & (F.col("r_copy") == F.col("copy"))
    )
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return whole.join(plan, same).select(*kept, "shard", "slot")


def _identity(docs: DataFrame) -> list[Column]:
    text = F.col("text").cast("string")
    return [
        F.col("doc_id").alias("r_id"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("r_crc"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("r_size"),
        F.col("source").alias("r_src"),
        F.col("lang").alias("r_lng"),
    ]


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs`` as one folder per shard, rows in curve order inside it."""
    out = sharded_documents(docs, shards)
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    return place_on_shards(docs)
