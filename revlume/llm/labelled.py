"""Bounded samples of labelled documents, and which documents are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the checksum of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: dict[int, int], max_chars: int
) -> tuple[DataFrame, dict[int, int]]:
    """``text``, ``y`` of a bounded sample of documents outside the held-out fold, and all label counts.

    Each class gives its first rows by hash of the id, at most ``per_class``.  Null labels and ids count
    for nothing; a document with several labels has the one that most of them give, 1 on a tie.  An id that
    stands in ``docs`` several times gives one text, the first by hash.  A class ends with the row in which its
    texts reach ``max_chars`` together: very long texts make it have fewer rows, none is passed over for its length.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    known = known.where(fold(F.col("doc_id"), folds) != held_out)
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    parts = [known.where(F.col("y") == y).orderBy(*order).limit(n) for y, n in per_class.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    # One text of each chosen id: a class has no more rows than ids, and repeated rows displace nothing.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).getField("text").alias("text")
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(least)
    # No more rows than the classes may give, so a class is a small group.
    before = Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sample = sample.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    sample = sample.where(F.col("before") < max_chars).orderBy("y", *order)
    return sample.select("text", "y"), counts
