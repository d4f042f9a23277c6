"""Mixing sources to target weights by a low-discrepancy schedule.

The words of each source, its documents in shuffled order, are one stream, cut into blocks of equally
many words.  A schedule of slots says whose block comes next: van der Corput points are mapped through
the cumulative slot counts of the sources, so every stretch of the schedule holds each source in its
share.  Ranking the slots of a source gives the block each slot takes, over and over through the
stream; a document is taken as often as the slots reach its words.

All of it is DataFrame work on narrow rows: texts are read once, for their sizes.  Running sums and
ranks are taken in two levels (a hashed bucket, then inside it), so a source with a third of all rows
is spread over as many tasks as there are buckets.

Defined results: a null or empty text has size 0 and is never taken; null is a source of its own, the
last; rows with equal id, source and size are separate documents, ordered arbitrarily but to the same
multiset of results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from revlume.session import staged

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
BLOCK_WORDS = 2048
#: Lattice points that one task row unfolds.
CHUNK = 4096
#: Hexadecimal digits of the shuffle order that make a bucket: 4,096 buckets to a source.
BUCKET_DIGITS = 3
#: Bits of a slot number that make a bucket of slots.
SLOT_BUCKET_BITS = 12

_BEFORE = (Window.unboundedPreceding, -1)


def _source_key(source: Column) -> Column:
    """Sorts by code point with null last, and is never null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def sized_documents(docs: DataFrame) -> DataFrame:
    """One narrow row per document: ``doc_id``, ``src``, ``size`` in words and its shuffled place."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", _source_key(F.col("source")).alias("src"), size.alias("size"), order.alias("place")).withColumn(
        "bucket", F.substring("place", 1, BUCKET_DIGITS)
    )


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """One row per source: its size, target, and how far the mix goes through its stream.

    Targets share the total by weight.  A target above ``max_repeat`` sizes stops there and the rest is
    shared again until none is above: with sources in order of size per weight, the common level per
    weight is the largest of the levels that leave out the first none, one, two, ... of them.
    """
    by_source = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("number", F.row_number().over(Window.orderBy("src")) - 1)
    given = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", given.cast("long")).withColumn("cap", F.col("source_size") * max_repeat)
    everything = Window.partitionBy()
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(*_BEFORE)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_room), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_room), F.lit(0))
    levels = ranked.withColumn("level", left.cast("double") / weight_left.cast("double"))
    target = F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight"))
    words = F.floor(F.col("target") + 0.5)
    return levels.withColumn("target", target).select(
        "src", "number", "weight", "source_size", "target",
        F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0)).alias("turns"),
        F.when(F.col("source_size") > 0, words % F.col("source_size")).otherwise(F.lit(0)).alias("rest"),
    )


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix: ``slot`` (its order), ``src``, ``block``, ``turn`` and ``words`` it takes."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    wanted = targets.withColumn("n_blocks", blocks).withColumn(
        "n_slots", F.col("turns") * F.col("n_blocks") + F.ceil(F.col("rest") / block_words).cast("long")
    )
    everything = Window.partitionBy()
    above = F.sum("n_slots").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    wanted = wanted.withColumn("high", above).withColumn("all_slots", F.sum("n_slots").over(everything))
    # The lattice of points has 2^bits of them, the least power of two that holds all slots.
    bits = F.greatest(F.length(F.bin(F.greatest(F.col("all_slots") - 1, F.lit(0)))), F.lit(1))
    wanted = wanted.where("n_slots > 0").withColumn("bits", bits)
    lattice = F.expr("shiftleft(1L, bits)").cast("decimal(38,0)")
    point = lambda c: (F.floor(c.cast("decimal(19,0)") * lattice / F.col("all_slots"))).cast("long")
    wanted = wanted.withColumn("from", point(F.col("high") - F.col("n_slots"))).withColumn("to", point(F.col("high")))
    chunks = wanted.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (to - from - 1) div {CHUNK})")))
    chunks = chunks.repartition(F.col("src"), F.col("chunk"))
    first = F.col("from") + F.col("chunk") * CHUNK
    points = chunks.withColumn("point", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("to")) - 1)))
    # Van der Corput in base two: the bits of the point, read backwards, are its slot.
    reversed_bits = F.reverse(F.expr("lpad(bin(point), bits, '0')"))
    slots = points.withColumn("slot", F.conv(reversed_bits, 2, 10).cast("long"))
    part = F.expr(f"shiftright(slot, greatest(bits - {SLOT_BUCKET_BITS}, 0))")
    slots = slots.withColumn("part", part)
    counts = slots.groupBy("src", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(*_BEFORE)), F.lit(0))
    counts = counts.select("src", "part", earlier.alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("src", "part").orderBy("slot")) - 1 + F.col("earlier")
    ranked = slots.join(counts, ["src", "part"]).withColumn("rank", rank).where("rank < n_slots")
    taken = ranked.withColumn("block", F.col("rank") % F.col("n_blocks")).withColumn("turn", F.expr("rank div n_blocks"))
    stop = F.when(F.col("turn") < F.col("turns"), F.col("source_size")).otherwise(F.col("rest"))
    used = F.least(stop - F.col("block") * block_words, F.lit(block_words))
    return taken.select("slot", "src", "block", "turn", used.cast("long").alias("words"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS
) -> tuple[DataFrame, DataFrame]:
    """The schedule, and one row per document with the words that the mix takes of it."""
    sized = staged(sized_documents(docs), "op1-sizes")
    targets = staged(source_targets(sized, weights, max_repeat), "op1-targets")
    slots = schedule(targets, block_words)

    # Where each document starts in the stream of its source.
    sums = sized.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = F.sum("bucket_size").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(*_BEFORE))
    sums = sums.withColumn("offset", F.coalesce(earlier, F.lit(0)))
    sums = sums.join(targets, "src").select("src", "bucket", "offset", "source_size", "target")
    inside = Window.partitionBy("src", "bucket").orderBy("place", "doc_id", "size").rowsBetween(*_BEFORE)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["src", "bucket"])
    placed = placed.withColumn("start", F.col("offset") + F.col("inside")).withColumn("end", F.col("start") + F.col("size"))

    # Documents cut at block limits meet the slots that take the block.
    span = F.expr(f"sequence(start div {block_words}, greatest(end - 1, start) div {block_words})")
    cut = placed.withColumn("block", F.explode(span))
    begin = F.col("block") * block_words
    cut = cut.withColumn("low", F.greatest(F.col("start") - begin, F.lit(0))).withColumn(
        "high", F.least(F.col("end") - begin, F.lit(block_words))
    )
    met = cut.join(slots.select("src", "block", "words"), ["src", "block"], "left")
    got = F.greatest(F.least(F.col("high"), F.coalesce(F.col("words"), F.lit(0))) - F.col("low"), F.lit(0))
    # Documents without words share a start, and are told apart by nothing: they are added as they are.
    keys = ["doc_id", "src", "size", "source_size", "target", "start", "place"]
    taken = met.where("size > 0").groupBy(*keys).agg(F.sum(got).alias("taken"))
    unsized = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return slots, taken.unionByName(unsized)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (its taken words over its words, rounded).

    Documents without words have nothing to take and are left out.  Rows with the same id, source and
    size share their turns evenly.
    """
    _, taken = mix(docs, **options)
    per_row = (2 * F.sum("taken") + F.sum("size")).cast("long")
    copies = taken.where("size > 0").groupBy("doc_id", "src", "size").agg(per_row.alias("twice"), F.sum("size").alias("words"))
    copies = copies.select(
        F.col("doc_id").alias("m_id"), F.col("src").alias("m_src"), F.col("size").alias("m_size"),
        F.expr("twice div (2 * words)").alias("m_copies"),
    ).where("m_copies > 0")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("r_id"))
    size = F.regexp_count(F.col("row.text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    whole = whole.withColumn("r_src", _source_key(F.col("row.source"))).withColumn("r_size", size)
    same = F.col("r_id").eqNullSafe(F.col("m_id")) & (F.col("r_src") == F.col("m_src")) & (F.col("r_size") == F.col("m_size"))
    repeated = whole.join(copies, same).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("m_copies").cast("int"))))
    return repeated.select("row.*")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    _, taken = mix(docs)
    return taken.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents
), s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src) - 1 AS number FROM d GROUP BY src
), w AS (
  SELECT *, number % 3 + 1 AS weight, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER o AS BIGINT), 0) AS DOUBLE)
            / CAST(CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER o AS BIGINT), 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT src, source_size, least(CAST(cap AS DOUBLE), (max(level) OVER ()) * weight) AS target FROM l
), q AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words FROM t
), p AS (
  SELECT d.*, source_size, target, words,
         coalesce(CAST(sum(size) OVER (PARTITION BY src ORDER BY place, doc_id, size
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM d JOIN q USING (src)
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0
            ELSE size * (words // source_size)
                 + greatest(0, least(start + size, words % source_size) - start) END AS taken
FROM p
"""
