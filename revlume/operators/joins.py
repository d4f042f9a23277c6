"""Joins that broadcast only what was counted first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 128 << 20
#: A key that holds more than one of this many equal parts of all rows is spread over salts.
PARTS = 1_000
# Counters of the frequency sketch: its error is below a quarter of such a part.
_TRACKED = 16_384


def _width(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16
    return F.lit(16)


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows of at most ``max_bytes`` together; counts no further."""
    width = reduce(lambda a, b: a + b, [_width(df, c) for c in df.columns], F.lit(0)).cast("long")
    some = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return some.n <= max_rows and (some.bytes or 0) <= max_bytes


def heavy_keys(rows: DataFrame, on: list[str], parts: int = PARTS) -> DataFrame:
    """``_key, _salts`` of the keys that hold more than one of ``parts`` equal parts of ``rows``.

    A frequency sketch of fixed size counts the hashed keys in one pass, combined within each task; there are at
    most ``parts`` such keys, and all their salts together are at most twice that.  What the sketch misjudges
    costs balance, never a row.
    """
    counted = rows.select(F.xxhash64(*on).alias("k")).agg(
        F.expr(f"approx_top_k(k, {parts}, {max(_TRACKED, 16 * parts)})").alias("top"), F.count("*").alias("n")
    )
    most = counted.select("n", F.explode("top").alias("t"))
    salts = F.ceil(F.col("t.count") * parts / F.col("n")).cast("long")
    listed = most.where(F.col("t.count") * parts > F.col("n")).select(F.col("t.item").alias("_key"), salts.alias("_salts"))
    found = [(r["_key"], r["_salts"]) for r in listed.collect()]
    return rows.sparkSession.createDataFrame(found, "_key long, _salts long")


def spread(
    rows: DataFrame, listed: DataFrame, on: list[str], spread_by: list[str], parts: int = PARTS
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: rows of heavy keys are dealt over the salts of their key, and only the listed
    rows of those keys are repeated."""
    heavy = F.broadcast(heavy_keys(rows, on, parts))
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    dealt = rows.withColumn("_key", F.xxhash64(*on)).join(heavy, "_key", "left")
    copies = listed.withColumn("_key", F.xxhash64(*on)).join(heavy, "_key", "left")
    every_salt = F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))
    return (
        dealt.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts)).drop("_key", "_salts"),
        copies.withColumn("_salt", every_salt).drop("_key", "_salts"),
    )


def matched(rows: DataFrame, listed: DataFrame, on: list[str], how: str, hint: bool = False) -> DataFrame:
    """A join in which null equals null, as it does in windows and groups."""
    renamed = listed.select(*[F.col(c).alias(f"_on_{c}" if c in on else c) for c in listed.columns])
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(renamed[f"_on_{c}"]) for c in on])
    return rows.join(F.broadcast(renamed) if hint else renamed, same, how).drop(*[f"_on_{c}" for c in on])


def _join(
    rows: DataFrame, listed: DataFrame, on: list[str], how: str,
    spread_by: list[str], max_broadcast_rows: int,
) -> DataFrame:
    """``rows`` joined to a list with at most one row per key.

    A short list is broadcast, so ``rows`` is not shuffled.  A longer one is
    joined by a shuffle, in which keys that hold a large share of all rows are
    dealt over salts by the ``spread_by`` columns.
    """
    if fits(listed, max_broadcast_rows):
        return matched(rows, listed, on, how, hint=True)
    if not spread_by:
        return matched(rows, listed, on, how)
    dealt, copies = spread(rows, listed, on, spread_by)
    return matched(dealt, copies, [*on, "_salt"], how).drop("_salt")


def without(
    rows: DataFrame, listed: DataFrame, on: list[str],
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Rows whose key is not in ``listed``; the key is spread as it is."""
    return _join(rows, listed.select(*on), on, "left_anti", [], max_broadcast_rows)


def only(
    rows: DataFrame, listed: DataFrame, on: list[str], spread_by: list[str],
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Rows whose key is in ``listed``."""
    return _join(rows, listed.select(*on), on, "left_semi", spread_by, max_broadcast_rows)


def with_attributes(
    rows: DataFrame, attributes: DataFrame, on: list[str], spread_by: list[str],
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Rows with the columns of ``attributes``, which has one row per key."""
    return _join(rows, attributes, on, "left", spread_by, max_broadcast_rows)
