"""Removing repeated passages by recompression.

Texts are parsed in rounds, each naming runs of one token and pairs of a left and a right token anew (A.
Jez, 2015; names are fingerprints, so a name means the same everywhere and no dictionary is shuffled).
What a symbol looks like depends only on its own words and a few next to it, so equal passages get equal
symbols inside, wherever they stand.  After three rounds every border between words has a level: the
last round that still keeps two symbols apart there.

Each window of ``WINDOW`` words is anchored at its border of the highest level, named by the eight words
around it; equal windows have equally named anchors.  Names that occur in more than one document reveal
the windows that can repeat, about a quarter as many names as there are words are compared for that; only
windows at such anchors are then compared whole, and the smallest document of each is told to the others.

Documents are dealt to groups of a few megabytes of text.  Names and windows are reduced to distinct ones
inside a group before they are shuffled, so a passage that a third of all documents share costs one entry
per group.  Nothing is collected but inside a group or a bucket of bounded size.

Defined results: a null text has no words; a null id is larger than any other; documents with equal ids
do not remove from each other; a window that repeats inside one document only stays; repeated rows get
equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from revlume.llm.cluster import ship
from revlume.llm.words import NOT_SPACE, mix, prints_of, runs_print

WINDOW = 13
#: Words on each side of an anchor that name it; the parse looks no further.
SIDE = 4
#: Text of a group of documents, and text whose names share a bucket.
GROUP_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20

_NONE = np.iinfo(np.int64).max
_SPANS = "array<struct<start:int,words:int>>"


def _pair(a: np.ndarray, b: np.ndarray, round_: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15 + 2 * round_) ^ (b + np.uint64(round_)))


def _is_left(names: np.ndarray, round_: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(names + np.uint64(0x51ED27 * round_)) & np.uint64(1)) == 1


def levels(words: np.ndarray) -> np.ndarray:
    """For each word, the level (0 to 3) of the border before it.

    Exact inside a text for borders with ``SIDE`` words on either side; a run of one word has no border,
    so it is one token for all rounds.
    """
    n = len(words)
    place = np.arange(n)
    before, after = np.maximum(place - 1, 0), np.minimum(place + 1, n - 1)
    split = np.ones(n, bool)
    level = np.zeros(n, np.int8)
    # Tokens that end and that begin at a border, and where those begin and end.
    ending, beginning = words[before], words
    start, stop = before, after
    for round_ in range(1, 4):
        split = split & (ending != beginning) & ~(_is_left(ending, round_) & ~_is_left(beginning, round_))
        level += split
        if round_ < 3:
            # A token joins its neighbour where the border between them is gone.
            joined = np.where(split[start], ending, _pair(ending[start], ending, round_))
            following = np.where(split[stop], beginning, _pair(beginning, beginning[stop], round_))
            start = np.where(split[start], start, start[start])
            stop = np.where(split[stop], stop, stop[stop])
            ending, beginning = joined, following
    return level


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, anchor name and text of every window of ``WINDOW`` words."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    name = np.zeros(len(words), np.uint64)
    around = runs_print(words, 2 * SIDE)
    name[SIDE : SIDE + len(around)] = around
    order = (3 - levels(words)).astype(np.uint64) << np.uint64(62) | name >> np.uint64(2)
    best, at = order[SIDE : SIDE + n].copy(), np.arange(SIDE, SIDE + n)
    for d in range(1, WINDOW - 2 * SIDE + 1):
        nearer = order[SIDE + d : SIDE + d + n] < best
        best[nearer] = order[SIDE + d : SIDE + d + n][nearer]
        at[nearer] = np.flatnonzero(nearer) + SIDE + d
    whole = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    return whole, name[at[whole]], owner[whole]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").fill_null(_NONE).to_numpy()


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return prints_of(table.column("text").combine_chunks(), NOT_SPACE, lower=False)


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, with the smallest and the largest id of each."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(begin):
        return keys, ids, ids
    return keys[begin], np.minimum.reduceat(ids, begin), np.maximum.reduceat(ids, begin)


def _dealt(group: int, keys: np.ndarray, values: np.ndarray, buckets: int) -> pa.Table:
    """Sorted keys and their values, packed by bucket of the key."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, values = bucket[order], keys[order], values[order]
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*begin[1:], len(bucket)][: len(begin)]
    return pa.table(
        {
            "bucket": pa.array(bucket[begin], pa.int64()),
            "part": pa.array(np.full(len(begin), group), pa.int64()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary()),
            "vals": pa.array([values[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary()),
        }
    )


def _unpacked(table: pa.Table, column: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in table.column(column)]


_DEALT = "bucket long, part long, keys binary, vals binary"
_TOLD = "part long, keys binary, vals binary"


def _name_anchors(buckets: int):
    """The distinct anchor names of a group, and whether several of its documents have them."""

    def run(table: pa.Table) -> pa.Table:
        words, first = _words(table)
        _, names, owner = anchors(words, first)
        keys, low, high = _least(names, _ids(table)[owner])
        return _dealt(table.column("part")[0].as_py(), keys, (low != high).astype(np.uint8), buckets)

    return run


def _told(parts: list[int], keys: list[np.ndarray], values: list[np.ndarray]) -> pa.Table:
    kept = [k for k in range(len(parts)) if len(keys[k])]
    return pa.table(
        {
            "part": pa.array([parts[k] for k in kept], pa.int64()),
            "keys": pa.array([keys[k].tobytes() for k in kept], pa.binary()),
            "vals": pa.array([values[k].tobytes() for k in kept], pa.binary()),
        }
    )


def _repeated_names(table: pa.Table) -> pa.Table:
    """Tells each group which of its names more than one document has."""
    keys, several = _unpacked(table, "keys", np.uint64), _unpacked(table, "vals", np.uint8)
    _, at, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    repeated = count > 1
    repeated[at[np.concatenate(several) == 1]] = True
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    hits = np.split(repeated[at], cuts)
    keys = [k[h] for k, h in zip(keys, hits, strict=True)]
    return _told(table.column("part").to_pylist(), keys, [np.zeros(len(k), np.uint8) for k in keys])


def _windows_at(buckets: int):
    """The distinct windows of a group that stand at repeated anchors, with their smallest document."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        words, first = _words(table)
        start, names, owner = anchors(words, first)
        repeated = np.sort(np.concatenate([np.zeros(0, np.uint64), *_unpacked(told, "keys", np.uint64)]))
        hit = _member(names, repeated) >= 0
        keys, low, _ = _least(runs_print(words, WINDOW)[start[hit]], _ids(table)[owner[hit]])
        return _dealt(table.column("part")[0].as_py(), keys, low, buckets)

    return run


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each value among the sorted known ones, -1 where it is none of them."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _smallest_documents(table: pa.Table) -> pa.Table:
    """Tells each group of the windows that a smaller document of another group has."""
    keys, low = _unpacked(table, "keys", np.uint64), _unpacked(table, "vals", np.int64)
    every, least, _ = _least(np.concatenate(keys), np.concatenate(low))
    out_keys, out_low = [], []
    for k, own in zip(keys, low, strict=True):
        best = least[np.searchsorted(every, k)]
        smaller = best < own
        out_keys.append(k[smaller])
        out_low.append(best[smaller])
    return _told(table.column("part").to_pylist(), out_keys, out_low)


def _removed(table: pa.Table, told: pa.Table) -> pa.Table:
    """The group's documents without the words of windows that a smaller document has."""
    words, first = _words(table)
    ids = _ids(table)
    start, _, owner = anchors(words, first)
    keys = runs_print(words, WINDOW)[start]
    known, least, _ = _least(keys, ids[owner])
    other = np.concatenate([np.zeros(0, np.uint64), *_unpacked(told, "keys", np.uint64)])
    smaller = np.concatenate([np.zeros(0, np.int64), *_unpacked(told, "vals", np.int64)])
    at = _member(other, known)
    np.minimum.at(least, at[at >= 0], smaller[at >= 0])
    repeats = least[np.searchsorted(known, keys)] < ids[owner] if len(keys) else np.zeros(0, bool)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, start[repeats], 1)
    np.add.at(cover, start[repeats] + WINDOW, -1)
    gone = np.cumsum(cover[:-1]) > 0
    texts, spans, removed = [], [], []
    for k, text in enumerate(table.column("text")):
        here = gone[first[k] : first[k + 1]]
        split = (text.as_py() or "").encode().split()
        texts.append(b" ".join(compress(split, ~here)).decode())
        edge = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]])))
        spans.append([{"start": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        removed.append(int(here.sum()))
    return pa.table(
        {
            "doc_id": table.column("id"),
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))),
            "kept_text": pa.array(texts, pa.string()),
        }
    )


def remove_repeats(docs: DataFrame, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, its words, those removed (count and spans) and the kept text."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups, buckets = max(1, math.ceil(total / group_bytes)), max(1, math.ceil(total / bucket_bytes))
    part = F.pmod(F.xxhash64("doc_id", text), F.lit(groups)).cast("long")
    rows = docs.select(part.alias("part"), F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    by_part = rows.groupBy("part")
    names = by_part.applyInArrow(_name_anchors(buckets), _DEALT)
    repeated = names.groupBy("bucket").applyInArrow(_repeated_names, _TOLD)
    windows = by_part.cogroup(repeated.groupBy("part")).applyInArrow(_windows_at(buckets), _DEALT)
    smallest = windows.groupBy("bucket").applyInArrow(_smallest_documents, _TOLD)
    result = f"doc_id long, n_words long, n_removed long, removed {_SPANS}, kept_text string"
    return by_part.cogroup(smallest.groupBy("part")).applyInArrow(_removed, result)


def op10_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


OP10_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(CAST(doc_id AS BIGINT), 9223372036854775807) AS id, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), win AS (
  SELECT r, id, j, array_to_string(w[j:j + 12], ' ') AS win
  FROM (SELECT r, id, w, unnest(range(1, len(w) - 11)) AS j FROM d WHERE len(w) >= 13)
), least AS (
  SELECT win, min(id) AS low FROM win GROUP BY win HAVING min(id) < max(id)
), hit AS (
  SELECT r, list(DISTINCT p) AS gone FROM (
    SELECT r, unnest(range(j, j + 13)) AS p FROM win JOIN least USING (win) WHERE id > low
  ) GROUP BY r
), k AS (
  SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS g,
         CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM d LEFT JOIN hit USING (r)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""
