"""Benchmark decontamination with suffix arrays of the training texts.

Each shard of training texts gets a suffix array over its words: the positions at which a test suffix
can begin, sorted by the words that follow.  (A position whose first two words open no window of the
tests is left out of the array, as no search can end there.)  Every suffix of every test is searched by
bisection; the equal range gives all its verbatim occurrences.  Occurrences of one test that follow each
other word by word in test and text alike are one verbatim match; ``matches`` are the longest of them, with
their places in text and test.  ``spans`` are the runs of words that any occurrence covers, which may belong
to several tests.  Nothing is shuffled: a shard is what one task holds of the
documents at a time, and the tests travel to it in blocks of bounded size.  A text is never split, however
long it is; what a task holds beside it is the occurrences in that text, taken a bounded number at a time.

Defined results: a null text has no words; an empty test, or one of no words, matches nothing; a test
with a null id counts as the id ``null``; tests that share an id count once; repeated documents each
get their row; an empty table gives an empty result; extra columns are ignored or carried unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revlume.llm.cluster import ship
from revlume.llm.words import ALNUM, pieces, prints_of, runs_print
from revlume.session import staged

WINDOW = 10
#: Text that a task takes as one shard.
SHARD_BYTES = 4 << 20
#: Characters of tests that travel at once; more tests make more passes.
BLOCK_CHARS = 2_000_000

#: Pairs of an occurrence and its place in a test that are looked at at once.
PAIRS = 1 << 20

_SPAN = "array<struct<start:int,words:int>>"
_MATCH = "array<struct<start:int,words:int,item:string,item_start:int>>"
_FOUND = f"n_words long, n_hit long, spans {_SPAN}, items array<string>, matches {_MATCH}"
_MATCH_ARROW = pa.list_(pa.struct(
    [("start", pa.int32()), ("words", pa.int32()), ("item", pa.string()), ("item_start", pa.int32())]
))


class TestSuffixes:
    """The windows of a block of tests, sorted, each with the tests it occurs in."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW) -> None:
        prints, first = prints_of(pa.array(texts, pa.string()), ALNUM, lower=True)
        self.window, rows, owner, offset, size = window, [], [], [], []
        for t in range(len(ids)):
            words = prints[first[t] : first[t + 1]]
            k = min(window, len(words))
            for j in range(len(words) - k + 1 if k else 0):
                rows.append(np.concatenate([words[j : j + k], np.zeros(window - k, np.uint64)]))
                owner.append(t)
                offset.append(j)
                size.append(k)
        self.ids = ids
        table = np.array(rows, np.uint64).reshape(-1, window)
        keys = np.concatenate([table, np.array(size, np.uint64).reshape(-1, 1)], axis=1)
        kept, at = np.unique(keys, axis=0, return_inverse=True)
        self.table, self.size = kept[:, :window], kept[:, window].astype(np.int64)
        order = np.argsort(at.ravel(), kind="stable")
        self.owner = np.array(owner, np.int64)[order]
        self.offset = np.array(offset, np.int64)[order]
        # Windows and, inside each, its tests in order: the tests of a window from one number to another are a range.
        self.held = at.ravel()[order].astype(np.int64) * max(1, len(ids)) + self.owner
        self.owner_first = np.searchsorted(at.ravel()[order], np.arange(len(kept) + 1))
        self.depth = int(min(2, self.size.min())) if len(kept) else 0
        opens = self.table[:, : self.depth] if self.depth else np.zeros((0, 1), np.uint64)
        self.opens = np.unique(np.array([runs_print(x, self.depth)[0] for x in opens], np.uint64))
        self.low = _ordered(self.table)
        high = self.table.copy()
        for k in np.unique(self.size):
            high[self.size == k, k:] = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.high = _ordered(high)


def _ordered(rows: np.ndarray) -> np.ndarray:
    """Rows of 64-bit numbers as byte strings that sort like them."""
    wide = rows.shape[1] * 8
    return np.frombuffer(np.ascontiguousarray(rows.astype(">u8")).tobytes(), f"S{wide}")


def _search(
    words: np.ndarray, first: np.ndarray, tests: TestSuffixes
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with occurrences: its number, the words hit, and the windows found with their places."""
    if not tests.depth or not len(words):
        return
    owner = np.searchsorted(first, np.arange(len(words)), "right") - 1
    end = first[owner + 1]
    opening = runs_print(words, tests.depth)
    at = np.minimum(np.searchsorted(tests.opens, opening), len(tests.opens) - 1)
    begin = np.flatnonzero(tests.opens[at] == opening)
    begin = begin[begin + tests.depth <= end[begin]]
    if not len(begin):
        return
    # The suffix array of this shard, to the depth of a window.
    step = begin[:, None] + np.arange(tests.window)
    suffixes = np.where(step < end[begin][:, None], words[np.minimum(step, len(words) - 1)], np.uint64(0))
    suffixes = _ordered(suffixes)
    order = np.argsort(suffixes, kind="stable")
    suffixes, begin = suffixes[order], begin[order]
    low = np.searchsorted(suffixes, tests.low, "left")
    high = np.searchsorted(suffixes, tests.high, "right")
    found = np.flatnonzero(high > low)
    if not len(found):
        return
    count = high[found] - low[found]
    which = np.repeat(found, count)
    place = begin[np.repeat(low[found] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    fits = place + tests.size[which] <= end[place]
    which, place = which[fits], place[fits]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + tests.size[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    doc = owner[place]
    order = np.argsort(doc, kind="stable")
    doc, which, place = doc[order], which[order], place[order]
    bounds = np.flatnonzero(np.diff(doc, prepend=-1))
    for a, b in zip(bounds, [*bounds[1:], len(doc)], strict=True):
        d = int(doc[a])
        yield d, hit[first[d] : first[d + 1]], which[a:b], place[a:b] - first[d]


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _matches(tests: TestSuffixes, which: np.ndarray, place: np.ndarray, at_once: int = PAIRS) -> list[dict]:
    """The verbatim matches of one text that lie inside no other, by place; of equal ones that of the first id.

    Windows of one test found at places that go on as they do in the test are one match.  Tests are taken in
    ranges, so that about ``at_once`` pairs of an occurrence and a test are held.
    """
    count = max(1, len(tests.ids))
    pairs = int((tests.owner_first[which + 1] - tests.owner_first[which]).sum())
    step = max(1, count * at_once // max(pairs, 1))
    found = []
    for t in range(0, count, step):
        low = np.searchsorted(tests.held, which * count + t)
        n = np.searchsorted(tests.held, which * count + min(t + step, count)) - low
        pair = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        start, test, begin = np.repeat(place, n), tests.owner[pair], tests.offset[pair]
        size = tests.size[np.repeat(which, n)]
        order = np.lexsort((start, start - begin, test))
        start, test, begin, size = start[order], test[order], begin[order], size[order]
        goes_on = (np.diff(test) == 0) & (np.diff(start) == 1) & (np.diff(begin) == 1)
        head = np.flatnonzero(np.concatenate([[True], ~goes_on])[: len(start)])
        tail = np.concatenate([head[1:], [len(start)]])[: len(head)] - 1
        words = start[tail] - start[head] + size[tail]
        found += zip(start[head].tolist(), (-words).tolist(), [tests.ids[i] for i in test[head]], begin[head].tolist(), strict=True)
    kept, end = [], 0
    for start, less, item, begin in sorted(found):
        if start - less > end:
            end = start - less
            kept.append({"start": start, "words": -less, "item": item, "item_start": begin})
    return kept


def _scan(tests_held, only_found: bool):
    """A map over batches of (row, text) that adds the occurrences of a block of tests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestSuffixes = tests_held.value
        for batch in pieces(batches, "text", SHARD_BYTES):
            words, first = prints_of(batch.column("text"), ALNUM, lower=True)
            n = batch.num_rows
            spans: list = [[] for _ in range(n)]
            items: list = [[] for _ in range(n)]
            matches: list = [[] for _ in range(n)]
            n_hit = np.zeros(n, np.int64)
            for d, hit, which, place in _search(words, first, tests):
                owners = [tests.owner[tests.owner_first[w] : tests.owner_first[w + 1]] for w in np.unique(which)]
                matches[d] = _matches(tests, which, place)
                items[d] = sorted({tests.ids[t] for t in np.unique(np.concatenate(owners))})
                spans[d], n_hit[d] = _spans(hit), int(hit.sum())
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(n_hit),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(matches, _MATCH_ARROW),
                ],
                names=["row", "n_words", "n_hit", "spans", "items", "matches"],
            )
            yield out.filter(pa.array(n_hit > 0)) if only_found else out

    return run


def _blocks(benchmark: DataFrame, block_chars: int, window: int) -> Iterator[TestSuffixes]:
    """Tests in blocks of about ``block_chars`` characters; one block is held at a time."""
    tests = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        F.col("text").cast("string").alias("text"),
    )
    total = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_chars))
    for b in range(count):
        here = F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b
        rows = (tests.where(here) if count > 1 else tests).collect()
        yield TestSuffixes([r.item_id for r in rows], [r.text for r in rows], window)


def find_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """All ``docs`` as a struct ``row``, with ``n_words``, ``n_hit``, ``spans``, ``items`` and ``matches``.

    ``spans`` are the runs of words that verbatim windows of the tests cover, as first word and number of
    words; ``items`` are the tests found, sorted as strings; ``matches`` are the longest verbatim matches, as
    first word, number of words, test and first word in the test.  A match inside another is left out, and of
    matches of the same words only that of the smallest id is given.
    """
    spark = docs.sparkSession
    ship(spark)
    whole = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    schema = f"row {whole.schema['row'].dataType.simpleString()}, {_FOUND}"
    blocks = list(_block_passes(spark, benchmark, block_chars, window, whole, schema))
    if len(blocks) == 1:
        return blocks[0]
    return _merged(whole, blocks, schema)


def _block_passes(
    spark: SparkSession, benchmark: DataFrame, block_chars: int, window: int, whole: DataFrame, schema: str
) -> Iterator[DataFrame]:
    held = None
    several = False
    for tests in _blocks(benchmark, block_chars, window):
        if held is not None:
            several = True
            yield _hits_of(whole, held, schema)
        held = spark.sparkContext.broadcast(tests)
    yield _hits_of(whole, held, schema) if several else whole.mapInArrow(_scan(held, False), schema)


def _hits_of(whole: DataFrame, held, schema: str) -> DataFrame:
    """The few rows that one block of many is found in, written."""
    hits = whole.mapInArrow(_scan(held, True), schema)
    key = F.xxhash64(F.col("row.text").cast("string"))
    return staged(hits.select(F.col("row.doc_id").alias("doc_id"), key.alias("key"), "spans", "items", "matches"), "op2-hits")


def _merged(whole: DataFrame, blocks: list[DataFrame], schema: str) -> DataFrame:
    """Occurrences of all blocks put together; equal rows of one document have equal hits."""
    hits = blocks[0]
    for more in blocks[1:]:
        hits = hits.unionByName(more)
    place = F.explode(F.sequence(F.col("s.start"), F.col("s.start") + F.col("s.words") - 1))
    hit_words = (
        hits.select("doc_id", "key", F.explode("spans").alias("s")).select("doc_id", "key", place.alias("w")).distinct()
        .groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("w")).alias("hit"))
    )
    items = (
        hits.select("doc_id", "key", F.explode("items").alias("item")).distinct()
        .groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    longest = (
        hits.select("doc_id", "key", F.explode("matches").alias("m")).distinct()
        .groupBy("doc_id", "key").agg(_outermost(F.collect_list("m")).alias("matches"))
    )
    found = hit_words
    for more in (items, longest):
        more = more.withColumnsRenamed({"doc_id": "f_id", "key": "f_key"})
        same = (F.col("key") == F.col("f_key")) & F.col("doc_id").eqNullSafe(F.col("f_id"))
        found = found.join(more, same).drop("f_id", "f_key")
    found = found.withColumnsRenamed({"doc_id": "f_id", "key": "f_key"})
    counted = whole.mapInArrow(_scan(whole.sparkSession.sparkContext.broadcast(TestSuffixes([], [])), False), schema)
    counted = counted.select("row", "n_words", F.xxhash64(F.col("row.text").cast("string")).alias("r_key"))
    joined = counted.join(found, (F.col("r_key") == F.col("f_key")) & F.col("row.doc_id").eqNullSafe(F.col("f_id")), "left")
    # A span begins where a hit word has no hit word before it.
    begins = F.expr("filter(hit, (w, i) -> i = 0 or hit[i - 1] != w - 1)")
    ends = F.expr("filter(hit, (w, i) -> i = size(hit) - 1 or hit[i + 1] != w + 1)")
    span = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("words")))
    empty = F.array().cast("array<string>")
    return joined.select(
        "row", "n_words", F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(span, F.array().cast(_SPAN)).alias("spans"), F.coalesce("items", empty).alias("items"),
        F.coalesce("matches", F.array().cast(_MATCH)).alias("matches"),
    )


def _outermost(matches: Column) -> Column:
    """Matches by place without those that lie inside another."""
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct(
        m.start.alias("start"), (-m.words).alias("less"), m.item.alias("item"), m.item_start.alias("item_start")
    )))
    named = F.transform(ordered, lambda m: F.struct(
        m.start.alias("start"), (-m.less).alias("words"), m.item.alias("item"), m.item_start.alias("item_start")
    ))

    def reaches(kept: Column, m: Column) -> Column:
        last = F.element_at(kept, -1)
        inside = (F.size(kept) > 0) & (m.start + m.words <= last.start + last.words)
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(m)))

    return F.aggregate(named.cast(_MATCH), F.array().cast(_MATCH), reaches)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a window of a test, columns unchanged."""
    return find_matches(docs, benchmark, window).where("n_hit = 0").select("row.*")


def op2_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the tests of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    ids = F.concat_ws(",", "items")
    return find_matches(docs, benchmark).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_max(F.transform("matches", lambda m: m.words)).cast("long").alias("longest_match"),
    )


OP2_SQL = """
WITH t AS (
  SELECT row_number() OVER () AS t, coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), tw AS (
  SELECT t, item_id, least(10, len(w)) AS k, j AS i, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT t, item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM t WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), sizes AS (SELECT DISTINCT k FROM tw),
dw AS (
  SELECT r, k, j, array_to_string(w[j:j + k - 1], ' ') AS win
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS j FROM d, sizes)
), met AS (
  SELECT dw.r, dw.j, dw.k, tw.item_id, tw.t, tw.i FROM dw JOIN tw ON dw.win = tw.win AND dw.k = tw.k
), m AS (SELECT DISTINCT r, j, k, item_id FROM met
), hit AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(j, j + k)) AS p FROM m) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r
), runs AS (
  SELECT r, max(n + k - 1) AS longest_match FROM (
    SELECT r, t, k, j - i, g, count(*) AS n FROM (
      SELECT r, t, i, j, k, j - row_number() OVER (PARTITION BY r, t, j - i ORDER BY j) AS g FROM met
    ) GROUP BY ALL
  ) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, longest_match
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN runs USING (r)
"""
