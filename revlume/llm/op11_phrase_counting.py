"""Phrase collocations by dynamic itemset counting.

The corpus lies in a few shards that are scanned again and again in a circle.  All words are counted from
the first scan on.  As soon as both parts of a longer phrase (all but its last word, all but its first)
have reached the threshold in the scans so far, the phrase is counted too, beginning with the next shard,
beside everything else that is being counted; a phrase is done once it has been counted over one full
circle.  Lengths are thus interleaved, and the scans end when no phrase is open.

What the scans know of the phrases that reached the threshold is a fixed array: one byte per slot of a
hash, the scan from which on longer phrases may build on it.  A slot that two phrases share only opens a
phrase too early, and a phrase's first scan follows from the array alone, so every task counts the same
phrases.  The array's size is a parameter and does not grow with the corpus; where it fills up, more
phrases are counted, and the result is the same.  Counts travel as (number, first scan, count) rows,
summed within a task before they are shuffled.  With them go a check of the phrase's words, summed too, and
one of the blocks of texts in which the phrase lies.  At the end each number that passed is looked up in
its block alone, which gives its words: one row a phrase, whatever the number of tasks.  Two phrases
with the same number (60 bits) are counted as one and may pass together; then the sum of checks is not
the count times the check of the words found, and one more scan gives the phrases of such numbers by their
words and separates them; only what reaches the threshold by itself is kept.

Defined results: null texts are empty and give nothing; texts without words give nothing; null languages
count as ``und``; a very long text is gone through whole; repeated rows count as often as they stand there;
scores are whole numbers of any size below 10^37, ties go by count, then by the phrase's bytes; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from revlume.llm.cluster import ship
from revlume.llm.words import LOWER, NOT_SPACE, find_words, mix, pieces, text_bytes, word_prints
from revlume.session import scratch_path, staged

MAX_WORDS, LEAST, TOP = 5, 100, 2000
SHARDS = 3
#: Slots of the array of phrases that reached the threshold (a prime, so that numbers spread).
SLOTS = 16_777_213
BATCH_BYTES = 8 << 20
#: Parts of a language that are ranked by themselves first.
PARTS = 64
#: Phrases that a task holds by their words before it gives them out.
HELD_ROWS = 1 << 20
#: Bits of a phrase's number; three more hold its length.
BITS = 60
#: Bits of the check of a phrase's words; its sum over 2 ** 39 occurrences still is a long.
CHECK_BITS = 24
#: Bits of the number of a block of texts.
BLOCK_BITS = 31
#: Bits of the filter by which a block's words are searched for many numbers.
FILTER_BITS = 22
_NEVER = 255
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Fixed value: bytes of a bitmap of Spark's bitmap functions.
_BITMAP = 4096
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_INSIDE = ~(_BLANK | _BREAK)


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts in lower case with one blank between words and one line end between pieces, and their words."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = find_words(data, offsets, _INSIDE)
    # Of what follows a word one byte is kept: a line end if a break lies before the next word, else a blank.
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    after = np.full(len(starts), 0x20, np.uint8)
    after[:-1][breaks[starts[1:]] > breaks[ends[:-1]]] = 0x0A
    keep = _INSIDE[data]
    inner = np.ones(len(data) + 1, bool)
    inner[offsets] = False
    followed = ends[inner[ends]]
    data[followed] = after[inner[ends]]
    keep[followed] = True
    begins = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int64)
    buffers = [None, pa.py_buffer(begins.tobytes()), pa.py_buffer(data[keep].tobytes())]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers), np.diff(first)


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for i, batch in enumerate(pieces(batches, "text", BATCH_BYTES)):
        body, n = _flat(batch.column("text"))
        # Texts that come together are a block; two blocks of one number only make one larger block.
        block = int(mix(np.array([task << 32 | i], np.uint64))[0] >> np.uint64(64 - BLOCK_BITS))
        blocks = pa.array(np.full(len(n), block, np.int32))
        columns = [batch.column("lang"), batch.column("shard"), body.cast(pa.string()), pa.array(n.astype(np.int64)), blocks]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "shard", "body", "n_words", "block"])


def flattened(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``lang``, ``body``, ``n_words``, ``block`` in folders by ``shard``; texts without words are left out."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    shard = F.pmod(F.xxhash64("lang", text), F.lit(shards)).cast("int").alias("shard")
    flat = docs.select(lang, shard, text.alias("text")).mapInArrow(
        _flatten, "lang string, shard int, body string, n_words long, block int"
    )
    path = scratch_path(docs.sparkSession, "op11-flat")
    flat.where("n_words > 0").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema("lang string, body string, n_words long, block int, shard int").parquet(path)


class _Words:
    """Words of a batch of flat texts: prints, piece numbers and places."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column("body"))
        self.data = data
        self.starts, self.ends, first = find_words(data, offsets, NOT_SPACE)
        self.prints = word_prints(data, self.starts, self.ends)
        opens = data[np.maximum(self.starts - 1, 0)] == 0x0A
        opens[first[:-1][first[:-1] < len(opens)]] = True
        self.piece = np.cumsum(opens)
        self.first = first
        langs = batch.column("lang").dictionary_encode()
        names = langs.dictionary
        self.langs = names.to_pylist()
        self.lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(first))
        data, offsets = text_bytes(names)
        whole = np.arange(len(names))
        marks = word_prints(np.concatenate([data, [0]]).astype(np.uint8), offsets[whole], offsets[whole + 1])
        self.mark = marks[self.lang] if len(self.lang) else np.zeros(0, np.uint64)

    def prints_at(self, at: np.ndarray, length: int) -> np.ndarray:
        """Print of the phrase of so many words that begins at each of the places."""
        out = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                out = (out + self.prints[at + k]) * _STEP
                out ^= out >> np.uint64(29)
            return mix(out + self.mark[at])

    def checks(self, lengths: int) -> Iterator[np.ndarray]:
        """For each length from 1 on the checks of the phrases of so many words, by the places where they begin."""
        second = mix(self.prints ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        held = np.zeros(len(second), np.uint64)
        for length in range(1, lengths + 1):
            with np.errstate(over="ignore"):
                held = held[: max(len(second) - length + 1, 0)] * _STEP + second[length - 1 :]
            yield (held >> np.uint64(64 - CHECK_BITS)).astype(np.int64)

    def within(self, length: int) -> np.ndarray:
        """Places of all phrases of so many words in one piece."""
        n = max(len(self.prints) - length + 1, 0)
        return np.flatnonzero(self.piece[:n] == self.piece[length - 1 : length - 1 + n])

    def longer(self, parts: np.ndarray, length: int) -> np.ndarray:
        """Places of phrases of so many words in one piece whose two parts, one word shorter, are both known."""
        n = max(len(self.prints) - length + 1, 0)
        known = (parts[:n] != _NEVER) & (parts[1 : n + 1] != _NEVER)
        return np.flatnonzero(known & (self.piece[:n] == self.piece[length - 1 : length - 1 + n]))


def _sent(spark: SparkSession, array: np.ndarray) -> Broadcast:
    """An array of fixed size for all tasks; compressed, as most of it is empty for long."""
    return spark.sparkContext.broadcast(zlib.compress(array.tobytes(), 1))


def _array(sent: Broadcast) -> np.ndarray:
    return np.frombuffer(zlib.decompress(sent.value), np.uint8)


def _numbers(prints: np.ndarray, length: int, bits: int = BITS) -> np.ndarray:
    return ((prints >> np.uint64(64 - bits)) << np.uint64(3)) | np.uint64(length)


def _turned(block: str) -> Column:
    """The number of a block turned by that of the phrase, and back: each phrase has a least block of its own."""
    turn = F.xxhash64("number").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    return F.col(block).bitwiseXOR(turn)


def _count(opened: Broadcast, scan: int, shards: int, lengths: list[int], bits: int = BITS):
    """Rows (number, first scan, count, sum of checks, a block) of the phrases that are open in this scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _array(opened)
        for batch in pieces(batches, "body", BATCH_BYTES):
            words = _Words(batch)
            block = np.repeat(batch.column("block").to_numpy(zero_copy_only=False), np.diff(words.first))
            checks = words.checks(max(lengths))
            # parts[i]: the scan from which on longer phrases may build on the phrase that begins at word i.
            parts = np.zeros(0, np.uint8)
            for length in range(1, max(lengths) + 1):
                at = words.longer(parts, length) if length > 1 else np.arange(len(words.prints))
                since = np.maximum(parts[at], parts[at + 1]) if length > 1 else np.zeros(len(at), np.uint8)
                numbers = _numbers(words.prints_at(at, length), length, bits)
                check = next(checks)
                if length in lengths:
                    active = np.flatnonzero((since <= scan) & (since.astype(np.int64) + shards > scan))
                    # Phrases that share a number may be open from different scans on and are counted apart.
                    open_since = since[active]
                    order = np.argsort(numbers[active], kind="stable")
                    if len(np.unique(open_since)) > 1:
                        order = order[np.argsort(open_since[order], kind="stable")]
                    active, open_since = active[order], open_since[order]
                    found = numbers[active]
                    new = np.ones(len(found), bool)
                    new[1:] = (found[1:] != found[:-1]) | (open_since[1:] != open_since[:-1])
                    heads = np.flatnonzero(new)
                    n = np.diff(np.append(heads, len(found)))
                    sums = np.add.reduceat(check[at[active]], heads) if len(heads) else np.zeros(0, np.int64)
                    found = found[heads]
                    columns = [
                        pa.array(found.astype(np.int64)), pa.array(open_since[heads].astype(np.int16)), pa.array(n.astype(np.int64)),
                        pa.array(sums), pa.array(block[at[active[heads]]]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["number", "since", "n", "check", "block"])
                if length < max(lengths):
                    # A slot may be older than the phrase itself, which counts from its own first scan.
                    parts = np.full(len(words.prints), _NEVER, np.uint8)
                    parts[at] = np.maximum(slots[numbers % np.uint64(len(slots))], since)

    return run


def _looked_up(lengths: int, bits: int):
    """The words of the numbers that are to be found in a block of texts, and whether all their occurrences are of these words."""

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        numbers = wanted.column("number").to_numpy().astype(np.uint64)
        order = np.argsort(numbers)
        numbers = numbers[order]
        n, sums = (wanted.column(c).to_numpy()[order] for c in ("n", "check"))
        missing, out = np.ones(len(numbers), bool), []
        may = np.zeros(1 << FILTER_BITS, bool)
        low = lambda x: (x ^ (x >> np.uint64(FILTER_BITS))) & np.uint64((1 << FILTER_BITS) - 1)
        may[low(numbers)] = True
        for batch in pieces(iter(texts.to_batches()), "body", BATCH_BYTES):
            if not missing.any():
                break
            words = _Words(batch)
            checks = words.checks(lengths)
            for length in range(1, lengths + 1):
                check, at = next(checks), words.within(length)
                own = _numbers(words.prints_at(at, length), length, bits)
                some = np.flatnonzero(may[low(own)])
                own, at = own[some], at[some]
                index = np.minimum(np.searchsorted(numbers, own), max(len(numbers) - 1, 0))
                hit = (numbers[index] == own) & missing[index]
                index, first = np.unique(index[hit], return_index=True)
                at = at[hit][first]
                missing[index] = False
                begin, end = words.starts[at], words.ends[at + length - 1]
                sure = pa.array(sums[index] == n[index] * check[at])
                for x, y in _portions(end - begin):
                    rows = _phrase_rows(words, begin[x:y], end[x:y], at[x:y], n[index[x:y]], length)
                    out.append(rows.append_column("number", pa.array(numbers[index[x:y]].astype(np.int64))).append_column("sure", sure[x:y]))
        lost = pa.array(numbers[missing].astype(np.int64))
        nothing = [pa.nulls(len(lost), kind) for kind in (pa.string(), pa.string(), pa.int32(), pa.int64())]
        names = ["lang", "phrase", "words", "n", "number", "sure"]
        out.append(pa.RecordBatch.from_arrays([*nothing, lost, pa.array(np.zeros(len(lost), bool))], names))
        return pa.Table.from_batches(out)

    return run


def _named(doubtful: Broadcast, slots: int, lengths: int, bits: int):
    """The phrases whose number is doubtful, by their words, with their counts in this task."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = _array(doubtful)
        for batch in pieces(batches, "body", BATCH_BYTES):
            words = _Words(batch)
            second = mix(words.prints ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            for length in range(1, lengths + 1):
                at = words.within(length)
                one = words.prints_at(at, length)
                slot = _numbers(one, length, bits) % np.uint64(slots)
                known = (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                at, one = at[known], one[known]
                two = np.zeros(len(at), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(length):
                        two = mix(two * _STEP + second[at + k])
                order = np.lexsort((two, one))
                one, two, at = one[order], two[order], at[order]
                new = np.ones(len(at), bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                heads = np.flatnonzero(new)
                n = np.diff(np.append(heads, len(at)))
                number = pa.array(_numbers(one[heads], length, bits).astype(np.int64))
                at = at[heads]
                low, high = words.starts[at], words.ends[at + length - 1]
                for a, b in _portions(high - low):
                    rows = _phrase_rows(words, low[a:b], high[a:b], at[a:b], n[a:b], length)
                    yield rows.append_column("number", number[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _combined(found(batches))

    return run


def _combined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with equal phrases of a task summed, as far as ``HELD_ROWS`` of them fit."""
    held, size = [], 0

    def summed() -> pa.Table:
        table = pa.Table.from_batches(held).group_by(["lang", "phrase", "words", "number"]).aggregate([("n", "sum")])
        return table.rename_columns(["lang", "phrase", "words", "number", "n"])

    for batch in rows:
        held.append(batch)
        size += batch.num_rows
        if size >= HELD_ROWS:
            table = summed()
            if table.num_rows > HELD_ROWS // 2:
                yield from table.to_batches()
                held, size = [], 0
            else:
                held, size = table.to_batches(), table.num_rows
    if held:
        yield from summed().to_batches()


def _portions(sizes: np.ndarray, most: int = 32 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together."""
    if not len(sizes):
        return
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _phrase_rows(words: _Words, low, high, at, n, length: int) -> pa.RecordBatch:
    begins = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int64)
    places = np.repeat(low - begins[:-1], high - low) + np.arange(int(begins[-1]))
    buffers = [None, pa.py_buffer(begins.tobytes()), pa.py_buffer(words.data[places].tobytes())]
    phrase = pa.Array.from_buffers(pa.large_string(), len(at), buffers).cast(pa.string())
    lang = pa.array(words.langs, pa.string()).take(pa.array(words.lang[at]))
    columns = [lang, phrase, pa.array(np.full(len(at), length, np.int32)), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "n"])


def _slots_of(numbers: DataFrame, slots: int) -> list:
    """Rows (length, bucket, bitmap) of the slots that the numbers fall into: at most slots / 8 bytes a length."""
    place = F.pmod(F.col("number"), F.lit(slots)) + 1
    rows = numbers.select((F.col("number") % 8).cast("int").alias("length"), place.alias("place"))
    keys = ("length", F.expr("bitmap_bucket_number(place)").alias("bucket"))
    return rows.groupBy(*keys).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits")).collect()


def _open(array: np.ndarray, found: list, value: int) -> set[int]:
    """Put ``value`` on the slots found that were free; the lengths that did so."""
    lengths = set()
    for row in found:
        bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
        at = (row.bucket - 1) * len(bits) + np.flatnonzero(bits)
        at = at[array[at] == _NEVER]
        array[at] = value
        if len(at):
            lengths.add(row.length)
    return lengths


def located(flat: DataFrame, passed: DataFrame, max_words: int = MAX_WORDS, bits: int = BITS) -> DataFrame:
    """One row for each ``number`` of ``passed``: its ``lang``, ``phrase``, ``words`` and ``n``, looked up in the block that
    ``passed`` names, and whether it is ``sure`` that the number has no other phrase."""
    one = passed.groupBy("number").agg(F.sum("n").alias("n"), F.sum("check").alias("check"), F.first("block").alias("block"))
    texts = flat.select("lang", "body", "block").groupBy("block")
    kinds = "lang string, phrase string, words int, n long, number long, sure boolean"
    return texts.cogroup(one.groupBy("block")).applyInArrow(_looked_up(max_words, bits), kinds)


def phrase_counts(
    flat: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, shards: int = SHARDS, slots: int = SLOTS,
    seen: list | None = None, bits: int = BITS,
) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``n`` of all phrases of 1 to ``max_words`` words that occur ``least`` times.

    ``flat`` comes from ``flattened`` with the same number of shards.  ``seen``, if given, gets one
    (scan, shard, lengths being counted, lengths that newly reached the threshold) for each scan.
    """
    if not 1 <= max_words <= 7 or not 1 <= shards * max_words < _NEVER:
        raise ValueError("max_words must be 1 to 7, and shards times max_words below 255")
    spark = flat.sparkSession
    ship(spark)
    opened = np.full(slots, _NEVER, np.uint8)
    passed = []
    # A slot set in one scan may open phrases of any length, as slots are shared; they are done a circle later.
    state, scan, until = None, 0, shards
    while scan < until:
        lengths = [k for k in range(1, max_words + 1) if (k > 1 and scan) or (k == 1 and scan < shards)]
        held = _sent(spark, opened)
        rows = flat.where(F.col("shard") == scan % shards).select("lang", "body", "block")
        kinds = "number long, since short, n long, check long, block int"
        rows = rows.mapInArrow(_count(held, scan, shards, lengths, bits), kinds)
        rows = rows.select("number", "since", "n", "check", _turned("block").alias("place"))
        if state is not None:
            rows = rows.unionByName(state)
        # Only what is still open, or has just been done with success, goes on.
        done = F.col("since") + shards <= scan + 1
        counts = rows.groupBy("number", "since").agg(
            F.sum("n").alias("n"), F.sum("check").alias("check"), F.min("place").alias("place")
        )
        counts = counts.where(~done | (F.col("n") >= least))
        counts = staged(counts, f"op11-scan{scan}")
        held.destroy()
        reached = counts.where(F.col("n") >= least)
        grown = _open(opened, _slots_of(reached.where(F.col("number") % 8 < max_words), slots), scan + 1)
        passed.append(reached.where(done))
        if seen is not None:
            counted = counts.groupBy(F.col("number") % 8).count().collect()
            seen.append((scan, scan % shards, sorted(r[0] for r in counted), sorted(grown)))
        if grown:
            until = scan + 1 + shards
        state = counts.where(~done)
        scan += 1
    found = reduce(DataFrame.unionByName, passed).select("number", "n", "check", _turned("place").alias("block"))
    found = staged(located(flat, found, max_words, bits), "op11-phrases")
    doubtful = found.where(~F.col("sure")).select("number")
    named = found.where("sure").select("lang", "phrase", "words", "n")
    if doubtful.isEmpty():
        return named
    # One bit says that a number is doubtful: eight times the slots in the same space.
    bitmap, fine = np.zeros(slots + _BITMAP, np.uint8), 8 * slots - 1
    for row in _slots_of(doubtful, fine):
        low = (row.bucket - 1) * _BITMAP
        bitmap[low : low + _BITMAP] |= np.frombuffer(row.bits, np.uint8)
    held = _sent(spark, bitmap)
    kinds = "lang string, phrase string, words int, number long, n long"
    apart = flat.select("lang", "body").mapInArrow(_named(held, fine, max_words, bits), kinds)
    apart = apart.groupBy("lang", "phrase", "words", "number").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    apart = staged(apart.join(doubtful, "number", "left_semi").select("lang", "phrase", "words", "n"), "op11-apart")
    held.destroy()
    return named.unionByName(apart)


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, inside_percent: int = 100,
    shards: int = SHARDS, slots: int = SLOTS,
) -> DataFrame:
    """The ``top`` phrases of each language whose parts predict each other best.

    A phrase of a occurrences is cut at every place; ``score`` is the least floor(1000 a n / (l r)), with l and r
    the occurrences of both parts and n all words of the language.  A phrase inside a longer one with at least
    ``inside_percent`` of its occurrences is left out.
    """
    ship(docs.sparkSession)
    flat = flattened(docs, shards)
    counts = phrase_counts(flat, max_words, least, shards, slots)
    totals = flat.groupBy("lang").agg(F.sum("n_words").alias("total"))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    join_words = lambda c: F.array_join(c, " ")

    longer = counts.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = longer.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "words", "a", "k", join_words(F.slice("w", F.lit(1), F.col("k"))).alias("left"),
        join_words(F.slice("w", F.col("k") + 1, F.col("words"))).alias("right"),
    )
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    cuts = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(totals, "lang")
    # Whole numbers throughout: a quotient of decimals would be rounded.
    above, below = F.lit(1000).cast("decimal(38,0)") * exact("a") * exact("total"), exact("l") * exact("r")
    cuts = cuts.withColumn("above", above).withColumn("below", below).withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct("score", "k", "l", "r", F.col("total").alias("n"))).alias("best")
    )
    # The most frequent longer candidate around each phrase.
    inner = longer.where("words >= 3").select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("at"))
    inner = inner.select("lang", "a", join_words(F.slice("w", F.col("at"), F.col("m"))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = best.join(inner, ["lang", "phrase"], "left")
    covered = F.lit(100) * exact("around") >= F.lit(inside_percent) * exact("a")
    kept = kept.where(~F.coalesce(covered, F.lit(False)))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")
    # A language may hold most candidates: the first of each of its parts, then the first of those.
    order = (F.desc("score"), F.desc("a"), "phrase")
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    parts = Window.partitionBy("lang", "part").orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return collocations(docs)


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split WHERE len(w) > 0
), sized AS (
  SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM placed
), counts AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM sized GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m >= 2 AND f >= 100
), cut AS (
  SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
    (1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut c
  JOIN counts x ON x.lang = c.lang AND x.m = c.k AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.m = c.m - c.k AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')
  JOIN totals t ON t.lang = c.lang
), least_cut AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, m, a, w, unnest(range(2, m)) AS s FROM candidates WHERE m >= 3
), inside AS (
  SELECT lang, a, s, w, unnest(range(1, m - s + 2)) AS i FROM parts
), around AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS b FROM inside GROUP BY ALL
), kept AS (
  SELECT q.* FROM least_cut q LEFT JOIN around o ON o.lang = q.lang AND o.phrase = q.phrase
  WHERE o.b IS NULL OR 100 * o.b < 100 * q.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
