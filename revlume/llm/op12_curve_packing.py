"""Packing documents into training sequences along a space-filling curve.

Each document becomes a hashed vector of its tokens (a sign per token and dimension, weighted by the
logarithm of its count), already summed in a few dimensions; these are quantised around their mean and put in the
order of the Hilbert curve, so documents with like vocabulary stand together.  The documents are sorted by that
key and their tokens are cut into sequences of ``length`` along the curve, so a sequence holds
neighbours; a document that does not fit goes on in the next sequence.  What is left at the end is cut
into powers of two, so that no sequence needs padding.

Texts are read and tokenised once, into a written table.  Only narrow rows (key, id, number of tokens) are
sorted by range; running sums inside the ranges and the sums of all ranges before give every document its
place, and the token ids meet their places in one shuffle on a row number.  Equal documents share a key
but not the hash that breaks its ties, so a text that is a third of all rows is cut into many ranges.

The ids are those of the `tokenizers` file.  Where its merges stand in the order of their ids, a faster encoder does
the same merges for ordinary texts (see `_Encoder`).

Defined results: a null or empty text is the closing id alone; very long texts are tokenised whole; ties on the curve go by a hash of id and tokens, then by id; repeated rows and
null ids are packed like all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from revlume.llm.cluster import ship
from revlume.llm.op8_hilbert_shards import hilbert_index
from revlume.llm.words import mix, pieces, text_bytes
from revlume.session import scratch_path, staged

LENGTH, CLOSING = 1024, 0
#: Dimensions and bits of each; their product stays below 63.
DIMENSIONS, BITS = 4, 8
BATCH_BYTES = 8 << 20
_UNIT = 1 << 16

#: Runs of characters above this length merge too slowly in the fast encoder.
_LONG_RUN = 1000


class _Encoder:
    """A tokenizer in a worker.

    Byte tokenizers whose merges stand in the order of their ids are also made as an encoder that merges by id, which is
    several times faster.  It takes texts of Latin letters and common marks without very long runs, where both
    follow the same pattern to the letter; all other texts, and all other tokenizers, take the tokenizer itself.
    """

    def __init__(self, told: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(told)
        # A special token's name in a text is ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.fast = _by_rank(json.loads(told))

    def ids(self, text: pa.Array, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        texts = text.to_pylist()
        quick = _ordinary(data, offsets) if self.fast else np.zeros(len(texts), bool)
        out: list = [self.fast.encode_to_numpy(t, disallowed_special=()) if q else None for t, q in zip(texts, quick, strict=True)]
        rest = np.flatnonzero(~quick).tolist()
        for a in range(0, len(rest), 16):
            some = rest[a : a + 16]
            for i, found in zip(some, self.tokenizer.encode_batch_fast([texts[i] or "" for i in some], add_special_tokens=False), strict=True):
                out[i] = np.array(found.ids, np.uint32)
        return out


def _by_rank(rules: dict):
    """An encoder by ranks for the rules of a byte tokenizer, if it has the same ids."""
    first, model = rules.get("pre_tokenizer") or {}, rules.get("model") or {}
    bytewise = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    if not (bytewise and plain and model.get("type") == "BPE" and not rules.get("normalizer")):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if made != sorted(set(made)):
        return None
    # The characters that stand for bytes: printable ones for themselves, the others from 256 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if i in set(made) or len(t) == 1}
    singles = [i for t, i in model["vocab"].items() if len(t) == 1]
    if len(singles) != 256 or (made and max(singles) > made[0]):
        return None
    import tiktoken

    return tiktoken.Encoding("by-rank", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ordinary(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts of characters below U+0280 and of U+2000 to U+207F only, without a very long run."""
    n = len(data)
    odd = data >= 0xCA
    marks = data == 0xE2
    follow = np.zeros(n, np.uint8)
    follow[:-1] = data[1:]
    odd &= ~(marks & ((follow == 0x80) | (follow == 0x81)))
    blank = data <= 0x20
    turns = np.ones(n, bool)
    turns[1:] = blank[1:] != blank[:-1]
    turns[offsets[:-1][offsets[:-1] < n]] = True
    at = np.flatnonzero(turns)
    odd[at[np.diff(np.append(at, n)) > _LONG_RUN]] = True
    seen = np.concatenate([[0], np.cumsum(odd)])
    return seen[offsets[1:]] == seen[offsets[:-1]]


_made: dict[int, _Encoder] = {}


def token_ids(text: pa.Array, told: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts end to end, and where each text's ids begin (one more entry)."""
    key = hash(told)
    if key not in _made:
        _made.clear()
        _made[key] = _Encoder(told)
    text = text.fill_null("")
    found = _made[key].ids(text, *text_bytes(text))
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.uint32), first


def _closed(ids: np.ndarray, first: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with the closing id after each."""
    bounds = first + np.arange(len(first))
    out = np.full(len(ids) + len(first) - 1, closing, np.uint32)
    own = np.ones(len(out), bool)
    own[bounds[1:] - 1] = False
    out[own] = ids
    return out, bounds


def projections(ids: np.ndarray, bounds: np.ndarray, dimensions: int) -> np.ndarray:
    """Hashed vector of each text in a few dimensions, as whole numbers of 2^-16."""
    texts = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    pairs, n = np.unique((texts << np.uint64(32)) | ids, return_counts=True)
    text, token = (pairs >> np.uint64(32)).astype(np.int64), pairs & np.uint64(0xFFFFFFFF)
    weight = np.floor(256 * (1 + np.log2(n)))
    norm = np.sqrt(np.bincount(text, weight * weight, len(bounds) - 1))
    out = np.empty((len(bounds) - 1, dimensions), np.int64)
    with np.errstate(over="ignore"):
        signs = mix(token * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    for d in range(dimensions):
        sign = 1.0 - 2.0 * ((signs >> np.uint64(d)) & np.uint64(1)).astype(np.float64)
        out[:, d] = np.rint(np.bincount(text, sign * weight, len(bounds) - 1) / np.maximum(norm, 1) * _UNIT)
    return out


def _tokenised(held: Broadcast, closing: int, dimensions: int, wide: bool):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            ids, first = token_ids(batch.column("text"), held.value)
            ids, bounds = _closed(ids, first, closing)
            buffers = [None, pa.py_buffer((bounds * kind.itemsize).astype(np.int64).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())]
            packed = pa.Array.from_buffers(pa.large_binary(), len(batch), buffers).cast(pa.binary())
            vectors = projections(ids, bounds, dimensions)
            columns = [batch.column("doc_id"), packed, pa.array(np.diff(bounds)), *[pa.array(vectors[:, d]) for d in range(dimensions)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "doc_tokens", *[f"z{d}" for d in range(dimensions)]])

    return run


def _curve(bits: int):
    @F.arrow_udf("long")
    def run(*cells: pa.Array) -> pa.Array:
        return pa.array(hilbert_index(np.stack([c.to_numpy(zero_copy_only=False) for c in cells], axis=1), bits))

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each row of a sorted range."""
    before = 0
    for batch in batches:
        sums = before + np.cumsum(batch.column("doc_tokens").to_numpy(zero_copy_only=False))
        own = sums - batch.column("doc_tokens").to_numpy(zero_copy_only=False)
        before = int(sums[-1]) if len(sums) else before
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), batch.column("doc_tokens"), pa.array(own)], ["row", "part", "doc_tokens", "inside"])


class Sequences:
    """Where the sequences of a run of ``total`` tokens begin: every ``length``, the rest in powers of two."""

    def __init__(self, total: int, length: int):
        self.length, self.full = length, total // length
        at, rest, starts = self.full * length, total % length, []
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                starts.append(at)
                at += 1 << bit
        self.tail = np.array([*starts, total], np.int64)

    def number(self, place: np.ndarray) -> np.ndarray:
        """Sequence that holds each place."""
        late = self.full + np.searchsorted(self.tail, place, "right") - 1
        return np.where(place < self.full * self.length, place // self.length, late)

    def start(self, number: np.ndarray) -> np.ndarray:
        late = self.tail[np.clip(number - self.full, 0, len(self.tail) - 1)]
        return np.where(number < self.full, number * self.length, late)


def _cut(total: int, length: int, wide: bool):
    kind = np.dtype("<u4" if wide else "<u2")
    plan = Sequences(total, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids", BATCH_BYTES):
            data, _ = binary_bytes(batch.column("ids"))
            place = batch.column("place").to_numpy(zero_copy_only=False)
            size = batch.column("doc_tokens").to_numpy(zero_copy_only=False)
            first = plan.number(place)
            n = plan.number(place + size - 1) - first + 1
            doc = np.repeat(np.arange(len(place)), n)
            sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            low = np.maximum(place[doc], plan.start(sequence))
            high = np.minimum((place + size)[doc], plan.start(sequence + 1))
            # Pieces follow each other without a gap, as the documents of the batch do.
            ends = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int64) * 4
            buffers = [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.view(kind).astype("<u4").tobytes())]
            ids = pa.Array.from_buffers(pa.large_binary(), len(doc), buffers).cast(pa.binary())
            columns = [
                batch.column("doc_id").take(pa.array(doc)), pa.array(low - place[doc]), pa.array(high - low), ids,
                pa.array(size[doc]), pa.array(sequence), pa.array(low - plan.start(sequence)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def binary_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls end to end, and where each row begins."""
    whole = column.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8) if len(whole) else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data[offsets[0] : offsets[-1]]), offsets - offsets[0]


def tokenised(
    docs: DataFrame, tokenizer_path: str, closing: int = CLOSING, dimensions: int = DIMENSIONS
) -> tuple[DataFrame, bool]:
    """Written table of ``doc_id``, ``ids``, ``doc_tokens``, ``z0``.. and ``row``, and whether ids have four bytes."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        told = file.read()
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_str(told).get_vocab_size(), closing + 1) > 1 << 16
    held = spark.sparkContext.broadcast(told)
    kind = docs.select("doc_id").schema["doc_id"].dataType
    fields = [StructField("doc_id", kind), StructField("ids", BinaryType()), StructField("doc_tokens", LongType())]
    schema = StructType(fields + [StructField(f"z{d}", LongType()) for d in range(dimensions)])
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.mapInArrow(_tokenised(held, closing, dimensions, wide), schema)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    path = scratch_path(spark, "op12-tokens")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), wide


def on_curve(rows: DataFrame, dimensions: int = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve``: the Hilbert index of the vector, three deviations around the mean in each dimension."""
    whole = lambda d: F.col(f"z{d}").cast("decimal(38,0)")
    sums = [F.sum(whole(d)).alias(f"s{d}") for d in range(dimensions)]
    squares = [F.sum(whole(d) * whole(d)).alias(f"q{d}") for d in range(dimensions)]
    # Sums of whole numbers do not depend on their order, so a rerun gives the same cells.
    found = rows.agg(F.count(F.lit(1)).alias("n"), *sums, *squares).first()
    cells = []
    for d in range(dimensions):
        mean = found[f"s{d}"] / Decimal(found.n) if found.n else Decimal(0)
        variance = found[f"q{d}"] / Decimal(found.n) - mean * mean if found.n else Decimal(0)
        scale = float(1 << bits) / (6 * max(float(variance), 1.0) ** 0.5)
        cell = F.floor((F.col(f"z{d}") - F.lit(float(mean))) * F.lit(scale)) + (1 << (bits - 1))
        cells.append(F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), cell)).cast("long"))
    return rows.withColumn("curve", _curve(bits)(*cells))


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """``row`` and its ``place``, the tokens before it along the curve; and the number of all tokens."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = rows.select("curve", F.xxhash64("doc_id", "ids").alias("tie"), "doc_id", "row", "doc_tokens")
    narrow = staged(narrow, "op12-keys")
    order = ("curve", "tie", "doc_id", "row")
    ranges = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranges = ranges.select("row", F.spark_partition_id().alias("part"), "doc_tokens")
    ranges = ranges.mapInArrow(_running, "row long, part int, doc_tokens long, inside long")
    ranges = staged(ranges, "op12-ranges")
    # One row per range.
    sums = ranges.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    total = ranges.agg(F.sum("doc_tokens")).first()[0] or 0
    places = ranges.join(F.broadcast(sums), "part")
    return places.select("row", (F.col("before") + F.col("inside")).alias("place")), total


def packed(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, closing: int = CLOSING,
    dimensions: int = DIMENSIONS, bits: int = BITS,
) -> DataFrame:
    """Pieces of documents in sequences: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian numbers of four bytes.  ``start`` counts in the document, ``offset`` in the sequence.
    """
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    rows, wide = tokenised(docs, tokenizer_path, closing, dimensions)
    places, total = placed(on_curve(rows, dimensions, bits))
    both = rows.select("doc_id", "ids", "doc_tokens", "row").join(places.hint("shuffle_hash"), "row")
    fields = [
        rows.schema["doc_id"], StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType()),
        *[StructField(c, LongType()) for c in ("doc_tokens", "sequence_id", "offset")],
    ]
    return both.select("doc_id", "ids", "doc_tokens", "place").mapInArrow(_cut(total, length, wide), StructType(fields))


def sequences(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per sequence: ``sequence_id``, ``n_tokens``, ``padded``, ``ids``, ``starts`` of its pieces."""
    piece = F.struct("offset", "ids")
    whole = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    power = F.expr("n_tokens & (n_tokens - 1)") == 0
    padded = F.when(power, F.col("n_tokens")).otherwise(F.lit(length))
    return whole.select("sequence_id", "n_tokens", padded.cast("long").alias("padded"), ids.alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 1,024 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    parts = packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return parts.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
