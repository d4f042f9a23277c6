"""Fill-in-the-middle: a text is cut at two places, and its parts change their order.

The two cuts are counted in units (code points, words or lines), the parts are taken by code points.  A
Fenwick tree over fixed blocks of a text's bytes stores how many units and how many code points begin in
each block; a descent by halving steps finds the block that holds the beginning of unit k together with
the code points before that block, and only this block is looked through for the place itself.

A long text costs one tree of a hundredth of its size; nothing is shuffled, and a row is all that a task needs.

Defined results: null and empty texts stay as they are (form ``plain``, output empty); a text that holds
one of the marks stays plain, whatever its hash; a null id is hashed as an empty one; very long texts are
cut like any other, whole; equal ids give equal draws, so repeated rows and ties give equal rows; an empty
table gives an empty result; extra columns are carried along, except that columns of the result's names
are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revlume.llm.cluster import ship
from revlume.llm.words import NOT_SPACE, text_bytes

BLOCK_BYTES = 256
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("code_point", "word", "line")
#: Of 100 texts, so many stay plain, and so many of the others begin with the suffix.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20


def unit_starts(data: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes of a text begin a unit; blanks before the first word belong to it."""
    if unit == "code_point":
        return (data & 0xC0) != 0x80
    starts = np.zeros(len(data), bool)
    if unit == "line":
        starts[1:] = data[:-1] == 0x0A
        starts[:1] = True
        return starts
    member = NOT_SPACE[data]
    starts[1:] = member[1:] & ~member[:-1]
    starts[:1] = member[:1]
    first = int(np.argmax(starts)) if starts.any() else -1
    if first > 0:
        starts[first], starts[0] = False, True
    return starts


class BlockTree:
    """Counts of units and code points over blocks of one text, with sums of all blocks before one."""

    def __init__(self, data: np.ndarray, unit: str, block: int = BLOCK_BYTES):
        self.unit = unit_starts(data, unit)
        self.point = (data & 0xC0) != 0x80
        self.block = block
        firsts = np.arange(0, len(data), block)
        counts = np.zeros((len(firsts) + 1, 2), np.int64)
        if len(firsts):
            counts[1:, 0] = np.add.reduceat(self.unit, firsts, dtype=np.int64)
            counts[1:, 1] = np.add.reduceat(self.point, firsts, dtype=np.int64)
        self.total = counts.sum(axis=0)
        # Node i holds the blocks (i - lowbit(i), i]; a node adds itself to its parent, narrow nodes first.
        size, step = len(counts), 1
        while step < size:
            children = np.arange(step, size, 2 * step)
            children = children[children + step < size]
            counts[children + step] += counts[children]
            step *= 2
        self.tree = counts

    def code_points_before(self, unit: int) -> int:
        """Code points before unit number ``unit``, counted from 0; all of them beyond the last unit."""
        if unit >= self.total[0]:
            return int(self.total[1])
        at, units, points = 0, 0, 0
        step = 1 << (len(self.tree).bit_length() - 1)
        while step:
            below = at + step
            if below < len(self.tree) and units + self.tree[below, 0] <= unit:
                at, units, points = below, units + int(self.tree[below, 0]), points + int(self.tree[below, 1])
            step >>= 1
        low = at * self.block
        begins = np.flatnonzero(self.unit[low : low + self.block])
        return points + int(np.count_nonzero(self.point[low : low + int(begins[unit - units])]))


def _cuts(unit: str):
    kind = "struct<units: long, chars: long, first: long, second: long>"

    @F.arrow_udf(kind)
    def run(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        data, offsets = text_bytes(text)
        draws = zip(a.to_pylist(), b.to_pylist(), strict=True)
        found = np.zeros((len(offsets) - 1, 4), np.int64)
        for i, (x, y) in enumerate(draws):
            tree = BlockTree(data[offsets[i] : offsets[i + 1]], unit)
            units = int(tree.total[0])
            low, high = sorted((x % (units + 1), y % (units + 1)))
            found[i] = units, tree.total[1], tree.code_points_before(low), tree.code_points_before(high)
        names = ("units", "chars", "first", "second")
        return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(4)], list(names))

    return run


def _draw(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the id's digest, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    firsts = [m[:1] for m in marks]
    if len(set(marks)) < 3 or "" in firsts or any(f in m[1:] for f in firsts for m in marks):
        raise ValueError("marks must differ, and their first characters must occur nowhere else in them")
    return marks


def fill_in_middle(
    docs: DataFrame, unit: str = "code_point", marks: tuple[str, str, str] = MARKS, seed: int = 1,
    plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """``docs`` with ``output``, ``form``, ``n_units``, ``n``, ``prefix_chars`` and ``middle_chars``.

    ``form`` is ``plain`` (the text), ``psm`` (prefix, suffix, middle, each after its mark) or ``spm`` (suffix
    first).  Lengths are in code points, and null in plain rows.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    prefix_mark, suffix_mark, middle_mark = map(F.lit, _checked(marks))
    ship(docs.sparkSession)
    added = ["output", "form", "n_units", "n", "prefix_chars", "middle_chars"]
    kept = [c for c in docs.columns if c.lower() not in added]
    whole = F.struct(*[docs[c] for c in kept]).alias("row") if kept else F.lit(None).alias("row")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")
    draws = [_draw(F.col("doc_id"), seed, k).alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(whole, text, *draws)
    rows = rows.withColumn("cut", _cuts(unit)("t", "h1", "h2"))
    t, cut = F.col("t"), F.col("cut")
    marked = t.contains(prefix_mark) | t.contains(suffix_mark) | t.contains(middle_mark)
    plain = (t == "") | marked | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first_percent, "spm").otherwise("psm")
    rows = rows.select("row", "t", "cut", form.alias("form"))
    first, second = cut["first"].cast("int"), cut["second"].cast("int")
    prefix, middle = F.substring(t, F.lit(1), first), F.substring(t, first + 1, second - first)
    suffix = F.substring(t, second + 1, cut["chars"].cast("int"))
    output = (
        F.when(F.col("form") == "plain", t)
        .when(F.col("form") == "psm", F.concat(prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle))
        .otherwise(F.concat(suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle))
    )
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in kept], output.alias("output"), "form",
        cut["units"].alias("n_units"), cut["chars"].alias("n"),
        cut_only(cut["first"]).alias("prefix_chars"), cut_only(cut["second"] - cut["first"]).alias("middle_chars"),
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from its transformed form: parts are found by the marks alone."""
    prefix_mark, suffix_mark, middle_mark = _checked(marks)

    def after(column: Column, part: Column, mark: str) -> Column:
        return F.substring(column, F.length(part) + (len(mark) + 1), F.length(column))

    def parts(opening: str, dividing: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(opening) + 1), F.length(output))
        one = F.substring_index(body, dividing, 1)
        rest = after(body, one, dividing)
        two = F.substring_index(rest, middle_mark, 1)
        return one, two, after(rest, two, middle_mark)

    prefix, suffix, middle = parts(prefix_mark, suffix_mark)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(suffix_mark, prefix_mark)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of every document's transformed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = fill_in_middle(docs)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), drawn AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4
  FROM hashed
), formed AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substring(t, 1, p) AS a, substring(t, p + 1, q - p) AS b, substring(t, q + 1, n) AS c FROM formed
), moved AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
    ELSE '<S>' || c || '<P>' || a || '<M>' || b END AS output
  FROM parts
), opened AS (
  SELECT *, strpos(output, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS x FROM moved
), divided AS (
  SELECT *, substring(output, 4, x - 4) AS one, substring(output, x + 3) AS rest FROM opened
), ended AS (
  SELECT *, strpos(rest, '<M>') AS y FROM divided
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN q - p END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN one || substring(rest, y + 3) || substring(rest, 1, y - 1)
    ELSE substring(rest, 1, y - 1) || substring(rest, y + 3) || one END) AS restored_sha256
FROM ended
"""
