"""Near-duplicate documents through an LSH forest.

A document is the set of its distinct five-word shingles.  Equal sets are one class from the start.
Every class gets minimum hashes; each tree of the forest is an order of the classes by its own run of
them.  In that order the classes that follow a class share the longest prefixes with it: they are its
candidates, nearest first.  Depth adapts to the region: where few classes share a first hash all of
them are candidates, in a crowded region only those that agree further down.  A class stops looking in
a tree once it has met ``ENOUGH`` classes that look like clear links, so a crowd
of near copies gives each member a few candidates and never all pairs.

That pass only comes first.  What it left out is made up at the end: all classes that share a first hash
in a tree meet in tiles of bounded size, unless they are in one component by then.  Classes of a region's
largest component never meet each other there, so a crowd with few outliers takes one row a class.  So neither
the reach nor the borders of partitions decide on a link; a pair is missed only where it shares none of the
``TREES`` first hashes or its sketches are unlike (``LEAST_EQUAL``).

Candidates whose signatures are far apart are left out, the rest are confirmed on whole sets: those of the
first pass pair by pair, those of the last inside their tile, which gives out no more links than join its
components.  So a tile takes and gives rows in proportion to its classes, however many pairs it holds.  The
components of the links are found by hooking and pointer jumping.  Every stage that is used twice is a written
table.

Defined results: a null text, or one without words, has no shingles and is a component of its own;
fewer than five words are one shingle; a null id takes part, and its component is the smallest id of
the group (null if there is none); repeated rows get equal results; an empty table gives an empty
result; extra columns are ignored or carried unchanged.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from revlume.llm.cluster import ship
from revlume.llm.words import LOWER, NOT_SPACE, find_words, pieces, runs_print, text_bytes, word_prints
from revlume.operators.joins import fits, only, with_attributes
from revlume.session import staged

SHINGLE = 5
#: Links have 100 x intersection >= LINK x union.
LINK = 75
TREES, DEPTH = 12, 8
HASHES = TREES * DEPTH
#: Classes that a class looks at in each tree, and clear links after which it stops.
REACH, ENOUGH = 12, 2
#: Share of equal hashes below which a pair is no candidate (4 deviations under LINK), and of a clear link.
LEAST_EQUAL, CLEAR = 0.58, 0.82
#: Classes of a region in one block, and their shingles; every two blocks meet in one tile.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles of the tiles that are confirmed together, and pairs that are gone through at once.
AT_ONCE, PAIRS_AT_ONCE = 1 << 21, 1 << 19
MAX_BROADCAST_ROWS = 500_000

_random = np.random.default_rng(20)
_FACTORS = _random.integers(1, 1 << 63, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 1 << 14
TILE = ["region", "low", "high"]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted shingle fingerprints of each text."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = find_words(data, offsets, NOT_SPACE)
    words = word_prints(data, starts, ends)
    shingles = runs_print(words, SHINGLE)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = int(b - a)
        if n >= SHINGLE:
            yield np.unique(shingles[a : b - SHINGLE + 1])
        elif n:
            yield runs_print(words[a:b], n) + np.uint64(n)
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), _STEP):
            least = np.minimum(least, (_FACTORS[:, None] * shingles[None, a : a + _STEP]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def set_name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 2 << 20):
        sizes, names, signatures = [], [], []
        for shingles in shingle_sets(batch.column("text")):
            sizes.append(len(shingles))
            names.append(set_name(shingles) if len(shingles) else None)
            signatures.append(signature(shingles).astype(">u4").tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
             pa.array(signatures, pa.binary())],
            names=["doc_id", "key", "n_shingles", "name", "signature"],
        )


def _fixed(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Binary values of one width as the rows of an array."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)
    data = column.buffers()[2]
    begin = int(offsets[column.offset])
    flat = np.frombuffer(data, np.uint8)[begin : begin + width * len(column)]
    return flat.view(kind).reshape(len(column), -1)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of classes that stand close to each other in one sorted run."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column("tree").to_numpy()
        first = _fixed(batch.column("prefix"), 4 * DEPTH, ">u4")[:, 0].astype(np.uint32)
        sketch = _fixed(batch.column("sketch"), HASHES, "u1")
        name = _fixed(batch.column("name"), 16, "S16")[:, 0]
        if held is not None:
            tree, first, sketch, name = (np.concatenate(x) for x in zip(held, (tree, first, sketch, name), strict=True))
            seen = len(held[0])
        else:
            seen = 0
        n = len(tree)
        met = np.zeros(n, np.int64)
        left, right = [], []
        for d in range(1, min(REACH, n - 1) + 1):
            i = np.arange(max(0, seen - d), n - d)
            i = i[(met[i] < ENOUGH) & (tree[i] == tree[i + d]) & (first[i] == first[i + d])]
            equal = (sketch[i] == sketch[i + d]).mean(axis=1) if len(i) else np.zeros(0)
            near = equal >= LEAST_EQUAL
            met[i[equal >= CLEAR]] += 1
            left.append(i[near])
            right.append(i[near] + d)
        held = tuple(x[-REACH:] for x in (tree, first, sketch, name))
        left, right = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
        a, b = name[left], name[right]
        swap = a > b
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        yield pa.RecordBatch.from_arrays([_names(a), _names(b)], names=["a", "b"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Whole tiles, several at a time, and the number of each row's tile; the rows come sorted by tile."""
    held = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            held.append(batch)
        rows = pa.concat_batches(held) if held else None
        if rows is None:
            return
        numbers = np.stack([rows.column(c).to_numpy() for c in TILE], axis=1)
        tile = np.concatenate([[0], np.cumsum((numbers[1:] != numbers[:-1]).any(axis=1))])
        # The last tile may go on in the next batch.
        end = len(tile) if batch is None else int(np.searchsorted(tile, tile[-1]))
        held = [rows.slice(end)]
        if end:
            yield tile[:end], rows.slice(0, end)


def _pairs_in_tiles(tile: np.ndarray, rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs to confirm: of different components, sketches and sizes alike, and met in no earlier tree."""
    label = np.unique(_fixed(rows.column("label"), 16, "S16")[:, 0], return_inverse=True)[1]
    block, tree, size = (rows.column(c).to_numpy() for c in ("block", "tree", "n_shingles"))
    inside = rows.column("low").to_numpy() == rows.column("high").to_numpy()
    sketch, firsts = _fixed(rows.column("sketch"), HASHES, "u1"), _fixed(rows.column("firsts"), 4 * TREES, ">u4")
    earlier = np.arange(TREES) < tree[:, None]
    i, d = np.arange(len(tile)), 0
    while len(i):
        d += 1
        i = i[i + d < len(tile)]
        i = i[tile[i] == tile[i + d]]
        p = i[(label[i] != label[i + d]) & (inside[i] | (block[i] != block[i + d]))]
        least, most = np.minimum(size[p], size[p + d]), np.maximum(size[p], size[p + d])
        p = p[100 * least >= LINK * most]
        if len(p):
            p = p[(sketch[p] == sketch[p + d]).mean(axis=1) >= LEAST_EQUAL]
        if len(p):
            p = p[~((firsts[p] == firsts[p + d]) & earlier[p]).any(axis=1)]
        if len(p):
            yield p, p + d


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the tiles that have a pair to confirm."""
    for tile, rows in _tiles(batches):
        used = np.zeros(len(tile), bool)
        for left, right in _pairs_in_tiles(tile, rows):
            used[left] = used[right] = True
        if used.any():
            yield rows.filter(pa.array(used))


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components, confirmed on whole sets: no more than it takes to join them."""
    for tile, rows in _tiles(batches):
        # Whole tiles again, as many as have ``AT_ONCE`` shingles together.
        total = np.cumsum(rows.column("n_shingles").to_numpy())
        starts = np.flatnonzero(np.diff(tile, prepend=-1))
        share = (total[starts] // AT_ONCE).astype(np.int64)
        cuts = [*starts[np.flatnonzero(np.diff(share, prepend=-1))], len(tile)]
        for a, b in itertools.pairwise(cuts):
            yield from _joining_links(tile[a:b], rows.slice(a, b - a))


def _joining_links(tile: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    name, column = _fixed(rows.column("name"), 16, "S16")[:, 0], rows.column("shingles")
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
    bounds = np.cumsum([0, *map(len, sets)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    present = np.zeros(int(ids.max()) + 1, bool)
    group = np.unique(_fixed(rows.column("label"), 16, "S16")[:, 0], return_inverse=True)[1]
    left, right, held = [], [], 0

    def confirmed() -> Iterator[tuple[int, int]]:
        x, y = np.concatenate(left), np.concatenate(right)
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        for i, others in zip(x[np.flatnonzero(np.diff(x, prepend=-1))], np.split(y, np.flatnonzero(np.diff(x)) + 1), strict=True):
            own = ids[bounds[i] : bounds[i + 1]]
            present[own] = True
            for j in others[group[others] != group[i]]:
                if group[j] == group[i]:
                    continue
                both = int(np.count_nonzero(present[ids[bounds[j] : bounds[j + 1]]]))
                if 100 * both >= LINK * (len(own) + len(sets[j]) - both):
                    group[group == group[j]] = group[i]
                    yield i, j
            present[own] = False

    links = []
    for p, q in _pairs_in_tiles(tile, rows):
        left.append(p)
        right.append(q)
        held += len(p)
        if held > PAIRS_AT_ONCE:
            links += confirmed()
            left, right, held = [], [], 0
    if held:
        links += confirmed()
    if links:
        a, b = name[[i for i, _ in links]], name[[j for _, j in links]]
        swap = a > b
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        yield pa.RecordBatch.from_arrays([_names(a), _names(b)], names=["a", "b"])


def _names(values: np.ndarray) -> pa.Array:
    wide = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), 16)
    return pa.array([row.tobytes() for row in wide], pa.binary())


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 2 << 20):
        sets = list(shingle_sets(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [pa.array([set_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["name", "shingles"],
        )


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= LINK * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def signed_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` of the text, number of shingles, name of the set and signature; written."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return staged(rows.mapInArrow(_signed, f"doc_id {kind}, key long, n_shingles long, name binary, signature binary"), "op7-signed")


def _sketch() -> Column:
    """The last byte of each hash."""
    return F.unhex(F.expr(f"array_join(transform(sequence(0, {HASHES - 1}), i -> hex(substring(signature, i * 4 + 4, 1))), '')"))


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of classes to confirm; ``classes`` has ``name`` and ``signature``."""
    rows = classes.select("name", "signature", _sketch().alias("sketch"))
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = rows.select("name", "signature", "sketch", tree)
    prefix = F.expr(f"substring(signature, tree * {4 * DEPTH} + 1, {4 * DEPTH})")
    rows = staged(rows.select("tree", prefix.alias("prefix"), "name", "sketch"), "op7-forest")
    order = ["tree", "prefix", "name"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(rows.mapInArrow(_neighbours, "a binary, b binary").distinct(), "op7-pairs")


def whole_sets(docs: DataFrame, classes: DataFrame, named: DataFrame) -> DataFrame:
    """``name`` and ``shingles`` of all classes in ``named``; ``classes`` has ``name``, ``key`` and ``rep``."""
    wanted = staged(classes.join(named, "name", "left_semi").select("key", "rep"), "op7-wanted")
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    listed = F.broadcast(wanted) if fits(wanted, MAX_BROADCAST_ROWS) else wanted
    rows = rows.join(listed, ["key"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("text")
    return staged(rows.mapInArrow(_whole_sets, "name binary, shingles binary").dropDuplicates(["name"]), "op7-sets")


def confirm(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    left = sets.select(F.col("name").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("name").alias("b"), F.col("shingles").alias("right"))
    joined = pairs.join(left, "a").join(right, "b")
    return staged(joined.mapInArrow(_confirmed, "a binary, b binary"), "op7-links")


def meeting_classes(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """The classes that have a pair to confirm in a tile, once for each such tile.

    Classes meet that share a first hash (a region is one tree and first hash) and are not in one component.
    They are dealt to blocks and every two blocks meet in one tile, so no region lands in one task; blocks of the
    region's largest component meet only the others.  Regions of one component alone are left out.
    """
    rows = classes.join(labels.withColumnRenamed("node", "name"), "name", "left")
    firsts = F.expr(f"concat({', '.join(f'substring(signature, {t * 4 * DEPTH + 1}, 4)' for t in range(TREES))})")
    rows = rows.select("name", F.coalesce("label", "name").alias("label"), "n_shingles", _sketch().alias("sketch"), firsts.alias("firsts"))
    rows = staged(rows, "op7-labelled")
    # 64 bits name a region; two regions of one name would only meet in vain.
    trees = F.posexplode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> xxhash64(t, substring(firsts, t * 4 + 1, 4)))"))
    held = rows.select("label", "n_shingles", trees.alias("tree", "region")).groupBy("region", "label")
    held = held.agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"))
    largest = F.max_by(F.struct("label", "n", "m"), F.struct("n", "label")).alias("largest")
    regions = held.groupBy("region").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("labels"), largest)
    blocks = lambda n, m: F.ceil(F.greatest(n / BLOCK, m / BLOCK_SHINGLES)).cast("int")
    regions = regions.where("labels > 1").select(
        "region", F.col("largest.label").alias("top"), blocks(F.col("largest.n"), F.col("largest.m")).alias("crowd"),
        blocks(F.col("n") - F.col("largest.n"), F.col("m") - F.col("largest.m")).alias("others"),
    )
    regions = staged(regions, "op7-regions")
    rows = rows.select("*", trees.alias("tree", "region"))
    rows = rows.join(F.broadcast(regions) if fits(regions, MAX_BROADCAST_ROWS) else regions, "region")
    crowded = F.col("label") == F.col("top")
    dealt = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    rows = rows.withColumn("block", F.when(crowded, F.col("others") + dealt("crowd")).otherwise(dealt("others")))
    met = F.when(crowded, F.col("others")).otherwise(F.col("others") + F.col("crowd"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    rows = rows.select("region", low, high, "block", "tree", "name", "label", "n_shingles", "sketch", "firsts")
    rows = rows.repartition(*TILE).sortWithinPartitions(*TILE)
    return staged(rows.mapInArrow(_meeting, rows.schema), "op7-meeting")


def joining_links(sets: DataFrame, meeting: DataFrame) -> DataFrame:
    """Confirmed links that join the components of ``meeting``; ``sets`` has ``name`` and ``shingles``."""
    rows = meeting.join(sets, "name").repartition(*TILE).sortWithinPartitions(*TILE)
    return staged(rows.mapInArrow(_joining, "a binary, b binary"), "op7-joining")


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` after further links, whose components are found over the labels alone."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    ends = more.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select("a", "b", F.coalesce("a_label", "a").alias("p"), F.coalesce("b_label", "b").alias("q"))
    over = components(ends.select(F.col("p").alias("a"), F.col("q").alias("b")).where("a != b").distinct())
    over = over.withColumnRenamed("label", "top").withColumnRenamed("node", "label")
    alone = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().join(labels, "node", "left_anti")
    known = labels.unionByName(alone.withColumn("label", F.col("node")))
    return with_attributes(known, over, ["label"], ["node"]).select("node", F.coalesce("top", "label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for all nodes with links."""
    edges = staged(
        links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))),
        "op7-edges",
    )
    labels = edges.groupBy("u").agg(F.min("v").alias("near")).select(F.col("u").alias("node"), F.least("u", "near").alias("label"))
    labels = staged(labels.withColumn("moved", F.lit(True)), "op7-labels")
    while True:
        own = labels.select(F.col("node").alias("u"), F.col("label").alias("own"))
        other = labels.select(F.col("node").alias("v"), F.col("label").alias("other"))
        met = edges.join(other, "v").groupBy("u").agg(F.min("other").alias("other")).join(own, "u")
        # A node takes the smallest label next to it, and so does the node its own label names.
        offers = met.select(F.explode(F.array("u", "own")).alias("node"), F.least("own", "other").alias("offer"))
        offers = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = labels.join(offers, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        hooked = staged(hooked, "op7-hooked")
        # Then labels are replaced by their own labels.  Many nodes share one: the list of labels is joined spread out.
        used = hooked.select("label").distinct()
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("further")).join(used, "label")
        jumped = with_attributes(hooked, jump, ["label"], ["node"])
        label = F.least("label", "further")
        labels = staged(jumped.select("node", label.alias("label"), (label != F.col("old")).alias("moved")), "op7-labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``key``, ``n_shingles``, ``component_id``, ``kept`` and ``component``.

    ``component`` names the group whatever its ids are; it is null without words.
    """
    ship(docs.sparkSession)
    signed = signed_documents(docs)
    known = signed.where(F.col("name").isNotNull())
    # The class keeps the smallest id and the text it has; null ids come last.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    classes = known.groupBy("name").agg(least, F.min("signature").alias("signature"), F.min("n_shingles").alias("n_shingles"))
    classes = staged(classes.select("name", "signature", "n_shingles", "least.key", F.col("least.doc_id").alias("rep")), "op7-classes")
    pairs = candidate_pairs(classes)
    named = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    labels = components(confirm(whole_sets(docs, classes, named), pairs))
    meeting = meeting_classes(classes, labels)
    if not meeting.isEmpty():
        more = joining_links(whole_sets(docs, classes, meeting.select("name").distinct()), meeting)
        if not more.isEmpty():
            labels = staged(merged(labels, more), "op7-merged")
    labels = labels.withColumnRenamed("node", "name")
    grouped = staged(labels.join(classes.select("name", "rep"), "name"), "op7-grouped")
    smallest = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = with_attributes(grouped, smallest, ["label"], ["name"]).select("name", "component_id", "label")
    final = classes.select("name", "rep").join(linked, "name", "left")
    final = final.select("name", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("label", "name").alias("component"))
    rows = signed.select("doc_id", "key", "n_shingles", "name").join(final, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "key", "n_shingles", component.alias("component_id"), "component").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, columns unchanged; those without words all stay.

    The one with the smallest id stays, null ids last; of several texts with that id the first by hash.
    """
    found = staged(deduplicate(docs), "op7-found")
    none, number = F.col("doc_id").isNull().alias("d_none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d_id")
    groups = found.where("n_shingles > 0").select("component", "doc_id", none, number, "key")
    groups = groups.groupBy("component", "doc_id", "d_none", "d_id", "key").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct("d_none", "doc_id", "key")).alias("first")
    groups = with_attributes(groups, groups.groupBy("component").agg(first), ["component"], ["key"])
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    groups = groups.select("d_none", "d_id", "key", "n", kept.alias("kept"))
    whole = docs.select(F.struct("*").alias("row"), none, number, F.xxhash64(F.col("text").cast("string")).alias("key"))
    on = ["d_none", "d_id", "key"]
    odd = staged(groups.where("n > 1 or not kept"), "op7-odd")
    gone = odd.select(*on)
    stay = whole.join(F.broadcast(gone) if fits(gone, MAX_BROADCAST_ROWS) else gone, on, "left_anti").select("row.*")
    # A kept document that stands in the table several times stays once.
    again = odd.where("kept").select(*on)
    if again.isEmpty():
        return stay
    first = F.row_number().over(Window.partitionBy(*on).orderBy("key"))
    return stay.unionByName(only(whole, again, on, ["key"]).withColumn("n", first).where("n = 1").select("row.*"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_shingles", "component_id", "kept")
