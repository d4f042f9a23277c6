"""Phrases of several words in a text's tokens: a token trie with failure links.

The trie of all phrases is built on the driver (phrase lists are short and bounded) together with failure
links, after Aho and Corasick: where no child fits, the automaton goes on from the longest other phrase
beginning that ends at the same token.  It travels as nested arrays inside the plan, so texts are searched in place.
The state at a token depends on no more tokens than the longest phrase has, so each token of the phrases'
vocabulary is looked at by itself and no state is handed from one end of a text to the other.  Only tokens that
end a phrase together with the token before them, or by themselves, are looked at.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession, functions as F

#: Most phrases that travel inside a plan.
MAX_PHRASES = 100_000


@dataclass(frozen=True)
class Phrase:
    """Words in lower case, and what their last one counts as: valence, degree, negation, factor for what follows.

    The other words of the phrase count for nothing.
    """

    words: tuple[str, ...]
    v: float | None = None
    b: float | None = None
    g: bool = False
    e: float | None = None


class PhraseBook:
    """The automaton of a list of phrases; of equal phrases the last one counts."""

    def __init__(self, phrases: Sequence[Phrase]):
        unique = {p.words: p for p in phrases if p.words}
        if len(unique) > MAX_PHRASES:
            raise ValueError(f"more than {MAX_PHRASES} phrases")
        self.phrases = [unique[w] for w in sorted(unique)]
        self.longest = max((len(p.words) for p in self.phrases), default=0)
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for p in self.phrases for w in p.words}))}
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for number, phrase in enumerate(self.phrases):
            at = 0
            for word in phrase.words:
                key = self.ids[word]
                if key not in children[at]:
                    children[at][key] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][key]
            ends[at].append(number)
        # By breadth: a node's failure link leads to a shorter beginning, which is done before.
        fail = [0] * len(children)
        self.root = dict(children[0])
        moves: list[dict[int, int]] = [{} for _ in children]
        queue = deque(children[0].values())
        while queue:
            at = queue.popleft()
            moves[at] = {**moves[fail[at]], **children[at]}
            ends[at] = ends[at] + ends[fail[at]]
            for key, child in children[at].items():
                fail[child] = moves[fail[at]].get(key, self.root.get(key, 0))
                queue.append(child)
        self.moves, self.ends = moves, ends

    def found(self, spark: SparkSession, lowered: Column) -> Column:
        """All occurrences in an array of lower-case tokens, overlapping ones too: ``start``, ``less`` (length, negative), ``p``."""
        if not self.phrases:
            return F.from_json(F.lit("[]"), "array<struct<start: int, less: int, p: int>>")
        ids = self._lookup(spark)
        sent = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
        by_id = [self.root.get(i, 0) for i in range(len(self.ids) + 1)]
        root = sent(by_id, "array<int>")
        moves = sent([{"w": sorted(m), "t": [m[k] for k in sorted(m)]} for m in self.moves], "array<struct<w: array<int>, t: array<int>>>")
        ends = sent([[{"less": -len(self.phrases[p].words), "p": p} for p in e] for e in self.ends], "array<array<struct<less: int, p: int>>>")
        pair, lone = self._endings(spark)

        def step(state: Column, key: Column) -> Column:
            node = F.get(moves, state)
            child = F.array_position(node["w"], key).cast("int")
            return F.when(key == 0, F.lit(0)).when(child > 0, F.get(node["t"], child - 1)).otherwise(F.get(root, key))

        def at_word(tokens: Column, i: Column) -> Column:
            first = F.greatest(i - (self.longest - 1), F.lit(0))
            keys = F.transform(F.slice(tokens, first + 1, i - first + 1), lambda t: F.coalesce(ids(t), F.lit(0)))
            return F.transform(
                F.get(ends, F.aggregate(keys, F.lit(0), step)),
                lambda m: F.struct((i + m["less"] + 1).alias("start"), m["less"].alias("less"), m["p"].alias("p")),
            )

        def places(tokens: Column) -> Column:
            may_end = lambda t, i: lone(t) | pair(F.get(tokens, i - 1), t)
            return F.array_compact(F.transform(tokens, lambda t, i: F.when(may_end(t, i), i)))

        # One array of tokens, bound once: the steps read it again and again.
        hits = F.transform(F.array(lowered), lambda tokens: F.flatten(F.transform(places(tokens), lambda i: at_word(tokens, i))))
        return F.array_sort(F.get(hits, F.lit(0)))

    def _endings(self, spark: SparkSession):
        """Whether a word may end a phrase, with the word before it or by itself: flags by hash, at times raised for others too."""
        ends = [p.words[-2:] for p in self.phrases]
        size = 8 * len(set(ends)) + 1
        slot = lambda *words: F.pmod(F.xxhash64(*words), F.lit(size)).cast("int")
        pairs = sorted({e for e in ends if len(e) == 2})
        rows = spark.createDataFrame(pairs, "one string, two string").select(slot("one", "two").alias("s"))
        taken = {r.s for r in rows.collect()}
        flags = F.from_json(F.lit(json.dumps([i in taken for i in range(size)])), "array<boolean>")
        words = [e[0] for e in sorted(set(ends)) if len(e) == 1]
        rows = spark.createDataFrame([(w,) for w in words], "w string").select(slot("w").alias("s"))
        taken = {r.s for r in rows.collect()} if words else set()
        alone = F.from_json(F.lit(json.dumps([i in taken for i in range(size)])), "array<boolean>")
        return (
            lambda before, word: F.get(flags, slot(before, word)),
            lambda word: F.get(alone, slot(word)) if words else F.lit(False),
        )

    def _lookup(self, spark: SparkSession):
        """A word's number by literal: small maps picked by the word's hash."""
        size = max(1, 2 * len(self.ids))
        rows = spark.createDataFrame(list(self.ids.items()), "w string, i int")
        slots: list[dict] = [{} for _ in range(size)]
        for r in rows.select("w", "i", F.pmod(F.xxhash64("w"), F.lit(size)).cast("int").alias("s")).collect():
            slots[r.s][r.w] = r.i
        table = F.from_json(F.lit(json.dumps(slots)), "array<map<string, int>>")
        return lambda word: F.get(table, F.pmod(F.xxhash64(word), F.lit(size)).cast("int"))[word]

    def values(self, kept: Column) -> Column:
        """Occurrences with what they count as: ``start``, ``last``, ``v``, ``b``, ``g``, ``e``."""
        told = [{"v": p.v, "b": p.b, "g": p.g, "e": p.e} for p in self.phrases]
        table = F.from_json(F.lit(json.dumps(told)), "array<struct<v: double, b: double, g: boolean, e: double>>")
        return F.transform(
            kept,
            lambda m: F.struct(
                m["start"].alias("start"), (m["start"] - m["less"] - 1).alias("last"), *[F.get(table, m["p"])[c].alias(c) for c in "vbge"]
            ),
        )


def leftmost_longest(found: Column) -> Column:
    """Occurrences that do not overlap: from the left, of those at one place the longest."""
    kind = "struct<free: int, kept: array<struct<start: int, less: int, p: int>>>"
    begin = F.from_json(F.lit('{"free": 0, "kept": []}'), kind)

    def take(held: Column, m: Column) -> Column:
        fits = m["start"] >= held["free"]
        return F.struct(
            F.when(fits, m["start"] - m["less"]).otherwise(held["free"]).alias("free"),
            F.when(fits, F.array_append(held["kept"], m)).otherwise(held["kept"]).alias("kept"),
        ).cast(kind)

    return F.aggregate(found, begin, take, lambda held: held["kept"])
