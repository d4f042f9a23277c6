"""Longest verbatim matches against a plain search of all places."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from revlume.llm import op2_suffix_decontamination as op2

WINDOW = 4


def cut(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def longest_matches(text, tests, window=WINDOW):
    words, found = cut(text), set()
    for item, other in tests:
        there = cut(other)
        least = min(window, len(there))
        for p in range(len(words)):
            for j in range(len(there)):
                if p and j and words[p - 1] == there[j - 1]:
                    continue
                n = 0
                while p + n < len(words) and j + n < len(there) and words[p + n] == there[j + n]:
                    n += 1
                if least and n >= least:
                    found.add((p, -n, "null" if item is None else str(item), j))
    kept, end = [], 0
    for p, less, item, j in sorted(found):
        if p - less > end:
            end = p - less
            kept.append((p, -less, item, j))
    return kept


def corpus(seed):
    """Texts of very few words, so that matches repeat, overlap and cross each other."""
    dice = random.Random(seed)
    tests = [(i, " ".join(dice.choice("abc") for _ in range(dice.randint(0, 14)))) for i in range(12)]
    tests += [(3, "b a b a b a c"), (None, "A b! c, a"), (90, None), (91, "é é é é é"), (92, tests[1][1])]
    texts = [" ".join(dice.choice("abcx") for _ in range(dice.randint(0, 60))) for _ in range(40)]
    texts += [" ".join(t or "" for _, t in tests), None, "", "é " * 30, "a b c a", "x " * 2000 + tests[5][1]]
    return [(i % 40, t) for i, t in enumerate([*texts, *texts[:3]])], tests


@pytest.mark.parametrize("block_chars", [20, 10_000])
def test_longest_matches(spark, block_chars):
    rows, tests = corpus(block_chars)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    listed = spark.createDataFrame(tests, "item_id long, text string")
    got = op2.find_matches(docs, listed, WINDOW, block_chars).select("row.doc_id", "row.text", "matches").collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(m) for m in r.matches] == longest_matches(r.text, tests)


def test_two_overlapping_tests_are_two_matches(spark):
    words = [f"w{i}" for i in range(20)]
    tests = spark.createDataFrame([("one", " ".join(words[:10])), ("two", " ".join(words[5:15]))], "item_id string, text string")
    docs = spark.createDataFrame([(1, "start " + " ".join(words))], "doc_id long, text string")
    row = op2.find_matches(docs, tests).first()
    assert [tuple(s) for s in row.spans] == [(1, 15)]
    assert [tuple(m) for m in row.matches] == [(1, 10, "one", 0), (6, 10, "two", 0)]


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_matches_do_not_depend_on_what_is_held(at_once):
    rows, tests = corpus(5)
    index = op2.TestSuffixes([str(i) for i, _ in tests], [t for _, t in tests], WINDOW)
    text = max((t or "" for _, t in rows), key=len)
    words, first = op2.prints_of(pa.array([text]), op2.ALNUM, lower=True)
    [(_, _, which, place)] = op2._search(words, np.asarray(first), index)
    assert op2._matches(index, which, place, at_once) == op2._matches(index, which, place)
