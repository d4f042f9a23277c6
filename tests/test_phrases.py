"""Phrases of several words: the automaton against plain search, scores against a loop over words."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from revlume.operators.phrases import Phrase, PhraseBook, leftmost_longest
from revlume.operators.sentiment import ENGLISH_PHRASES, ENGLISH_WITH_PHRASES, lexicon_score, phrase_spans
from test_sentiment import LEXICON, random_texts, split_words

from dataclasses import replace

LISTS = [
    [("a",), ("a", "b"), ("b", "c"), ("a", "b", "c", "a"), ("c", "a", "b"), ("b",)],
    [("a", "a"), ("a", "a", "a"), ("b", "a", "a", "b")],
    [("c", "c", "c", "c", "c"), ("c", "b"), ("b", "b", "c", "b")],
    [],
]


def occurrences(tokens, phrases):
    return sorted((i, -len(p), p) for i in range(len(tokens)) for p in set(phrases) if tuple(tokens[i : i + len(p)]) == p)


def without_overlap(found):
    free, out = 0, []
    for start, less, p in found:
        if start >= free:
            out.append((start, less, p))
            free = start - less
    return out


@pytest.mark.parametrize("phrases", LISTS)
def test_every_occurrence(spark, phrases):
    rng = random.Random(3)
    rows = [(i, [rng.choice("aabbcx") for _ in range(rng.randrange(14))]) for i in range(150)] + [(900, None), (901, ["a"] * 300)]
    frame = spark.createDataFrame(rows, "id int, ts array<string>")
    book = PhraseBook([Phrase(p) for p in phrases])
    found = frame.withColumn("f", book.found(spark, F.col("ts"))).withColumn("k", leftmost_longest(F.col("f")))
    for r in found.collect():
        wanted = occurrences(r.ts or [], phrases)
        told = lambda ms: sorted((m.start, m.less, book.phrases[m.p].words) for m in ms or [])
        assert told(r.f) == wanted
        assert told(r.k) == sorted(without_overlap(wanted))


def score_with_phrases(text, rules=ENGLISH_WITH_PHRASES):
    """The scorer's rules again, with phrases put in the place of their words."""
    if not text or not text.strip():
        return 0.0
    raw = split_words(text)
    low = [w.lower() for w in raw]
    up = [w.isupper() for w in raw]
    mixed = any(up) and not all(up)
    turns = [i for i, w in enumerate(low) if w == rules.contrast]
    marks = {}
    for i, w in enumerate(low):
        b = rules.degree if w in rules.intensifiers else -rules.degree if w in rules.diminishers else None
        marks[i] = [LEXICON.get(w), b, w in rules.negations or "n't" in w, None, up[i]]
    by_words = {p.words: p for p in rules.phrases}
    for start, less, words in without_overlap(occurrences(low, list(by_words))):
        p, last = by_words[words], start - less - 1
        for i in range(start, last + 1):
            turns = [t for t in turns if t != i]
            marks.pop(i)
        marks[last] = [p.v, p.b, p.g, p.e, all(up[start : last + 1])]
    total = 0.0
    for i, (v, _, _, _, loud) in sorted(marks.items()):
        if v is None:
            continue
        if loud and mixed:
            v += rules.capitals if v > 0 else -rules.capitals
        for k, weight in enumerate(rules.distance):
            mv, b, g, e, loud_before = marks.get(i - k - 1, [None, None, False, None, False])
            if mv is not None:
                continue
            if b is not None:
                s = -b if v < 0 else b
                if loud_before and mixed:
                    s += rules.capitals if v > 0 else -rules.capitals
                v += s * weight
            if g:
                v *= rules.negation
            elif e is not None:
                v *= e
        if turns and i != turns[0]:
            v *= rules.before_contrast if i < turns[0] else rules.after_contrast
        total += v
    questions = text.count("?")
    emphasis = min(text.count("!"), 4) * 0.292
    emphasis += 0 if questions < 2 else questions * 0.18 if questions <= 3 else 0.96
    total += emphasis if total > 0 else -emphasis if total < 0 else 0
    return round(total / math.sqrt(total * total + 15), 4)


TEXTS = [
    "never so good", "never this good", "not so good", "least good", "at least it is good", "the very least good",
    "kind of good", "it is kind", "KIND OF good app", "to die for", "this is to die for but awful", "the food is the bomb!!",
    "without a doubt good", "without good", "yeah right good", "in the red and in the black", "never so", "never never so good",
    "kiss of death kiss of", "hand to mouth hand", "break a leg break a leg", "", None, "sort of kind of good", "BUS STOP good",
    "at the very least so good but never this great",
]


def phrase_texts():
    rng = random.Random(8)
    pool = [" ".join(p.words) for p in ENGLISH_PHRASES] + list(LEXICON) + "never so this not at least kind of very but the a x".split()
    made = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    return TEXTS + [t.upper() if rng.random() < 0.1 else t for t in made] + random_texts(100)


@pytest.mark.parametrize("inline", [20_000, 0])
def test_scores_with_phrases(spark, inline):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "tok string, val double")
    texts = phrase_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, review_text string")
    rules = replace(ENGLISH_WITH_PHRASES, max_inline_words=inline)
    got = {r.id: r.sentiment_score for r in lexicon_score(frame, lexicon, ["id"], rules=rules).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(score_with_phrases(text), abs=1e-4), text


def test_phrases_change_labels(spark):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "tok string, val double")
    frame = spark.createDataFrame([(1, "to die for"), (2, "never so good"), (3, "least good")], "id int, review_text string")
    got = {r.id: r.sentiment_score for r in lexicon_score(frame, lexicon, ["id"], rules=ENGLISH_WITH_PHRASES).collect()}
    assert got[1] > 0.25 and got[2] > 0.25 and got[3] < 0


def test_spans(spark):
    phrases = tuple(Phrase(p) for p in [("one", "two"), ("two", "three"), ("one", "two", "three", "four"), ("four",)])
    frame = spark.createDataFrame([(1, "One two three. Four, one two four"), (2, None), (3, "two three four!")], "id int, t string")
    rows = {r.id: (r.n_found, [tuple(s) for s in r.spans]) for r in phrase_spans(frame, phrases, "t").collect()}
    assert rows[1] == (6, [(0, 4, "one two three four"), (4, 2, "one two"), (6, 1, "four")])
    assert rows[2] == (0, []) and rows[3] == (2, [(0, 2, "two three"), (2, 1, "four")])


def test_long_text_of_many_phrases(spark):
    # One look per word and phrase: the square of their numbers would take minutes.
    text = " ".join(["good bad ass meh"] * 10_000)
    rows = spark.createDataFrame([(1, text)], "id long, review_text string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "tok string, val double")
    begun = time.monotonic()
    scored = lexicon_score(rows, lexicon, ["id"], rules=ENGLISH_WITH_PHRASES).first()
    assert scored.sentiment_score == 1.0
    assert time.monotonic() - begun < 40
