"""Scores against a plain loop over words, by both ways of looking words up."""

import math
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from revlume.operators.analysis import analyze_reviews, choose_scorer
from revlume.operators.model import model_score
from revlume.operators.sentiment import ENGLISH, lexicon_score, words

LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "awful": -2.0, "kind": 2.4, "wow": 2.8, "meh": -0.3}
PUNCT = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
MARKS = [".", "!", "?", ",", ";", ":", "-", "'", '"', "!!", "!!!", "??", "???", "?!?", "!?!", "?!?!", "!?!?"]
MARK = "(?:" + "|".join(re.escape(m) for m in MARKS) + ")"


def split_words(text):
    out = []
    for token in text.split():
        if len(token) > 1:
            for pattern in (rf"{MARK}([^{PUNCT}]{{2,}})", rf"([^{PUNCT}]{{2,}}){MARK}"):
                found = re.fullmatch(pattern, token)
                if found:
                    token = found.group(1)
                    break
            out.append(token)
    return out


def score_by_hand(text, rules=ENGLISH):
    if not text or not text.strip():
        return 0.0
    ws = split_words(text)
    low = [w.lower() for w in ws]
    up = [w.isupper() for w in ws]
    mixed = any(up) and not all(up)

    def degree(w):
        return rules.degree if w in rules.intensifiers else -rules.degree if w in rules.diminishers else None

    total = 0.0
    turn = low.index(rules.contrast) if rules.contrast in low else None
    for i, w in enumerate(low):
        if w not in LEXICON:
            continue
        v = LEXICON[w]
        if up[i] and mixed:
            v += rules.capitals if v > 0 else -rules.capitals
        for k, weight in enumerate(rules.distance):
            j = i - k - 1
            if j < 0 or low[j] in LEXICON:
                continue
            d = degree(low[j])
            if d is not None:
                s = -d if v < 0 else d
                if up[j] and mixed:
                    s += rules.capitals if v > 0 else -rules.capitals
                v += s * weight
            if low[j] in rules.negations or "n't" in low[j]:
                v *= rules.negation
        if turn is not None and i != turn:
            v *= rules.before_contrast if i < turn else rules.after_contrast
        total += v
    questions = text.count("?")
    emphasis = min(text.count("!"), 4) * 0.292
    emphasis += 0 if questions < 2 else questions * 0.18 if questions <= 3 else 0.96
    total += emphasis if total > 0 else -emphasis if total < 0 else 0
    return round(total / math.sqrt(total * total + 15), 4)


TEXTS = [
    "", None, "   ", "nothing here", "good", "GOOD", "very good", "This is VERY good", "a good, great day!",
    "not good", "don't think it is good", "not very good", "so good but awful", "good good", "very bad!!!",
    "(good) \"good\" 'good good' !!good", "barely good", "is it good??", "what? good? why? good?", "Wow!!!! GREAT app",
    "never so kind", "good app　bad", "BUT good", "good -- bad", "isn't it AWFUL", "hardly EXTREMELY bad",
    "good!!!! good?! good!?! good?!?! ''good it's- -good- ?good", "a" * 300 + " very good", "\x1cgood\x85bad\xa0",
]


def random_texts(n):
    rng = random.Random(5)
    pool = list(LEXICON) + "very not never so but barely BUT Very NOT app is it don't the".split()
    out = []
    for _ in range(n):
        ws = [rng.choice(pool) for _ in range(rng.randint(1, 14))]
        ws = [w.upper() if rng.random() < 0.2 else w for w in ws]
        ws = [w + rng.choice(["", "", "", "!", ".", "?", "?!?", ",", "..."]) for w in ws]
        out.append(" ".join(ws))
    return out


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "tok string, val double")


@pytest.mark.parametrize("inline", [20_000, 0])
def test_scores(spark, lexicon, inline):
    texts = TEXTS + random_texts(400)
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, review_text string")
    rules = replace(ENGLISH, max_inline_words=inline)
    scored = lexicon_score(frame, lexicon, rules=rules, key=["id"])
    got = {r.id: r.sentiment_score for r in scored.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(score_by_hand(text), abs=1e-4), text


@pytest.mark.parametrize("size", [19_999, 20_000, 20_001])
def test_any_lexicon_size_is_called_alike(spark, lexicon, size):
    known = set(LEXICON) | set(ENGLISH.intensifiers) | set(ENGLISH.diminishers) | set(ENGLISH.negations)
    more = spark.range(size - len(known)).selectExpr("concat('w', id) AS tok", "1.0D AS val")
    frame = spark.createDataFrame([(1, "good w7"), (2, "not good")], "id int, review_text string")
    scorer, _ = choose_scorer(lexicon.unionByName(more), ["id"])
    assert {r.id: r.sentiment_score > 0 for r in scorer(frame).collect()} == {1: True, 2: False}


@pytest.mark.parametrize("bound", [0, 10_000])
def test_large_dictionaries_are_cut_to_the_words_in_use(spark, lexicon, bound):
    """A dictionary above the bound, of which the texts use little, and one that stays above it."""
    rare = spark.range(12_000).selectExpr("concat('rare', id) AS tok", "1.0D AS val")
    rules = replace(ENGLISH, max_inline_words=0, max_broadcast_words=bound)
    texts = ["good " * 400, "GOOD but awful", "not rare7 at all", "", None, "isn't bad", "plain words only"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, review_text string")
    large = lexicon.select("tok", F.col("val").cast("double").alias("val")).unionByName(rare)
    got = lexicon_score(rows, large, ["id"], rules=rules)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) == (bound == 0)
    expected = lexicon_score(rows, large, ["id"], rules=replace(ENGLISH, max_inline_words=100_000))
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_words(spark):
    frame = spark.createDataFrame([("I a ok, (ok) 'tis it's ok!? -ok ok...",)], "t string")
    assert frame.select(words(F.col("t"))).first()[0] == split_words("I a ok, (ok) 'tis it's ok!? -ok ok...")


def test_scores_in_range_and_rows_kept(spark, lexicon):
    frame = spark.createDataFrame([(1, "great " * 500), (2, "awful " * 500), (3, None)], "id int, review_text string")
    scored = analyze_reviews(frame, choose_scorer(lexicon, ["id"])[0])
    got = {r.id: (r.sentiment_score, r.sentiment_label) for r in scored.collect()}
    assert got[1][1] == "good" and 0.99 < got[1][0] <= 1.0
    assert got[2][1] == "bad" and -1.0 <= got[2][0] < -0.99
    assert got[3] == (0.0, "neutral")
    assert scored.columns == ["id", "review_text", "sentiment_score", "sentiment_label"]


def make_model(seen_limit):
    def load():
        def predict(texts):
            assert all(t.strip() and len(t) <= seen_limit for t in texts)
            return [("positive" if "good" in t else "NEGATIVE", 0.75) for t in texts]

        return predict

    return load


def test_model(spark):
    texts = ["good", "awful", "", " \n ", None, "x" * 5000 + " good"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, review_text string")
    want = {0: 0.75, 1: -0.75, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.75}
    assert {r.id: r.sentiment_score for r in model_score(frame, make_model(10_000)).collect()} == want
    # with an input limit the last text no longer says "good"
    cut = model_score(frame, make_model(4096), max_chars=4096)
    assert {r.id: r.sentiment_score for r in cut.collect()} == want | {5: -0.75}


def test_choice_of_scorer(spark, lexicon):
    def broken():
        raise OSError("no model here")

    assert choose_scorer(lexicon, ["review_text"])[1] == "lexicon"
    assert choose_scorer(lexicon, ["review_text"], make_model(10))[1] == "model"
    scorer, name = choose_scorer(lexicon, ["review_text"], broken)
    assert name == "lexicon"
    frame = spark.createDataFrame([("good",)], "review_text string")
    assert scorer(frame).first().sentiment_score == score_by_hand("good")


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_joined_scores_cut_words_once(spark, broadcast):
    rows = spark.createDataFrame([(1, "Good, not bad!"), (2, "awful"), (2, None)], "id long, review_text string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "tok string, val double")
    rules = replace(ENGLISH, max_inline_words=0, max_broadcast_words=broadcast)
    scored = lexicon_score(rows, lexicon, ["id"], rules=rules)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "split(" not in plan
    assert scored.count() == 3
