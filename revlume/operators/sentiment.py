"""Lexicon sentiment: a score in [-1, 1] for every text.

The rules follow the published description of rule-based valence scoring
(Hutto and Gilbert, ICWSM 2014): word valences from a lexicon table, degree
words, negation, capitals, the contrastive "but", and punctuation.  The lexicon
is always the caller's table.  Every weight sits in ``Rules``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, functions as F

from revlume.functions import sentiment_label
from revlume.operators.joins import MAX_BROADCAST_ROWS, fits, matched, spread
from revlume.operators.phrases import Phrase, PhraseBook, leftmost_longest
from revlume.session import staged

# Degree words and negations of English.
INTENSIFIERS = (
    "absolutely amazingly awfully completely considerably decidedly deeply "
    "enormously entirely especially exceptionally extremely fabulously fully "
    "greatly hella highly hugely incredibly intensely majorly more most "
    "particularly purely quite really remarkably so substantially thoroughly "
    "totally tremendously uber unbelievably unusually utterly very"
).split()
DIMINISHERS = (
    "almost barely hardly kinda kindof less little marginally occasionally "
    "partly scarcely slightly somewhat sorta sortof"
).split()
NEGATIONS = (
    "aint arent cannot cant couldnt darent despite didnt doesnt dont hadnt "
    "hasnt havent isnt mightnt mustnt neednt neither never none nope nor not "
    "nothing nowhere oughtnt rarely seldom shant shouldnt uhuh uh-uh wasnt "
    "werent without wont wouldnt"
).split()

# White space that Java's \\s leaves out; the first part rules letters out at once.
_RARE_BLANK = (
    r"[\x1c-\x1f\x85-\u3000&&"
    r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
# A mark that may be cut off one end of a word that has no other punctuation; named classes are matched much faster than ranges.
_MARK = r"""(?:!{1,3}|\?{1,3}|\?!\?!?|!\?!\??|[.,;:'"-])"""
_BARE = r"\P{Punct}{2,}+"
_MARKED_WORD = rf"\A{_MARK}{_BARE}\z|\A{_BARE}{_MARK}\z"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Rules:
    """Word lists and weights of the scorer."""

    intensifiers: tuple[str, ...] = tuple(INTENSIFIERS)
    diminishers: tuple[str, ...] = tuple(DIMINISHERS)
    negations: tuple[str, ...] = tuple(NEGATIONS)
    contrast: str = "but"
    degree: float = 0.293
    capitals: float = 0.733
    negation: float = -0.74
    # weight of a degree word one, two and three words before
    distance: tuple[float, float, float] = (1.0, 0.95, 0.9)
    before_contrast: float = 0.5
    after_contrast: float = 1.5
    exclamation: float = 0.292
    max_exclamations: int = 4
    question: float = 0.18
    max_questions: int = 3
    many_questions: float = 0.96
    normalizer: float = 15.0
    # Several words that count as one; without any, words count singly.
    phrases: tuple[Phrase, ...] = ()
    decimals: int = 4
    # Largest dictionary that travels inside the plan; above it, a join.
    max_inline_words: int = field(default=20_000, compare=False)
    # Largest dictionary that is broadcast to the words; above it, a shuffle.
    max_broadcast_words: int = field(default=MAX_BROADCAST_ROWS, compare=False)


ENGLISH = Rules()
_MARKS = "array<struct<i: int, v: double, b: double, g: boolean, u: boolean, k: boolean>>"

# Phrases named by the published description and its public word list (MIT licence).
_IDIOMS = {
    "the bomb": 3.0, "bad ass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0,
    "beating heart": 3.1, "broken heart": -2.9, "cut the mustard": 2.0, "hand to mouth": -2.0, "back handed": -2.0,
    "blow smoke": -2.0, "upper hand": 1.0, "break a leg": 2.0, "cooking with gas": 2.0, "in the black": 2.0,
    "in the red": -2.0, "on the ball": 2.0, "under the weather": -2.0,
}
_DEGREES = {"kind of": -0.293, "sort of": -0.293, "just enough": -0.293}
_STRENGTHENED = {"never so": 0.293, "never this": None}
_NO_NEGATION = ("without doubt", "without a doubt", "at least", "very least")

ENGLISH_PHRASES = (
    *(Phrase(tuple(k.split()), v=v) for k, v in _IDIOMS.items()),
    *(Phrase(tuple(k.split()), b=b) for k, b in _DEGREES.items()),
    *(Phrase(tuple(k.split()), b=b, e=1.25) for k, b in _STRENGTHENED.items()),
    *(Phrase(tuple(k.split())) for k in _NO_NEGATION),
    Phrase(("least",), g=True),
)
#: English with idioms, degree phrases, "never so", "least" and "without doubt".
ENGLISH_WITH_PHRASES = replace(ENGLISH, phrases=ENGLISH_PHRASES)


def words(text: Column) -> Column:
    """Words of two or more characters, one outer punctuation mark cut off."""
    plain = F.when(
        text.rlike(_RARE_BLANK), F.regexp_replace(text, _RARE_BLANK, " ")
    ).otherwise(text)
    tokens = F.regexp_extract_all(plain, F.lit(r"\S{2,}"), F.lit(0))
    # Most words have no outer punctuation and never meet the pattern; one that
    # meets it has a mark at one end only, so trimming leaves the word.
    bare = lambda t: F.btrim(t, F.lit(_PUNCTUATION))
    return F.transform(
        tokens,
        lambda t: F.when((bare(t) != t) & t.rlike(_MARKED_WORD), bare(t)).otherwise(t),
    )


def dictionary(lexicon: DataFrame, rules: Rules) -> DataFrame:
    """``tok, v, b, g``: valence, degree and negation of each known word."""
    degree = dict.fromkeys(rules.diminishers, -rules.degree)
    degree |= dict.fromkeys(rules.intensifiers, rules.degree)
    listed = [
        (w, None, degree.get(w), w in rules.negations)
        for w in sorted({*degree, *rules.negations})
    ]
    known = lexicon.sparkSession.createDataFrame(
        listed, "tok string, v double, b double, g boolean"
    )
    valences = lexicon.select(
        F.lower("tok").alias("tok"),
        F.col("val").cast("double").alias("v"),
        F.lit(None).cast("double").alias("b"),
        F.lit(False).alias("g"),
    ).where(F.col("v").isNotNull())
    # a word listed twice has the mean of its valences
    return valences.unionByName(known).groupBy("tok").agg(
        F.avg("v").alias("v"), F.max("b").alias("b"), F.max("g").alias("g")
    )


def _inline_lookup(rows: list[Row]):
    """Lookup by literal: the dictionary as an array of small maps.

    A word's map is picked by its hash, so a lookup compares a handful of keys
    (a single map would be searched from end to end).
    """
    size = max(1, 2 * len(rows))
    slots: list[dict] = [{} for _ in range(size)]
    for r in rows:
        slots[r.hash % size][r.tok] = {"v": r.v, "b": r.b, "g": r.g}
    table = F.from_json(
        F.lit(json.dumps(slots)),
        "array<map<string, struct<v: double, b: double, g: boolean>>>",
    )

    def lookup(word: Column) -> Column:
        slot = F.pmod(F.xxhash64(word), F.lit(size)).cast("int")
        return F.get(table, slot)[word]

    return lookup


def _mark(position: Column, loud: Column, lower: Column, known: Column, rules: Rules) -> Column:
    """A word as the rules see it: place, valence, degree, negation, capitals, contrast."""
    return F.struct(
        position.alias("i"),
        known["v"].alias("v"),
        known["b"].alias("b"),
        (F.coalesce(known["g"], F.lit(False)) | lower.contains("n't")).alias("g"),
        loud.alias("u"),
        (lower == rules.contrast).alias("k"),
    )


def _in_capitals(word: Column, lower: Column) -> Column:
    return (word != lower) & (word == F.upper(word))


def _acts_by_itself(lower: Column, rules: Rules) -> Column:
    """Words that the rules act on whether or not the dictionary has them."""
    return lower.contains("n't") | (lower == rules.contrast)


def _marks_inline(tokens: Column, lowered: Column, lookup, rules: Rules) -> Column:
    """Marks of the acting words only; nothing is built for the others."""
    places = F.when(F.size(lowered) > 0, F.sequence(F.lit(0), F.size(lowered) - 1))

    def acts(i: Column) -> Column:
        lower = F.get(lowered, i)
        return lookup(lower).isNotNull() | _acts_by_itself(lower, rules)

    def mark(i: Column) -> Column:
        lower = F.get(lowered, i)
        return _mark(i, _in_capitals(F.get(tokens, i), lower), lower, lookup(lower), rules)

    return F.transform(F.filter(places, acts), mark)


def _marks_joined(reviews: DataFrame, key: list[str], entries: DataFrame, rules: Rules) -> DataFrame:
    """``key`` and ``_marks`` by a join, for a dictionary too large for the plan.

    A dictionary of up to ``rules.max_broadcast_words`` words is broadcast, so
    words are not shuffled.  A larger one is first cut down to the words that
    the texts have: each task gives out a word once, however frequent it is.
    What is left is broadcast if it is short enough; else the words are
    shuffled, frequent ones over salts, and only their entries are repeated.
    Either way only acting words are gathered again.
    """
    cut = reviews.select(*key, F.posexplode("_tokens").alias("pos", "t")).withColumn("l", F.lower("t"))
    tokens = cut.withColumn("u", _in_capitals(F.col("t"), F.col("l"))).drop("t")
    listed = entries.withColumnRenamed("tok", "l")
    if not fits(listed, rules.max_broadcast_words):
        listed = staged(listed.join(tokens.select("l").distinct(), "l", "left_semi"), "words-in-use")
    if fits(listed, rules.max_broadcast_words):
        joined = tokens.join(F.broadcast(listed), "l", "left")
    else:
        dealt, copies = spread(tokens, listed, ["l"], [*key, "pos"])
        joined = dealt.join(copies, ["l", "_salt"], "left")
    known = F.struct("v", "b", "g")
    acting = F.col("v").isNotNull() | F.col("b").isNotNull() | F.col("g") | _acts_by_itself(F.col("l"), rules)
    mark = _mark(F.col("pos"), F.col("u"), F.col("l"), known, rules)
    # one group is the acting words of one text
    gathered = joined.where(acting).groupBy(*key).agg(F.array_sort(F.collect_list(mark)).alias("_marks"))
    return gathered


def _outside(tokens: Column, kept: Column) -> Column:
    """The tokens with null in the place of those inside a kept phrase; each is gone through once."""
    ended = lambda j: F.coalesce(F.get(kept, j)["start"] - F.get(kept, j)["less"], F.lit(0))

    def up_to(p: Column, j: Column) -> Column:
        before = F.slice(tokens, ended(j - 1) + 1, p["start"] - ended(j - 1))
        return F.concat(before, F.array_repeat(F.lit(None).cast("string"), -p["less"]))

    rest = ended(F.size(kept) - 1)
    return F.concat(F.flatten(F.transform(kept, up_to)), F.slice(tokens, rest + 1, F.size(tokens) - rest))


def _with_phrases(marks: Column, tokens: Column, kept: Column) -> Column:
    """Marks of the words outside of phrases, and of the last word of each phrase, which stands for the whole of it."""

    def of_phrase(p: Column) -> Column:
        raw = F.slice(tokens, p["start"] + 1, p["last"] - p["start"] + 1)
        loud = F.forall(raw, lambda t: _in_capitals(t, F.lower(t)))
        return F.struct(
            p["last"].alias("i"), p["v"].alias("v"), p["b"].alias("b"), p["g"].alias("g"), loud.alias("u"),
            F.lit(False).alias("k"), p["e"].alias("e"),
        )

    single = F.transform(
        F.coalesce(marks, F.array().cast(_MARKS)),
        lambda m: F.struct(*[m[c].alias(c) for c in "ivbguk"], F.lit(None).cast("double").alias("e")),
    )
    return F.array_sort(F.concat(single, F.transform(kept, of_phrase)))


def _contribution(marks: Column, j: Column, mixed_case: Column, rules: Rules) -> Column:
    """Valence of mark ``j`` after capitals, degree words and negation."""
    own = F.get(marks, j)
    zero = F.lit(0.0)
    shout = F.when(
        own["u"] & mixed_case,
        F.when(own["v"] > 0, rules.capitals).otherwise(-rules.capitals),
    ).otherwise(zero)
    start = own["v"] + shout
    reach = len(rules.distance)
    weights = F.array(*[F.lit(w) for w in rules.distance])

    def apply(valence: Column, m: Column) -> Column:
        weight = F.get(weights, own["i"] - m["i"] - 1)
        degree = F.when(valence < 0, -m["b"]).otherwise(m["b"])
        loud = F.when(
            m["u"] & mixed_case,
            F.when(valence > 0, rules.capitals).otherwise(-rules.capitals),
        ).otherwise(zero)
        shifted = valence + F.coalesce((degree + loud) * weight, zero)
        turned = F.when(m["g"], shifted * rules.negation)
        if rules.phrases:
            turned = turned.when(m["e"].isNotNull(), shifted * m["e"])
        turned = turned.otherwise(shifted)
        # a word with a valence of its own modifies nothing
        skipped = m.isNull() | m["v"].isNotNull() | (own["i"] - m["i"] > reach)
        return F.when(skipped, valence).otherwise(turned)

    nearest = F.get(marks, j - 1)
    before = F.array(*[F.get(marks, j - F.lit(k + 1)) for k in range(reach)])
    alone = nearest.isNull() | (own["i"] - nearest["i"] > reach)
    return F.when(alone, start).otherwise(F.aggregate(before, start, apply))


def _compound(
    text: Column, marks: Column, mixed_case: Column, turn: Column, rules: Rules
) -> Column:
    """Sum of all contributions, punctuation added, normalised and rounded.

    ``turn`` is the place of the first contrast word, null if there is none.
    """
    zero = F.lit(0.0)

    def add(total: Column, j: Column) -> Column:
        place = F.get(marks, j)["i"]
        weight = (
            F.when(place < turn, rules.before_contrast)
            .when(place > turn, rules.after_contrast)
            .otherwise(1.0)
        )
        contribution = weight * _contribution(marks, j, mixed_case, rules)
        has_valence = F.get(marks, j)["v"].isNotNull()
        return F.when(has_valence, total + contribution).otherwise(total)

    places = F.transform(marks, lambda m, j: j)
    total = F.aggregate(places, zero, add)
    emphasis = _emphasis(text, rules)
    loud = F.transform(
        F.array(total),
        lambda s: F.when(s > 0, s + emphasis).when(s < 0, s - emphasis).otherwise(zero),
    )
    return F.transform(
        loud,
        lambda s: F.round(s / F.sqrt(s * s + F.lit(rules.normalizer)), rules.decimals),
    )[0]


def _count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _emphasis(text: Column, rules: Rules) -> Column:
    exclamations = F.least(_count_of(text, "!"), F.lit(rules.max_exclamations))
    questions = _count_of(text, "?")
    asked = (
        F.when(questions <= 1, F.lit(0.0))
        .when(questions <= rules.max_questions, questions * rules.question)
        .otherwise(F.lit(rules.many_questions))
    )
    return exclamations * rules.exclamation + asked


def lexicon_score(
    reviews: DataFrame,
    lexicon: DataFrame,
    key: list[str],
    text: str = "review_text",
    rules: Rules = ENGLISH,
) -> DataFrame:
    """``reviews`` with ``sentiment_score``; blank texts score 0.

    A dictionary of up to ``rules.max_inline_words`` words travels inside the
    plan and every review is scored in place: no shuffle, no join back.  A
    larger one is joined word by word over the unique ``key`` of a review.
    Both give the same scores; only the plan differs.
    """
    entries = dictionary(lexicon, rules)
    body = F.coalesce(F.col(text), F.lit(""))
    # reads one row more than may travel inline, never the whole of a large table
    few = entries.withColumn("hash", F.xxhash64("tok")).take(rules.max_inline_words + 1)
    cut = reviews.withColumn("_tokens", words(body))
    capitals = lambda t: _in_capitals(t, F.lower(t))
    # Facts about the whole text, worked out once and not again per word.
    mixed = F.exists("_tokens", capitals) & F.exists("_tokens", lambda t: ~capitals(t))
    cut = cut.withColumn("_mixed", mixed)
    book = PhraseBook(rules.phrases)
    if rules.phrases:
        found = book.found(reviews.sparkSession, F.transform("_tokens", F.lower))
        cut = cut.withColumn("_kept", leftmost_longest(found)).withColumn("_spoken", F.col("_tokens"))
        # A phrase's own words count for nothing.
        cut = cut.withColumn("_tokens", _outside(F.col("_spoken"), F.col("_kept")))
    if len(few) <= rules.max_inline_words:
        cut = cut.withColumn("_lowered", F.transform("_tokens", F.lower))
        acting = _marks_inline(F.col("_tokens"), F.col("_lowered"), _inline_lookup(few), rules)
        known = cut.withColumn("_marks", acting).drop("_tokens", "_lowered")
    else:
        # Words are cut once: the passes over them and the texts that meet their marks read the written table.
        cut = staged(cut, "tokens")
        # the key is matched as it is grouped: null equals null
        marks = _marks_joined(cut, key, entries, rules)
        known = matched(cut.drop("_tokens"), marks, key, "left")
    if rules.phrases:
        whole = _with_phrases(F.col("_marks"), F.col("_spoken"), book.values(F.col("_kept")))
        known = known.withColumn("_marks", whole).drop("_kept", "_spoken")
    turned = known.withColumn(
        "_turn", F.get(F.filter("_marks", lambda m: m["k"]), F.lit(0))["i"]
    )
    compound = _compound(body, F.col("_marks"), F.col("_mixed"), F.col("_turn"), rules)
    score = F.when(F.size("_marks") > 0, compound)
    return turned.withColumn("sentiment_score", F.coalesce(score, F.lit(0.0))).drop(
        "_marks", "_mixed", "_turn"
    )


def phrase_spans(
    reviews: DataFrame, phrases: tuple[Phrase, ...], text: str = "review_text"
) -> DataFrame:
    """``reviews`` with ``n_found``, all occurrences of the phrases, overlapping ones too, and ``spans``.

    ``spans`` are the ``start``, ``length`` and words of those that count: from the left, the longest at each place,
    none over another.  Places are numbers of words as ``words`` cuts them.
    """
    book = PhraseBook(phrases)
    tokens = F.transform(words(F.coalesce(F.col(text), F.lit(""))), F.lower)
    cut = reviews.withColumn("_lowered", tokens).withColumn("_found", book.found(reviews.sparkSession, F.col("_lowered")))
    spans = F.transform(
        leftmost_longest(F.col("_found")),
        lambda m: F.struct(
            m["start"].alias("start"), (-m["less"]).alias("length"),
            F.array_join(F.slice("_lowered", m["start"] + 1, -m["less"]), " ").alias("phrase"),
        ),
    )
    return cut.withColumn("n_found", F.size("_found")).withColumn("spans", spans).drop("_lowered", "_found")


def with_label(scored: DataFrame) -> DataFrame:
    return scored.withColumn("sentiment_label", sentiment_label(F.col("sentiment_score")))
