"""Scoring of a review table by lexicon or model."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

from revlume.operators.model import model_score
from revlume.operators.sentiment import ENGLISH_WITH_PHRASES, Rules, lexicon_score, with_label

log = logging.getLogger(__name__)

Scorer = Callable[[DataFrame], DataFrame]


def choose_scorer(
    lexicon: DataFrame,
    key: list[str],
    load_model: Callable | None = None,
    rules: Rules = ENGLISH_WITH_PHRASES,
) -> tuple[Scorer, str]:
    """The scorer to use and its name.

    A model is preferred when one is given; if it cannot be loaded here, the
    lexicon takes over.  ``key`` names the columns that tell reviews apart; it
    is asked for whatever the size of the lexicon.
    """
    if load_model is not None:
        try:
            load_model()
        except Exception as error:
            log.warning("model unavailable, scoring by lexicon: %s", error)
        else:
            return (lambda df: model_score(df, load_model)), "model"
    return (lambda df: lexicon_score(df, lexicon, key, rules=rules)), "lexicon"


def analyze_reviews(reviews: DataFrame, scorer: Scorer) -> DataFrame:
    """Every review with ``sentiment_score`` and ``sentiment_label`` added."""
    return with_label(scorer(reviews))
