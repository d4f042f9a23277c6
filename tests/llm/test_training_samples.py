"""What classifiers learn from: bounded as a whole, no text passed over for its length, no held-out label."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from revlume.llm import op5_char_nb_toxicity as op5
from revlume.llm.labelled import training_sample
from tests.llm.awkward import documents, order, sentence


def long_toxic(spark):
    rows = [(k, ("vile grelk snarp " * 2200 if k % 2 else sentence(k, 40)), "en", "s") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    return documents(spark, rows), labels


def test_long_texts_are_learnt_from(spark):
    docs, labels = long_toxic(spark)
    model = op5.train(docs, labels)
    got = op5.score_toxicity(docs, model).select("row.doc_id", "score").collect()
    assert model.constant is None and all((r.score >= op5.TOXIC) == (r.doc_id % 2 == 1) for r in got)


def test_a_class_ends_where_its_texts_reach_the_bound(spark):
    docs, labels = long_toxic(spark)
    sample, counts = training_sample(docs, labels, "toxic", 3, 1, {0: 60, 1: 60}, 100_000)
    rows = sample.collect()
    # three texts of 37,400 characters reach 100,000; short ones do not, and all sixty stay
    assert sum(r.y for r in rows) == 3 and sum(1 - r.y for r in rows) == min(60, counts[0])
    tiny, _ = training_sample(docs, labels, "toxic", 3, 1, {0: 60, 1: 60}, 1)
    assert sorted(r.y for r in tiny.collect()) == [0, 1]


def test_toxic_labels_of_the_held_out_fold_are_not_learnt(spark):
    docs, labels = long_toxic(spark)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (op5.score_toxicity(docs, op5.train(docs, x)).select("row.doc_id", "score") for x in (labels, turned))
    assert order(map(tuple, a.collect())) == order(map(tuple, b.collect()))
    assert any(zlib.crc32(str(k).encode()) % 3 == 1 for k in range(200))


def plain_features(text):
    """The features of a text, one n-gram at a time."""
    chars, out = [ord(c) for c in text.lower()], set()
    for n in (4, 5, 6):
        for i in range(len(chars) - n + 1):
            value = n * 0x9E3779B1 & 0xFFFFFFFF
            for c in chars[i : i + n]:
                value = (value ^ c) * 0x01000193 & 0xFFFFFFFF
                value ^= value >> 15
            out.add((value * 0x85EBCA6B & 0xFFFFFFFF) >> 12)
    return sorted(out)


@pytest.mark.parametrize("step", [7, 1 << 20])
def test_features_and_scores_one_by_one(spark, monkeypatch, step):
    monkeypatch.setattr(op5, "STEP", step)
    docs, labels = long_toxic(spark)
    model = op5.train(docs, labels)
    for text in ["", "abc", "Vile GRELK snarp", sentence(3, 30), "ÄÖ日本 \U0001f600 vile", "vile grelk " * 9]:
        found = plain_features(text)
        assert op5.features(text).tolist() == found
        z = sum(float(model.weights[f]) for f in found if model.used[f]) + model.bias
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
