"""Phrase mining, packing and fill-in-the-middle: on awkward tables, against plain restatements."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revlume.llm.op8_hilbert_shards import hilbert_index
from revlume.llm.op11_phrase_counting import _count, _sent, collocations, flattened, located, phrase_counts
from revlume.llm.op12_curve_packing import Sequences, on_curve, packed, placed, sequences, token_ids, tokenised
from revlume.llm.op13_fill_in_middle import BlockTree, fill_in_middle, restored
from tests.llm.awkward import check_packing, documents, order, plain_ids, texts

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b.", "B", " ", "  ", "\n", "\t", " ", "　", "é", "日本", "\U0001f600", "'s", "1,2", "x" * 40, "\x0b", " y", "end "]


def odd_texts(n, seed, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(most))) for _ in range(n)]


# Phrases


def mined(rows, least, top, inside=100, longest=5):
    """Collocations of (lang, text) rows by plain counting."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    around = Counter()
    for p, a in candidates.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                key = (p[0], *p[i : i + m])
                around[key] = max(around[key], a)
    out = defaultdict(list)
    for p, a in candidates.items():
        if p in around and 100 * around[p] >= inside * a:
            continue
        lang, words, n = p[0], p[1:], totals[p[0]]
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1000 * a * n // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), left, right, n))
    return [
        (lang, i + 1, phrase.decode(), -a, left, right, n, -score)
        for lang, rows in out.items()
        for i, (score, a, phrase, left, right, n) in enumerate(sorted(rows)[:top])
    ]


def phrase_rows(seed=3):
    rng = random.Random(seed)
    words = "Alpha beta gamma delta eps zeta".split()
    rows = []
    for i in range(160):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]) for _ in range(rng.randrange(30)))
        rows.append((i, rng.choice([text, text + "one two three four five six. "]), rng.choice(["en", None, "und", "日"])))
    return rows + [(None, None, "en"), (5, "", None), (6, " .,\n", "fr"), (7, "é" * 70000 + " lone", "fr")]


@pytest.mark.parametrize("least, shards, slots", [(4, 1, 31), (6, 3, 10_007), (40, 4, 31)])
def test_phrases(spark, least, shards, slots):
    rows = phrase_rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, shard int, body string")
    got = collocations(frame, least=least, top=25, shards=shards, slots=slots)
    assert order(tuple(r) for r in got.collect()) == order(mined([(lang, t) for _, t, lang in rows], least, 25))


def test_phrases_of_awkward_table(spark):
    rows = [(lang, t) for _, t, lang, _ in texts()]
    got = collocations(documents(spark), least=5, top=3000, inside_percent=60, slots=100_003)
    assert order(tuple(r) for r in got.collect()) == order(mined(rows, 5, 3000, inside=60))
    assert collocations(documents(spark).limit(0), slots=31).collect() == []


def test_lengths_are_interleaved_and_each_goes_round_once(spark):
    rows = [(i, "one two three four five. " * 4 + f"n{i}", "en") for i in range(60)]
    rows += [(100 + i, "rare pair", "en") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    flat = flattened(frame, 3)
    counts = {r.phrase: r.n for r in phrase_counts(flat, 3, 10, 3, 100_003, seen=seen).collect()}
    assert counts["one two three"] == 240 and counts["rare pair"] == 12 and "five one" not in counts
    assert [shard for _, shard, _, _ in seen] == [scan % 3 for scan in range(len(seen))]
    reached = {length: scan for scan, _, _, lengths in reversed(seen) for length in lengths}
    # A longer phrase is open only after its parts were seen often enough, and while shorter ones are still counted.
    assert reached[1] < reached[2]
    counted = {scan: set(lengths) for scan, _, lengths, _ in seen}
    assert counted[0] == {1} and {1, 2} <= counted[1] and any({2, 3} <= c for c in counted.values())


@pytest.mark.parametrize("bits", [3, 9, 60])
def test_phrases_that_share_a_number_are_told_apart(spark, bits):
    rows = [(lang, t) for _, t, lang in phrase_rows()]
    frame = spark.createDataFrame(rows, "lang string, text string")
    got = {(r.lang, r.phrase): r.n for r in phrase_counts(flattened(frame), 5, 4, slots=10_007, bits=bits).collect()}
    counts = Counter()
    for lang, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts.update((lang or "und", " ".join(words[i : i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    assert got == {p: n for p, n in counts.items() if n >= 4}


def test_words_of_a_number_are_given_out_once_however_many_tasks_have_them(spark):
    rows = [(f"one two three. n{i}", "en") for i in range(64)]
    flat = flattened(spark.createDataFrame(rows, "text string, lang string").repartition(8)).repartition(16).cache()
    assert flat.select("block").distinct().count() == 8
    parts = list(flat.select("lang", "body", "block").mapInArrow(_count_all(spark), "number long, since short, n long, check long, block int").collect())
    assert len(parts) > 6 * 8
    passed = spark.createDataFrame([r for r in parts if r.n > 1], "number long, since short, n long, check long, block int")
    found = located(flat, passed, 3).collect()
    assert sorted((r.phrase, r.n) for r in found if r.sure and r.n == 64) == [(p, 64) for p in ["one", "one two", "one two three", "three", "two", "two three"]]
    # A wrong sum of checks is noticed.
    assert not any(r.sure for r in located(flat, passed.withColumn("check", F.col("check") + 1), 3).collect())
    flat.unpersist()


def _count_all(spark):
    """Counts of all phrases of up to three words, as a scan gives them out."""
    return _count(_sent(spark, np.zeros(10_007, np.uint8)), 0, 1, [1, 2, 3])


# Packing


def test_ids_are_those_of_the_tokenizer():
    with open(TOKENIZER, encoding="utf-8") as file:
        told = file.read()
    given = [*odd_texts(1500, 1), "Word\nNext word.\nEnd", "a'st b's c'\n'll", "x.\r\ny", "a,b;'re (c) 'd' \n", "é.\né's", "z" * 5000, " " * 3000 + "x", "“quoted” – it’s…", "".join(map(chr, range(0x20, 0x280))), "", None, "don't  stop the 's", "a b", " a", "a ", "<|endoftext|> a<|endoftext|>", "é é日 本 \U0001f600 \U0001f600 x"]
    ids, first = token_ids(pa.array(given, pa.string()), told)
    for i, text in enumerate(given):
        assert ids[first[i] : first[i + 1]].tolist() == plain_ids(text)[:-1], repr(text)


@pytest.mark.parametrize("total", [0, 1, 5, 16, 17, 31, 47, 48])
def test_sequences_of_a_total(total):
    plan = Sequences(total, 16)
    numbers = plan.number(np.arange(total))
    sizes = Counter(numbers.tolist())
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == 16 or n & (n - 1) == 0 for n in sizes.values())
    assert all(plan.start(np.array([s]))[0] == numbers.tolist().index(s) for s in sizes)


@pytest.mark.parametrize("length", [64, 1024])
def test_packing(spark, length):
    parts = packed(documents(spark), TOKENIZER, length)
    rows = parts.select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()
    check_packing([(i, t) for i, t, _, _ in texts()], [tuple(r) for r in rows], length)
    whole = sequences(parts, length).collect()
    assert all(r.n_tokens * 4 == len(r.ids) and r.padded == r.n_tokens and r.starts[0] == 0 for r in whole)
    assert sum(r.n_tokens for r in whole) == sum(r[2] for r in rows)
    assert packed(documents(spark).limit(0), TOKENIZER).collect() == []


def test_packing_follows_the_curve(spark):
    rows, wide = tokenised(documents(spark), TOKENIZER)
    assert not wide
    keyed = on_curve(rows)
    places, total = placed(keyed)
    found = keyed.join(places, "row").orderBy("place").collect()
    assert [r.curve for r in found] == sorted(r.curve for r in found) and len(found) == len(texts())
    at = 0
    for r in found:
        assert r.place == at
        at += r.doc_tokens
    assert at == total
    # equal texts stand on one place of the curve, and the curve is that of the quantised vectors
    assert len({r.curve for r in found if r.doc_id is not None and r.doc_id >= 100}) == 1
    z = np.array([[r[f"z{d}"] for d in range(4)] for r in found], float)
    cells = np.clip(np.floor((z - z.mean(0)) * 256 / (6 * z.std(0))) + 128, 0, 255).astype(int)
    assert [r.curve for r in found] == hilbert_index(cells, 8).tolist()


def test_ids_may_be_text(spark):
    frame = documents(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert packed(frame, TOKENIZER).agg(F.sum("length")).first()[0] == sum(len(plain_ids(t)) for _, t, _, _ in texts())
    assert fill_in_middle(frame).where("doc_id = 'd14'").first().n == len(texts()[14][1])


# Fill-in-the-middle


def transformed(doc_id, text, seed=1):
    """form, prefix and middle lengths, and output, by code points."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middle(spark):
    marked = [(i, t, "en", "s") for i, t in enumerate(["<P>", "x<S>y", "<M", "<", "a<P", ">", "S>b", "<P<S><M>"] + odd_texts(150, 4), 1000)]
    rows = texts() + marked
    frame = spark.createDataFrame([(i, t, 7, "kept") for i, t, _, _ in rows], "doc_id long, text string, n int, form string").withColumn("more", F.lit(1))
    cut = fill_in_middle(frame)
    assert cut.columns == ["doc_id", "text", "more", "output", "form", "n_units", "n", "prefix_chars", "middle_chars"]
    got = cut.select("doc_id", "text", "form", "prefix_chars", "middle_chars", "output", "n", restored(F.col("output"), F.col("form")).alias("back"))
    found = got.collect()
    assert all(r.back == (r.text or "") and r.n == len(r.text or "") for r in found)
    assert order(tuple(r)[:6] for r in found) == order((i, t, *transformed(i, t)) for i, t, _, _ in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle(frame.limit(0)).collect() == []


@pytest.mark.parametrize("unit", ["word", "line"])
def test_middle_by_other_units(spark, unit):
    frame = spark.createDataFrame([(i, t) for i, t, _, _ in texts()] + list(enumerate(odd_texts(80, 9), 500)), "doc_id long, text string")
    cut = fill_in_middle(frame, unit, ("[pre]", "{suf}", "(mid)"), seed=3, plain_percent=0)
    cut = cut.withColumn("back", restored(F.col("output"), F.col("form"), ("[pre]", "{suf}", "(mid)")))
    for r in cut.collect():
        text = r.text or ""
        assert r.back == text
        ends = [m.end() for m in re.finditer(r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+[\x20\x09-\x0d]*(?![\x20\x09-\x0d])" if unit == "word" else r"[^\n]*\n|[^\n]+\Z", text)]
        if unit == "line" and text.endswith("\n"):
            assert r.n_units == len(ends)
        if r.form != "plain" and ends:
            assert r.prefix_chars in (0, *ends, len(text)) and r.prefix_chars + r.middle_chars in (0, *ends, len(text))


@pytest.mark.parametrize("unit", ["code_point", "word", "line"])
def test_descent_finds_every_unit(unit):
    for text in [*odd_texts(40, 2, 400), "", "one", "\n\n", "  lead"]:
        data = np.frombuffer(text.encode(), np.uint8)
        for block in (1, 7, 256):
            tree = BlockTree(data, unit, block)
            begins = np.flatnonzero(tree.unit)
            points = np.cumsum((data & 0xC0) != 0x80) if len(data) else np.zeros(0, int)
            wanted = [int(points[b]) - 1 for b in begins] + [len(text)]
            assert [tree.code_points_before(k) for k in range(len(begins) + 1)] == wanted


def test_marks_that_could_meet_are_refused(spark):
    with pytest.raises(ValueError):
        fill_in_middle(documents(spark), marks=("<<", "<S>", "<M>"))
    with pytest.raises(ValueError):
        fill_in_middle(documents(spark), marks=("", "b", "c"))
    with pytest.raises(ValueError):
        packed(documents(spark), TOKENIZER, 100)
