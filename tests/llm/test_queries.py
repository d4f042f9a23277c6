"""The registered queries over the given tables: against their SQL, or against brute force."""

import glob
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from revlume.llm.queries import ORACLE, QUERIES
from tests.llm.awkward import check_packing, documents, near_groups, order, split_words, texts

CONTRACT = {
    "op1_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2_suffix_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3_attention_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_license_digests": "doc_id bigint, license string, n_lines bigint, notices string",
    "op5_char_nb_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_secret_index": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op7_lsh_forest": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_hilbert_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_kmeans_tree": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_recompression_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op11_phrase_counting": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_curve_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op13_fill_in_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    held = {}

    def of(name):
        if name not in held:
            frame = QUERIES[name](spark, sf_dir)
            held[name] = (frame.dtypes, frame.collect())
        return held[name]

    return of


def test_every_operator_has_its_query():
    assert set(QUERIES) == set(CONTRACT)


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_rows(results, con, name):
    types, rows = results(name)
    assert set(tuple(c.split()) for c in CONTRACT[name].split(", ")) <= set(types)
    if name not in ("op9_kmeans_tree", "op11_phrase_counting", "op12_curve_packing"):
        assert len(rows) == con.sql("SELECT count(*) FROM documents").fetchall()[0][0]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(results, con, name):
    types, rows = results(name)
    wanted = con.sql(ORACLE[name])
    columns = sorted(c for c, _ in types)
    assert sorted(wanted.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(tuple(r[k] for k in at) for r in wanted.fetchall())


def test_near_duplicates_against_all_pairs(results, con):
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in results("op7_lsh_forest")[1]]
    assert order(got) == order(near_groups(rows))


def test_pieces_hold_every_token_once(results, con):
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    check_packing([(i, t) for i, t in rows], [tuple(r) for r in results("op12_curve_packing")[1]])


def test_shards_hold_everything_in_order(results, con):
    texts_by_id = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    by = defaultdict(list)
    for r in results("op8_hilbert_shards")[1]:
        data = (texts_by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        by[r.shard].append(r)
    assert set(by) <= set(range(16))
    last = -1
    for shard in sorted(by):
        found = sorted(by[shard], key=lambda r: r.slot)
        assert [r.slot for r in found] == list(range(len(found)))
        assert last <= found[0].curve and [r.curve for r in found] == sorted(r.curve for r in found)
        last = found[-1].curve
    sizes = [sum(r.size for r in found) for found in by.values()]
    largest = max(len((t or "").encode()) + 1 for t in texts_by_id.values())
    assert max(sizes) - min(sizes) <= 2 * largest


def test_recall_against_brute_force(results, con):
    rows = con.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = defaultdict(list)
    for r in sorted(results("op9_kmeans_tree")[1], key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r)
    queries = ids[ids % 20 == 0]
    assert set(got) == set(queries.tolist())
    recall = []
    for q in queries.tolist():
        scores = points @ points[ids == q][0]
        other = ids != q
        best = ids[other][np.lexsort((ids[other], -scores[other]))[:20]]
        recall.append(len({r.vec_id for r in got[q]} & set(best.tolist())) / 20)
        assert [r["rank"] for r in got[q]] == list(range(1, 21))
        for r in got[q]:
            assert r.score == pytest.approx(float(scores[ids == r.vec_id][0]), abs=1e-12)
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize(("name", "label", "least"), [("op3_attention_quality", "quality", 0.95), ("op5_char_nb_toxicity", "toxic", 0.8)])
def test_held_out_documents_are_told_apart(spark, sf_dir, con, name, label, least):
    """Share of pairs of held-out documents of both labels that the scores put in order; more labels than sf0.001 has."""
    larger = f"{os.path.dirname(sf_dir)}/sf0.01"
    known = dict(con.sql(f"SELECT doc_id, {label} FROM '{larger}/labels.parquet'").fetchall())
    rows = [(r.score, known[r.doc_id]) for r in QUERIES[name](spark, larger).collect() if r.held_out and r.doc_id in known]
    one, zero = ([x for x, y in rows if y == label_] for label_ in (1, 0))
    assert len(one) > 10 and len(zero) > 10
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in zero] for a in one]) >= least


# The pipeline, stage by stage on what the one before kept


def test_stages(spark, sf_dir, con, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard", "slot"])
    labels = dict(con.sql("SELECT doc_id, quality FROM labels").fetchall())
    first = {r.doc_id for r in kept["quality"]}
    good = [i for i, y in labels.items() if y == 1]
    assert len(first & set(good)) >= 0.95 * len(good)
    groups = near_groups([(r.doc_id, r.text) for r in kept["quality"]])
    assert order(r.doc_id for r in kept["near_duplicates"]) == order(i for i, n, c, keep in groups if keep or not n)
    hit = dict(con.sql(f"SELECT doc_id, contaminated FROM ({ORACLE['op2_suffix_decontamination']})").fetchall())
    assert order(r.doc_id for r in kept["decontamination"]) == order(r.doc_id for r in kept["near_duplicates"] if not hit[r.doc_id])
    source, mixed = Counter(), Counter()
    for r in kept["decontamination"]:
        source[r.source] += len(split_words(r.text))
    for r in kept["mixing"]:
        mixed[r.source] += len(split_words(r.text))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(source))}
    longest = max(len(split_words(r.text)) for r in kept["decontamination"])
    level = max(sum(source.values()) / sum(weight.values()), 0)
    for s in source:
        if level * weight[s] < 2 * source[s]:  # far from the limit of three sizes
            assert mixed[s] >= level * weight[s] - 2 * longest
        assert mixed[s] <= 3 * source[s] + longest
    assert order((r.doc_id, r.text) for r in kept["sharding"]) == order((r.doc_id, r.text) for r in kept["mixing"])
    assert len({(r.shard, r.slot) for r in kept["sharding"]}) == len(kept["sharding"])


def test_stages_take_awkward_and_empty_tables(spark, sf_dir, tmp_path):
    for k, rows in enumerate((texts(), [])):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}{k}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        assert {"doc_id", "text", "shard", "slot", "row", "score"} <= set(docs.columns)
        assert rows or docs.count() == 0
