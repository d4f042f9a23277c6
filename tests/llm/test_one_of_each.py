"""One document of each component stays, whatever the ids are."""

from revlume.llm import op7_lsh_forest as op7
from tests.llm.awkward import documents, sentence


def test_null_and_shared_ids(spark):
    base = sentence(5, 80).split()
    other = sentence(31, 80).split()
    near = lambda words, k: " ".join([*words[:k], f"changed{k}", *words[k + 1 :]])
    rows = [(None, near(base, k), "en", "s") for k in (0, 10, 20, 30, 40)]
    rows += [(7, near(other, k), "en", "s") for k in (0, 15, 30)] + [(9, near(other, 45), "en", "s")] * 2
    rows += [(None, "", "en", "s"), (None, None, "en", "s"), (3, sentence(77, 30), "en", "s"), (3, sentence(77, 30), "en", "s")]
    kept = op7.one_of_each(documents(spark, rows)).collect()
    texts = [r.text for r in kept]
    assert sum(bool(t) and t in {x[1] for x in rows[:5]} for t in texts) == 1
    assert [r.doc_id for r in kept if r.text in {x[1] for x in rows[5:10]}] == [7]
    assert sum(r.doc_id == 3 for r in kept) == 1 and sum(not t for t in texts) == 2 and len(kept) == 5
