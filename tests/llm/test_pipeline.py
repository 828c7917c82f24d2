"""Each stage of the pipeline against brute force on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from quern.llm import quality
from quern.llm.common import Workspace, table
from tests.llm.test_near_dedup import shingles, similar
from tests.llm.test_queries import lines_left, quality_base, rejected


@pytest.fixture(scope="module")
def stages(spark, odd_dir):
    docs, workspace, out = table(spark, odd_dir, "documents"), Workspace(spark, "test"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = workspace.materialise(stage(spark, docs, odd_dir), f"s{k}")
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def ids(frame):
    return Counter(r["doc_id"] for r in frame.select("doc_id").collect())


def test_names_and_columns(stages, odd_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "source mixing", "byte-level bpe"]
    for name, (before, after) in stages.items():
        assert before.columns == odd_docs.columns
        if name != "byte-level bpe":
            assert after.columns == odd_docs.columns


def test_quality_rejects_the_base_and_the_rules(spark, odd_dir, stages):
    before, after = stages["quality rules"]
    rules = quality.learn_rules(before, table(spark, odd_dir, "labels"))
    want = Counter()
    for r in before.select("doc_id", "text").collect():
        want[r["doc_id"]] += not quality_base(r["text"])[5] and not rejected(r["text"], rules)
    assert ids(after) == Counter({k: v for k, v in want.items() if v})


def test_lines_go_and_rows_stay(stages):
    before, after = stages["line dedup"]
    assert ids(before) == ids(after)
    rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    gone = lines_left(rows)
    want = {row: "\n".join(x for k, x in enumerate((row[1] or "").split("\n")) if k not in gone[row]) for row in rows}
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in after.collect()) == Counter((i, want[i, t], len(want[i, t])) for i, t in rows)


def test_one_of_each_group_stays(stages):
    """Groups of five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    before, after = stages["simhash near-dedup"]
    rows = [(r["doc_id"], shingles(r["text"])) for r in before.select("doc_id", "text").collect()]
    groups: list[list] = []
    for row in rows:
        near = [g for g in groups if any(similar(row[1], own) for _, own in g)]
        groups = [g for g in groups if g not in near] + [[row, *(x for g in near for x in g)]]
    assert set(ids(after)) == {min((i for i, _ in g if i is not None), default=None) for g in groups}


def test_mix_takes_copies_of_what_there_is(stages):
    before, after = stages["source mixing"]
    given, taken = ids(before), ids(after)
    assert set(taken) <= set(given) and all(n <= 2 * given[i] for i, n in taken.items())


def test_every_copy_is_encoded(spark, odd_dir, stages):
    before, after = stages["byte-level bpe"]
    assert ids(before) == ids(after)
    assert Counter(map(tuple, corpus_pipeline.run(spark, odd_dir).collect())) == Counter(map(tuple, after.collect()))


def test_empty(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
