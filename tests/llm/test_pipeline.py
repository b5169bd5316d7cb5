"""The pipeline stage by stage, and the registered queries."""

import collections

import __spark_entry__ as entry
import corpus_pipeline
from conftest import DATA
from tidebook.llm import jaccard, lines, mixing, quality
from tidebook.llm.common import materialize


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], DATA), "test-" + name.replace(" ", "-")))
    raw, good, clean, single, mixed, packed = seen
    assert all(s.columns == columns for s in seen[:-1])
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = quality.scores(raw, quality.fit(raw, labels))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    report = {r.doc_id: r.kept_chars for r in lines.line_report(good).collect()}
    assert {r.doc_id: len(r.text or "") for r in clean.collect()} == report
    groups = jaccard.similar_documents(clean).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.doc_id for r in groups if r.doc_id == r.component_id)
    assert collections.Counter(map(tuple, mixed.collect())) == collections.Counter(map(tuple, single.collect()))
    pieces = collections.defaultdict(int)
    for r in packed.collect():
        pieces[r.doc_id] += r.length
    assert {r.doc_id: r.doc_tokens for r in packed.collect()} == dict(pieces) and set(pieces) == {r.doc_id for r in mixed.collect()}


def test_packing_follows_the_mix(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    of = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    a, b = sorted({s for s in of.values() if s})[:2]

    def order(weights):
        dealt = materialize(mixing.mixed(docs, weights, block_chars=500), "test-dealt")
        first = {}
        for r in corpus_pipeline.STAGES[-1][1](spark, dealt, DATA).collect():
            first[r.doc_id] = min(first.get(r.doc_id, r.sequence_id), r.sequence_id)
        return {s: sum(first[d] for d in of if of[d] == s) / sum(v == s for v in of.values()) for s in (a, b)}, first

    (early, one), (late, two) = order({a: 9.0, b: 0.1}), order({a: 0.1, b: 9.0})
    assert one != two and early[a] < late[a] and early[b] > late[b]


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5
