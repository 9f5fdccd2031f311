"""The pipeline against its stages' own rules on a small table."""

import os

import numpy as np
import pytest

import corpus_pipeline as p
from floodspark.llm import decontaminate, language_id, queries, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    told = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.fit(docs.select("doc_id", "text", "lang"))).collect()}
    one = p.common.stored(p.identify_language(spark, docs, SF))
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, k in told.items() if k != "und"}
    two = p.common.stored(p.drop_near_duplicates(spark, one, SF))
    leads = {r.component_id for r in simhash.near_duplicates(one).collect()}
    assert two.columns == columns and {r.doc_id for r in two.collect()} == leads
    rows = two.collect()
    gone = suffix_dedup.brute_force([r.text.encode() for r in rows])
    want = {r.doc_id: np.frombuffer(r.text.encode(), np.uint8)[~g].tobytes().decode("utf-8", "ignore") for r, g in zip(rows, gone)}
    three = p.common.stored(p.cut_repeats(spark, two, SF))
    assert three.columns == columns and {r.doc_id: r.text for r in three.collect()} == want
    assert all(r.n_chars == len(r.text) for r in three.collect() if len(r.text) != len(next(x.text for x in rows if x.doc_id == r.doc_id)))
    four = p.common.stored(p.decontaminate_benchmark(spark, three, SF))
    hits = {r.doc_id for r in decontaminate.matches(three, queries.table(spark, SF, "benchmark")).filter("n_hit > 0").collect()}
    assert four.columns == columns and {r.doc_id for r in four.collect()} == set(want) - hits
    five = p.encode(spark, four, SF).collect()
    assert {r.doc_id: r.decoded for r in five} == {i: t for i, t in want.items() if i not in hits}


def test_stage_list():
    assert [f for _, f in p.STAGES] == [p.identify_language, p.drop_near_duplicates, p.cut_repeats, p.decontaminate_benchmark, p.encode]
