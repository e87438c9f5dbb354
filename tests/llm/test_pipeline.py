"""The pipeline's stages, each against what its operator says of the same input."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, neardup, quality
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(staged):
    assert all(d.columns == staged[0].columns for d in staged[1:-1])


def test_quality_stage(spark, staged):
    verdict = QUERIES["op1_quality_rules"](spark, SF)
    assert ids(staged[1]) == ids(verdict.where("kept")) and 0 < staged[1].count() < staged[0].count()


def test_one_document_of_each_class_stays(staged):
    classes = neardup.near_duplicates(staged[1], columns=["doc_id"])
    assert ids(staged[2]) == sorted(r.class_id for r in classes.select("class_id").distinct().collect())


def test_no_benchmark_passage_is_left(spark, staged):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    before = {r.doc_id: r for r in decontaminate.find_contamination(staged[2], bench).collect()}
    after = {r.doc_id: r for r in decontaminate.find_contamination(staged[3], bench).collect()}
    assert any(r.contaminated for r in before.values()) and not any(r.contaminated for r in after.values())
    assert {i for i, r in before.items() if r.n_hit <= 0.5 * r.n_words} == set(after)
    old, new = ({r.doc_id: r for r in d.collect()} for d in (staged[2], staged[3]))
    assert all(new[i].text == old[i].text for i in after if not before[i].contaminated)
    assert all(r.n_chars == len(r.text) for r in new.values())


def test_personal_data_is_gone(spark, staged):
    from tidemark.llm import pii

    assert staged[4].count() == staged[3].count()
    assert {r.spans for r in pii.find_personal_data(staged[4]).collect()} == {""}


def test_run_gives_the_last_stage(spark, staged):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, SF)
    assert ids(got.where("start = 0")) == ids(staged[4]) == ids(staged[5].where("start = 0"))
    assert got.select("doc_id", "doc_tokens").distinct().count() == staged[5].select("doc_id", "doc_tokens").distinct().count()
    assert names == got.columns[:5]


def test_repeated_ids_leave_one_row(spark):
    docs = spark.createDataFrame([(1, "same words in both rows here", "en", "a", 28)] * 2 + [(2, "other words that stand alone here", "en", "a", 5),
                                 (None, "a row without id", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.neardup_stage(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "None"]


def test_quality_stage_on_an_empty_table(spark, staged):
    empty = staged[0].where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
    assert quality.quality_rules(empty).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "y"), (None, a, "x"), (None, d, "x"), (3, c, "x"), (3, c, "x"), (None, None, "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = corpus_pipeline.neardup_stage(spark, docs, SF).collect()
    assert sorted(got, key=repr) == sorted([(1, a, "x"), (1, b, "x"), (None, d, "x"), (3, c, "x"), (4, "", "x")], key=repr)
