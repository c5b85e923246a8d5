import os

import pytest

import corpus_pipeline as pipeline
from proseline.llm import op3_bpe, op5_pii, op7_decontaminate
from proseline.llm.common import table

from .test_op10 import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    good = pipeline.keep_good(spark, docs, SF)
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == columns and kept.items() <= seen.items()
    ones = [i for i in seen if label.get(i) == 1]
    assert sum(i in kept for i in ones) / len(ones) > 0.9
    single = pipeline.drop_near_duplicates(spark, good, SF)
    found = brute(list(kept.items()), pipeline.WIDTH, pipeline.PERCENT)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in found.items() if i == c} and single.columns == columns
    clean = pipeline.drop_contaminated(spark, single, SF)
    items = [" ".join(op7_decontaminate.words_of(r.text)) for r in table(spark, SF, "benchmark").collect()]
    left = {r.doc_id: r.text for r in clean.collect()}
    assert not any(f" {x} " in f" {' '.join(op7_decontaminate.words_of(t))} " for t in left.values() for x in items) and clean.columns == columns
    masked = pipeline.mask_personal_data(spark, clean, SF)
    rows = masked.collect()
    assert masked.columns == columns and len(rows) == len(left)
    assert all(r.text == op5_pii.masked(left[r.doc_id]) and r.n_chars == len(r.text) and not op5_pii.find(r.text) for r in rows)
    coder = op3_bpe.codec()
    out = pipeline.encode(spark, masked, SF).collect()
    assert len(out) == len(rows) and all(coder.decode(r.token_ids) == r.text.encode() and r.n_tokens == len(r.token_ids) for r in out)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "a@b.co", "en", "s", 6, "x"), (3, "a@b.co", "en", "s", 6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token_ids string")
    assert pipeline.mask_personal_data(spark, docs, SF).count() == 4
    assert [r.n_tokens for r in pipeline.encode(spark, docs, SF).orderBy("doc_id").collect()][:2] == [0, 0]
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [1, 2, 3]
    for _, stage in pipeline.STAGES:
        if os.path.isdir(SF):
            assert stage(spark, docs.limit(0), SF).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(None, a), (5, a), (5, a), (None, a), (3, b), (3, "other words are here under the same key"), (4, b), (None, "alone without a key but with words"), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, component_id int")
    out = pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (3, b), (3, rows[5][1]), rows[7], (None, None), (9, ""), (9, "")], key=str)


def test_rows_without_a_key_are_searched(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(1, item), (1, "z " * 20), (None, "q " * 20), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"so {item} it is", 1), (2, "z " * 25, 1), (3, "clean text", 1), (None, "clean too", 1), (None, None, 1)], "doc_id long, text string, item_id int")
    out = pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted((str(r.text) for r in out.collect())) == ["None", "clean text", "clean too"]


def test_nothing_to_learn_rejects_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    for k, labels in enumerate(([], [(0, 0), (1, 0)], [(90, 1), (91, 0)])):
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        with pytest.warns(UserWarning):
            assert pipeline.keep_good(spark, docs, f"{tmp_path}/{k}").count() == 5
