import os
import zlib

import pytest

from proseline.llm import op1_language as op

SF = "/root/testdata/sf0.01"


def test_cases(spark):
    train = [(i, t, l, "x") for i, (t, l) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string, lang_pred string")
    model = op.fit(op.train_rows(docs))
    assert model["langs"] == ["en", "fr"]
    rows = [(1, None), (2, ""), (3, "123 -- !"), (4, "the the the"), (5, "chien"), (6, "le " * 50000), (6, "le " * 50000), (7, "thex dogx"), (8, "漢字")]
    got = op.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[i].lang_pred for i in range(1, 8)] == ["und", "und", "und", "en", "fr", "fr", "en"]
    assert all(0 <= r.score <= 1 for r in got) and by[8].lang_pred in ("en", "fr")
    none = op.fit(op.train_rows(docs.limit(0)))
    assert {r.lang_pred for r in op.identify(docs, none).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op.op1_language(spark, SF).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert got.keys() == lang.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == lang[i] for i in held) / len(held) > 0.97
