import os
import zlib

import numpy as np
import pytest

from proseline.llm import op4_quality as op

SF = "/root/testdata/sf0.01"


def test_cases(spark):
    docs = spark.createDataFrame([(i, ("plain words in a row " if i % 2 else "SHOUT!! %%% ") * 20, 0.5) for i in range(120)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(1, 1), (3, None)], "doc_id long, quality int")
    w = op.fit(docs, labels)
    rows = [(1, None), (2, ""), (3, "plain words here in a row " * 9), (4, "LOUD!! %%% " * 9), (5, "x" * 300_000), (4, "LOUD!! %%% " * 9), (6, "%" * 200_000)]
    got = op.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), w).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert by[1] == by[2] and by[3] > 0.7 > 0.3 > by[4]
    none = op.fit(docs, labels.limit(0))
    assert not np.any(none) and {r.score for r in op.score_documents(docs, none).collect()} == {0.5}
    assert op.score_documents(docs.limit(0), w).count() == 0
    # without both labels nothing is learnt and nothing rejected
    one = op.fit(docs, labels.where("quality = 0"))
    assert not np.any(one) and op.keep_documents(docs, one).count() == op.keep_documents(docs, none).count() == docs.count()
    # the smallest sample has a document of each label
    assert np.any(op.fit(docs, labels, 1))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out(spark):
    got = {r.doc_id: r for r in op.op4_quality(spark, SF).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(r.score, label[i]) for i, r in got.items() if r.held_out and label.get(i) is not None]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95 and sum(g >= op.THRESHOLD for g in good) / len(good) > 0.95
