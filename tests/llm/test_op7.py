import os

import numpy as np
import pytest

from proseline.llm import op7_decontaminate as op

SF = "/root/testdata/sf0.01"


def slow_align(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1))
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a == b else -op.PENALTY), h[i - 1, j] - op.PENALTY, h[i, j - 1] - op.PENALTY)
    return h.max()


def test_alignment_as_the_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, passage = rng.integers(1, 6, 12), rng.integers(0, 6, 30)
        assert abs(op.align(item, passage)[0] - slow_align(item, passage)) < 1e-9


def test_copies(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    items = [(i, " ".join(word() for _ in range(20 + i))) for i in range(6)] + [(90, None), (91, ""), (92, "two words")]
    prose = " ".join(word() for _ in range(300))
    edited = items[3][1].split()
    for k in (3, 9, 14, 20):
        edited[k] = "changed"
    del edited[6]
    docs = [(1, None), (2, ""), (3, prose), (4, prose + " " + items[0][1].upper() + ", " + prose), (5, f"{prose} {' '.join(edited)} {prose}"), (6, " ".join(items[2][1].split()[:6]) + prose), (7, "two words " * 50_000), (4, prose + " " + items[0][1] + " " + items[1][1])]
    df = spark.createDataFrame([(k, t, 5, 0.1) for k, t in docs], "doc_id long, text string, item_id int, score double")
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    want = [(4, 0), (4, 0), (4, 1), (5, 3)]
    assert sorted((r.doc_id, r.item_id) for r in op.contaminated(df, bench).collect()) == want
    monkeypatch.setattr(op, "BLOCK_WORDS", 120)
    assert sorted((r.doc_id, r.item_id) for r in op.contaminated(df, bench).collect()) == want
    assert op.contaminated(df.limit(0), bench).count() == 0
    assert op.contaminated(df, bench.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_whole_passages(spark):
    docs = [(r.doc_id, " ".join(op.words_of(r.text))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, " ".join(op.words_of(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if f" {x} " in f" {t} "}
    got = {(r.doc_id, r.item_id) for r in op.op7_decontaminate(spark, SF).collect()}
    assert want <= got and len({d for d, _ in got}) <= len({d for d, _ in want}) * 1.1 + 1


def test_edits_everywhere_as_all_pairs():
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([3, 4, 5, 6, 8, 12, 20, 40, 40, 59])]
    prose = lambda n: list(rng.choice([*words, *(f"x{k}" for k in range(100))], n))
    docs = []
    for _, text in items:
        for step in (1, 2, 3, 4, 5, 7):
            for edit in ("insert", "delete", "change", "mixed"):
                copy = []
                for k, x in enumerate(text.split(), 1):
                    how = "keep" if k % step else ("insert", "delete", "change")[k // step % 3] if edit == "mixed" else edit
                    copy += {"keep": [x], "insert": [x, "new"], "delete": [], "change": ["new"]}[how]
                docs.append(" ".join(prose(30) + copy + prose(30)))
        docs.append(docs[-1] + " " + text)  # the whole copy is there too
    table = op.Items(items)
    lost = 0
    for text in docs:
        w = table.number(text)
        scores = {key: slow(item, w) for key, item in zip(table.keys, table.words, strict=True)}
        want = {key: s for key, s in scores.items() if s >= op.THRESHOLD - 1e-9}
        got = {key: (score, start, end) for key, score, start, end in op.matches(table, w)}
        assert got.keys() == want.keys()
        for key, (score, start, end) in got.items():
            assert abs(score - want[key]) < 1e-9 and abs(slow(table.words[table.keys.index(key)], w[start:end]) - score) < 1e-9
        lost += len(want)
    assert lost > 100


def slow(item, w):
    return op.align(item, w)[0] / len(item)
