import hashlib
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proseline.llm import op9_suffix_dedup as op
from proseline.llm.suffix_groups import suffix_array

SF = "/root/testdata/sf0.01"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(x):
    assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=5), st.integers(4, 9))
def test_windows(parts, span):
    parts = [p.encode() for p in parts]
    count = {}
    for p in parts:
        for i in range(len(p) - span + 1):
            count[p[i : i + span]] = count.get(p[i : i + span], 0) + 1
    want = [(k, i) for k, p in enumerate(parts) for i in range(len(p) - span + 1) if count[p[i : i + span]] > 1]
    for sparse, size, windows in ((1, 1 << 19, 400_000), (2, 20, 400_000), (4, 1 << 19, 5), (2, 1, 3)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(op, "ARRAY_BYTES", size)
            m.setattr(op, "WINDOWS_AT_ONCE", windows)
            k, i = op.repeated_windows(parts, span, sparse)
        assert list(zip(k.tolist(), i.tolist())) == want


def brute(rows):
    count = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 199):
            w = hash(b[i : i + 200])
            count[w] = count.get(w, 0) + 1
    out = []
    for key, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 199):
            if count[hash(b[i : i + 200])] > 1:
                gone[i] += 1
                gone[min(i + 200, len(b))] -= 1
        mask = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], mask.astype(int)])) == 1))
        out.append((key, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_cases(spark):
    rng = np.random.default_rng(6)
    prose = lambda n: "".join(rng.choice(list("abcdé fgh\n"), n))
    shared, other = prose(300), prose(200)
    while len(other.encode()) > 200:
        other = other[:-1]
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 199), (5, "y" * 201), (6, prose(500) + shared + prose(100)), (7, shared + prose(300)), (8, prose(90) + shared[:150]), (9, "word " * 300), (10, prose(700)), (12, "z" * 200)]
    rows += [(20 + i, prose(50) + shared[i * 10 : i * 10 + 220]) for i in range(5)] + [(30, other), (31, other), (32, prose(400) + other)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, id int, h string")
    assert sorted(map(tuple, op.cleaned(df).collect())) == brute(rows)
    assert op.cleaned(df.limit(0)).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 1000)
    rng = np.random.default_rng(7)
    base = "".join(rng.choice(list("abcdefgh "), 7000))
    rows = [(1, base), (2, base[2900:3300]), (3, "q" + base[5000:6500])]
    whole = [np.concatenate([x[1] for x in op.filed(t.encode())]).tolist() for _, t in rows]
    monkeypatch.setattr(op, "PIECE", 1 << 20)
    assert whole == [np.concatenate([x[1] for x in op.filed(t.encode())]).tolist() for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, op.cleaned(df).collect())) == brute(rows)


@pytest.mark.parametrize("held,batch", [(100_000, 1000), (3, 7), (1, 1), (10, 4)])
def test_streamed_anchors(monkeypatch, held, batch):
    monkeypatch.setattr(op, "HELD", held)
    rng = np.random.default_rng(9)
    rows = sorted((int(h), int(c), k, 0) for k, (h, c) in enumerate(zip(rng.integers(0, 25, 400) // 3, rng.integers(0, 40, 400) ** 2 // 60, strict=True)))
    part = lambda h, c, j: (c * 7 + j * h) % (5 + j)
    table = np.array([(h, i, z, part(h, c, 1), part(h, c, 2), part(h, c, 3), c) for h, c, i, z in rows]).T
    stream, out = op.Streamed(), []
    for at in range(0, len(rows), batch):
        out += [b.to_pylist() for b in stream.add(list(table[:, at : at + batch]))]
    out = [r for b in [*out, *(b.to_pylist() for b in stream.end())] for r in b]
    classes = {}
    for h, c, i, _ in rows:
        classes.setdefault((h, c), []).append(i)
    of = lambda kind: [r for r in out if r["kind"] == kind]
    assert sorted((r["h"], r["c"], r["id"]) for r in of(op.MEMBER)) == sorted((h, c, i) for (h, c), own in classes.items() if len(own) > 1 for i in own)
    assert sorted((r["h"], r["c"], r["n"], r["id"], r["id2"]) for r in of(op.PAIR)) == sorted((h, c, len(own), own[0], own[1]) for (h, c), own in classes.items() if len(own) > 1)
    late = {r["h"] for r in of(op.LATE)}
    assert sorted((r["h"], r["c"], r["n"]) for r in of(op.LATE)) == sorted((h, c, len(own)) for (h, c), own in classes.items() if h in late)
    near = {}
    for h, c in classes:
        for j in (1, 2, 3):
            near.setdefault((h, j, part(h, c, j)), set()).add(c)
    partial = {(h, c) for (h, j, p), own in near.items() if p and len(own) > 1 and h not in late for c in own}
    partial = {(h, c) for h, c in partial if any(len(classes[x]) == 1 for x in partial if x[0] == h)}
    assert sorted((r["h"], r["c"]) for r in of(op.PARTIAL)) == sorted(partial)
    assert bool(late) == (held < 100)


def test_late_anchors(spark, monkeypatch):
    """Anchors whose classes don't fit in a task are brought together by their parts, with the same result."""
    rng = np.random.default_rng(11)
    prose = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line = prose(230)
    rows = [(k, prose(120) + line[rng.integers(0, 25) : 205 + rng.integers(0, 25)] + prose(90)) for k in range(30)] + [(90 + k, line) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = op.shared_anchors(op.anchor_rows(df, "doc_id", "text"))
    h, ids, place, p0, p1, p2, c = (np.array(x) for x in zip(*sorted((r.h, r.id, r.place, r.p0, r.p1, r.p2, r.c) for r in op.anchor_rows(df, "doc_id", "text").collect()), strict=True))
    order = np.lexsort((place, ids, c, h))
    monkeypatch.setattr(op, "HELD", 2)
    stream = op.Streamed()
    columns = [x[order] for x in (h, ids, place, p0.astype(np.int32), p1.astype(np.int32), p2.astype(np.int32), c)]
    out = [b for at in range(0, len(h), 5) for b in stream.add([x[at : at + 5] for x in columns])] + list(stream.end())
    made = spark.createDataFrame([tuple(r.values()) for b in out for r in b.to_pylist()], plain.schema)
    assert made.where(F.col("kind") == op.LATE).count() > 0
    monkeypatch.setattr(op, "shared_anchors", lambda rows, dealt: made)
    assert sorted(map(tuple, op.cleaned(df).collect())) == brute(rows)


@pytest.mark.parametrize("share,common,held", [(1, 1, 100_000), (1, 2, 3), (1, 3, 100_000), (2, 1, 100_000)])
def test_common_anchors(spark, monkeypatch, share, common, held):
    """Whatever is dealt to many tasks, the result is the same; also where one task has one member of a class."""
    rng = np.random.default_rng(13)
    prose = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line, copy = prose(260), prose(600)
    rows = [(k, prose(120) + line[rng.integers(0, 30) : 205 + rng.integers(0, 50)] + prose(90)) for k in range(25)]
    rows += [(40 + k, copy) for k in range(12)] + [(60, copy[:350] + prose(40)), (61, "word " * 400), (62, "word " * 90), (63, prose(900)), (64, copy), (64, copy), (65, None), (None, copy)]
    unlike = prose(300)
    rows += [(66, unlike), (66, unlike)]
    for name, value in (("SHARE", share), ("COMMON", common), ("OF_A_TASK", 1 << 30), ("HELD", held)):
        monkeypatch.setattr(op, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = op.common_anchors(df, "doc_id", "text")
    made = op.shared_anchors(op.anchor_rows(df, "doc_id", "text"), dealt)
    assert dealt and {r.kind for r in made.select("kind").distinct().collect()} >= {op.MEMBER, op.HEAD}
    want = brute([r for r in rows if r[0] is not None])
    assert sorted(tuple(r) for r in op.cleaned(df).where("doc_id is not null").collect()) == want


def test_bytes_decide_on_classes(spark):
    rng = np.random.default_rng(10)
    text = "".join(rng.choice(list("abcdefgh "), 3000))
    other = text[:1500] + "#" + text[1501:]
    df = spark.createDataFrame([(1, text), (2, "zz" + text), (3, other)], "doc_id long, text string")
    pair = lambda i, j, place, place2, h: [(i, h, place, True, True, h, 5, 2), (j, h, place2, True, True, None, None, None)]
    asked = spark.createDataFrame(pair(1, 2, 1600, 1602, 10) + pair(1, 3, 1600, 1600, 11) + pair(1, 3, 2000, 2000, 12), "id long, key long, place long, whole boolean, diagonal boolean, h long, c long, n long")
    # the contexts of key 11 differ by a byte, whatever their digests said: the array doesn't confirm them
    found = lambda rows: sorted(r.h for r in op.marks(op.contexts(df, rows, "doc_id", "text")).where("h is not null").collect())
    assert found(asked.where("key = 11")) == [] and found(asked.where("key = 12")) == [12] and found(asked.where("key = 10")) == [10]


def test_diagonals():
    one = dict(whole=True, h=None)
    asked = [dict(key=4, place=p, diagonal=True, **one) for p in (5000, 5100, 5200, 9000)] + [dict(key=2, place=p, diagonal=False, **one) for p in (700, 750)]
    assert [(a, z) for _, a, z, _, _ in op.pieces_of(9100, asked)] == [(532, 900), (582, 950), (4832, 5400), (8832, 9100)]


def test_rows_without_a_key(spark):
    text = "".join(np.random.default_rng(12).choice(list("abcdefgh "), 400))
    df = spark.createDataFrame([(None, text), (1, text), (None, None), (2, text + "x"), (2, text + "x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in op.cleaned(df).collect()), key=str)
    assert got == sorted([(None, 400, 0), (1, 400, 400), (None, 0, 0), (2, 401, 401), (2, 401, 401)], key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, op.op9_suffix_dedup(spark, SF).collect())) == brute(rows)
