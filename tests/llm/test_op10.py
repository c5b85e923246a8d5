import os
import re

import numpy as np
import pytest

from proseline.llm import op10_near_dups as op

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width, percent):
    """Components from comparing all pairs that share a shingle."""
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    sets = {}
    for key, text in rows:
        w = WORD.findall((text or "").translate(upper))
        sets[key] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    seen = set()
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {k: (len(s), root(k)) for k, s in sets.items()}


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"z{rng.integers(1e9)}" for w in words)


@pytest.mark.parametrize("block", [3000, 7])
def test_groups(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "KEY_BLOCK", block)
    monkeypatch.setattr(op, "LEADERS", min(block, 2))
    rng = np.random.default_rng(5)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "x" * 100_000), (8, "word " * 60_000)]
    base = [f"w{rng.integers(400)}" for _ in range(150)]
    rows += [(100 + i, edited(rng, base, rng.random() * 0.08)) for i in range(40)]
    rows += [(200 + i, " ".join(base)) for i in range(10)]
    rows += [(300 + i, " ".join(f"w{rng.integers(400)}" for _ in range(80))) for i in range(30)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, id int, digest string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.near_duplicates(df, width=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert [tuple(r) for r in op.near_duplicates(df).collect()] == [(1, 1, 1)] * 2
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_rows_without_a_key(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "q r s t u v"), (None, None), (7, "x y z x y w")]
    got = op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, 4), (4, 2, 4), (None, 2, None), (None, 0, None), (7, 2, 7)], key=str)


def test_pigeonhole():
    errors = op.allowed_errors(0.85)
    parts = op.chunks(errors)
    assert parts[0][0] == 0 and parts[-1][1] == op.SYMBOLS and 2 * len(parts) > errors
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, op.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(op.SYMBOLS, errors, replace=False)] += 1
        x, y = op.filed_keys(np.array([a, b]), parts)
        assert set(x) & set(y)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_as_brute_force_on_a_table(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.op10_near_dups(spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == brute(rows, 3, 85)
