import hashlib
import os
import time

import pyarrow as pa
import pytest
import tiktoken

from proseline.llm import op3_bpe as op

import public_tokenizers as P

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "a", "Hello, world's   best\n\n  don't 12345 ½ ² ǅ 漢字かな 🙂👍🏽", "x" * 5000, "ab" * 3000 + " " * 200 + "\t\r\n", "é" * 700, "<|endoftext|>", "the the the"]


@pytest.fixture(scope="module")
def coder():
    return op.codec()


def encoding(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={v: k for k, v in coder.bytes_of_id.items()}, special_tokens={})


def test_perfect_hash_is_minimal(coder):
    keys = [k for k in coder.hash.slots if k is not None]
    assert len(keys) == len(set(keys)) == coder.hash.n == len(coder.bytes_of_id)
    assert all(coder.hash.slots[coder.hash.find(k)] == k for k in keys)
    assert coder.hash.find(b"certainly not a token of it") == -1


def test_as_the_library(coder):
    own = encoding(coder)
    for t in TEXTS:
        assert coder.encode(t) == own.encode_ordinary(t or "")
        assert coder.decode(coder.encode(t)) == (t or "").encode()


def test_rows(spark, coder):
    rows = [(i, t, "extra", "x") for i, t in enumerate(TEXTS)] + [(1, "", "extra", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, decoded string")
    ids = op.encode_documents(df, coder=coder)
    got = sorted(map(tuple, op.digest_documents(ids, coder=coder).collect()))
    own = encoding(coder)
    want = sorted((i, len(x := own.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert got == want
    assert {r.doc_id: bytes(r.decoded) for r in op.decode_documents(ids, coder=coder).collect()}[4] == TEXTS[4].encode()
    assert op.encode_documents(df.limit(0), coder=coder).count() == 0


def test_digests_without_an_object_per_id(coder):
    """What the query derives from ids takes a fraction of the time of joining them in Python."""
    rows = [None, [], *([(i * 7919 + j) % 50000 for j in range(4000)] for i in range(200)), [5]]
    column = pa.array(rows, pa.list_(pa.int32()))
    names = {i: str(i) for i in coder.bytes_of_id}
    coder.gathered()
    began = time.process_time()
    want = ([len(x or ()) for x in rows], [hashlib.sha256(",".join(map(names.__getitem__, x or ())).encode()).hexdigest() for x in rows], [hashlib.sha256(coder.decode(x or ())).hexdigest() for x in rows])
    plain = time.process_time() - began
    times = []
    for _ in range(3):
        began = time.process_time()
        got = op.digests(coder, column)
        times.append(time.process_time() - began)
    assert got == want
    assert op.digests(coder, column.slice(3, 5)) == tuple(x[3:8] for x in want)
    assert min(times) < plain / 2
    for wrong in ([1, -1], [1, 10**6], [None]):
        with pytest.raises(KeyError):
            op.digests(coder, pa.array([wrong], pa.list_(pa.int32())))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_whole_table(spark):
    """All texts of a table against the public library with the same ranks and pattern."""
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op.load_ranks(P.path(op.VOCABULARY)), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op.op3_bpe(spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want
