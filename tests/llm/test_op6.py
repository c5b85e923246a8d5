import os
import random

import pytest
from tokenizers import Tokenizer

from proseline.llm import op6_token_counts as op
from proseline.llm.common import shared_path

import public_tokenizers as P

TEXTS = [None, "", "a b c", "<|endoftext|> x", "word " * 2000, "é漢🙂", "a b c", "A B C"]


def want(texts):
    t = Tokenizer.from_file(P.path(op.VOCABULARY))
    t.no_padding(), t.no_truncation()
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_counts_and_cache(spark):
    df = spark.createDataFrame([(i, t, b"x", 9) for i, t in enumerate(TEXTS)], "doc_id long, text string, digest binary, n_tokens int")
    cache = shared_path(spark, "test-cache")
    got = {r.doc_id: r for r in op.count_tokens(df, cache).collect()}
    assert [got[i].n_tokens for i in range(len(TEXTS))] == want(TEXTS)
    assert [got[i].n_bytes for i in range(len(TEXTS))] == [len((t or "").encode()) for t in TEXTS]
    assert [got[i].over_limit for i in range(len(TEXTS))] == [n > 512 for n in want(TEXTS)]
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in TEXTS})
    # hits are taken from the table, not counted again; only the new text is added
    spark.createDataFrame([(bytes.fromhex(__import__("hashlib").sha256(b"new").hexdigest()), stored.first().tokenizer, 77)], op.CACHE).write.mode("append").parquet(cache)
    more = spark.createDataFrame([(1, "new"), (2, "newer"), (3, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in op.count_tokens(more, cache).collect()}
    assert got == {1: 77, 2: want(["newer"])[0], 3: want(["a b c"])[0]}
    assert spark.read.parquet(cache).count() == stored.count() + 2 or spark.read.parquet(cache).count() == len({t or "" for t in TEXTS}) + 2
    assert op.count_tokens(df.limit(0), shared_path(spark, "test-cache")).count() == 0


def test_other_kinds(spark):
    df = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in op.count_tokens(df, shared_path(spark, "test-cache"), P.path("piece_bpe_32k.model")).collect()}
    import sentencepiece

    assert got == {1: len(sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode("Hello there")), 2: 0}


def test_words_count_as_the_whole(monkeypatch):
    """Counts by words equal the library's on whole texts, and repeated words don't go to the library again."""
    with open(P.path(op.VOCABULARY), "rb") as file:
        content = file.read()
    assert op.wordwise(content) and not op.wordwise(content.replace(b'"add_prefix_space":false', b'"add_prefix_space":true').replace(b'"add_prefix_space": false', b'"add_prefix_space": true'))
    rng = random.Random(5)
    parts = [" ", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\x85", "\x1c", "\u200b", "a", "word", "don't", "'s", "'", "12", "½", "é", "漢", "🙂", ".", ",.", "<|endoftext|>", "<|endof", "text|>", "x" * 80]
    texts = ["", " ", "  ", " a", "a ", "a  ", "\n a", "a\n b", "a \n"] + ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(4000)]
    count = op.counter(content, op.VOCABULARY)
    assert [n for i in range(0, len(texts), 512) for n in count(texts[i : i + 512])] == want(texts)
    monkeypatch.setattr(op, "REMEMBERED", 10)
    assert op.counter(content, op.VOCABULARY)(texts) == want(texts)
    seen = []
    count = op.by_words(lambda texts: seen.extend(texts) or [1] * len(texts))
    assert count(["a b c b", "a c"]) == [4, 2] and count(["d b c"]) == [3]
    assert sorted(seen) == [" b", " c", "a", "a", "d"]


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op.op6_token_counts(spark, SF).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()), n, n > op.LIMIT) for r, n in zip(rows, want([r.text for r in rows]), strict=True)}
