"""Token counts with a digest cache.

The content is normalised (null counts as empty, nothing else: any other
change could change the count) and digested; the digest, joined with that of
the tokenizer's file, is the key of a stored table of counts. A run joins its
distinct digests to the table, encodes one text of each digest that misses,
appends the new counts to the table and joins them back to the documents.

The library counts a text word by word, where that is sure to give the count of
the whole: byte-level BPE with its own pattern ends a match before each space
that follows no white space, and looks ahead only from white space. Texts are
cut there and nowhere else; a worker remembers the counts of recent words. With
any other tokenizer the library gets whole texts.

Hot texts: copies are combined before the shuffle; the join back carries a key
and two numbers, and the commonest digests' rows are dealt to all tasks. Empty
tables give empty results. Repeated rows repeat; rows without a key count as
others.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import hot_join, local_worker_env, map_texts, shared_path, stored, table

VOCABULARY = "byte_bpe_50k.json"
#: Tokens beyond which a document is over the limit.
LIMIT = 512
#: Words that a worker remembers before it starts anew.
REMEMBERED = 400_000
#: A space that follows no white space. What Python counts as white space holds all that the library's pattern does.
CUT = re.compile(r"(?<=\S) ")
UNCUT = re.compile(r"\s ")
CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def counter(content: bytes, name: str):
    """A function from texts to numbers of tokens, by the library of the file's kind, without added tokens."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    local_worker_env()
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(content)
    model.no_truncation()
    model.no_padding()
    whole = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return by_words(whole) if wordwise(content) else whole


def wordwise(content: bytes) -> bool:
    """Whether a text's tokens are those of its parts, cut before spaces that follow no white space."""
    given = json.loads(content)
    split, model = given.get("pre_tokenizer") or {}, given["model"]
    return (
        given.get("normalizer") is None
        and given.get("post_processor") is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space", True)
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in given.get("added_tokens") or ())
    )


def by_words(whole):
    """The same counts as whole's, which gets only the first word of a text and words that aren't remembered, each with the space before it."""
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        parts = [CUT.split(t) if UNCUT.search(t) else t.split(" ") for t in texts]
        totals = whole([p.pop(0) for p in parts])
        if len(known) > REMEMBERED:
            known.clear()
        distinct = set().union(*parts)
        new = iter(distinct.difference(known))
        while some := list(itertools.islice(new, 4096)):
            known.update(zip(some, whole([" " + w for w in some]), strict=True))
        totals = [n + sum(map(known.__getitem__, p)) for n, p in zip(totals, parts, strict=True)]
        for w in distinct:
            if len(w) >= 64:
                del known[w]
        return totals

    return count


def content_digest(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """The stored counts of one tokenizer version; none if there is no table yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, cache: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; cache is the path of the stored counts, which grow by the misses."""
    spark = df.sparkSession
    path = tokenizer or tokenizer_path()
    with open(path, "rb") as file:
        content = file.read()
    version = tokenizer_digest(content)
    shared = spark.sparkContext.broadcast(content)
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("content")).withColumn("digest", content_digest("content"))
    short = stored(rows.select(key, "digest", F.octet_length("content").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("_row")), "token-digests")
    known = cached(spark, cache, version)
    missing = rows.select("digest", "content").dropDuplicates(["digest"]).join(known, "digest", "left_anti")

    def make():
        count = counter(shared.value, path)
        return lambda texts: {"n_tokens": pa.array(count(texts), pa.int64())}

    fresh = map_texts(missing, ["digest", "content"], make, "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = cached(spark, cache, version)
    return hot_join(short, counts, "digest", "_row").select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents. Each call starts an empty cache, so that it counts the cost of encoding every distinct text."""
    return count_tokens(table(spark, sf_dir, "documents"), shared_path(spark, "token-counts"))
