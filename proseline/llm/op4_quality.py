"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal updates.

A text's features are hashed counts of its words, of pairs of words, and of
runs of one to three word shapes (letter case, digits, the sign itself for
punctuation, and a mark for a token that repeats the one before). Their
values are square roots of shares, so every vector has length 1. The score is
the logistic function of the sparse dot product with the weights.

Defined results: null and empty texts have no features and score what the
bias gives. Without documents of both labels to learn from every weight is 0
and every score 0.5; keep_documents then rejects nothing. Texts are read
whole; repeated rows get equal scores. More than one label row for a document
counts as their largest label; null labels teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import map_texts, slices, smallest, table

#: Number of hashed features, a power of two.
SIZE = 1 << 18
#: Bound of the sample that the classifier is fitted on: documents of each label at most.
TRAIN_DOCS_PER_LABEL = 3000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
THRESHOLD = 0.7
REMEMBERED = 200_000

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def shape(token: str) -> str:
    if not token[0].isalnum():
        return token[:3]
    if token.isdigit():
        return "9"
    size = "a" if len(token) < 4 else "b" if len(token) < 12 else "c"
    return size + ("X" if token.isupper() and len(token) > 1 else "x" if token.islower() else "Xx" if token[1:].islower() or len(token) == 1 else "xX")


class Hashes(dict):
    """Token to (word hash, shape hash), both 31 bits in one number."""

    def __missing__(self, token: str) -> int:
        word = xxhash.xxh3_64_intdigest(token.lower()) & 0x7FFFFFFF
        value = word << 31 | xxhash.xxh3_64_intdigest(shape(token), 7) & 0x7FFFFFFF
        if len(token) < 64:
            self[token] = value
        return value


class Features:
    def __init__(self):
        self.hashes = Hashes()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices, each once, and their values; index 0 is the bias."""
        tokens = TOKEN.findall(text) if text else []
        if not tokens:
            return np.zeros(1, np.int64), np.ones(1)
        both = np.fromiter(map(self.hashes.__getitem__, tokens), np.int64, len(tokens))
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        word, form = both >> 31, both & 0x7FFFFFFF
        form = form.copy()
        form[1:][word[1:] == word[:-1]] = 12345
        mix = lambda x, salt: ((x * 0x2545F4914F6CDD1D + salt) >> 21) % (SIZE - 1) + 1
        blocks = (mix(word, 1), mix(word[:-1] * 31 + word[1:] * 1009, 2), mix(form, 3), mix(form[:-1] * 31 + form[1:] * 1009, 4), mix(form[:-2] * 31 + form[1:-1] * 1009 + form[2:] * 77, 5))
        with np.errstate(over="ignore"):
            index, counts = np.unique(np.concatenate(blocks), return_counts=True)
        return np.concatenate([np.zeros(1, np.int64), index]), np.concatenate([np.ones(1), np.sqrt(counts / counts.sum())])


def train(examples: Iterable[tuple[np.ndarray, np.ndarray, int]], weights: dict[int, float], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over the examples, in order; weights balance the labels."""
    examples = list(examples)
    z, n = np.zeros(SIZE), np.zeros(SIZE)

    def current(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for index, x, y in examples:
            w = current(index)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = weights[y] * (p - y) * x
            g2 = g * g
            z[index] += g - (np.sqrt(n[index] + g2) - np.sqrt(n[index])) / ALPHA * w
            n[index] += g2
    return current(np.arange(SIZE))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS_PER_LABEL) -> np.ndarray:
    """Weights from per_label documents of each label at most, those with the smallest hashes of the id; zeros without both labels.

    The sampled labels are a bounded number of rows, so they are broadcast;
    all tasks that read documents look for them, and their texts alone are
    moved to the one task that trains on the bounded sample. A document that
    comes more than once is learnt once.
    """
    labels = labels.where("quality in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = labels.where(smallest(labels, "quality", "doc_id", per_label, 29))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))

    def run(batches):
        features, examples = Features(), []
        for part in slices(batches):
            for key, text, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                index, x = features(text)
                examples.append((xxhash.xxh3_64_intdigest(f"{key}"), index, x.astype(np.float32), y))
        examples.sort(key=lambda e: (e[0], e[3]))
        ones = sum(e[3] for e in examples)
        if not 0 < ones < len(examples):
            return
        balance = {1: len(examples) / (2 * ones), 0: len(examples) / (2 * (len(examples) - ones))}
        w = train((e[1:] for e in examples), balance)
        used = np.nonzero(w)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[used])], names=["i", "w"])

    out = np.zeros(SIZE)
    for r in rows.repartition(1).mapInArrow(run, "i long, w double").collect():  # at most SIZE rows
        out[r["i"]] = r["w"]
    return out


def score_documents(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        features, w = Features(), shared.value

        def work(texts):
            dots = np.array([w[index] @ x for index, x in map(features, texts)])
            return {"score": pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))), pa.float64())}

        return work

    return map_texts(docs, [key, text], make, f"{key} {dict(docs.dtypes)[key]}, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the labels that may be learnt from, score all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs that score the threshold or more, all columns as they are; all rows if the weights are those of no training."""
    if not np.any(weights):
        return docs
    names, field = docs.columns, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        features, w = Features(), shared.value
        for part in slices(batches, field):
            dots = [w[index] @ x for index, x in map(features, part.column(field).to_pylist())]
            yield pa.RecordBatch.from_arrays(part.filter(pa.array([1 / (1 + np.exp(-np.clip(d, -35, 35))) >= threshold for d in dots], pa.bool_())).columns, names=names)

    return docs.mapInArrow(run, docs.schema)
