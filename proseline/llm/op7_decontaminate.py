"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Seeds are all pairs of neighbouring words of the test items. An alignment
   of m words with e edits has m - e - 1 of them at least, so one that reaches
   THRESHOLD has `least` of its item's seeds within `span` words, whatever was
   edited. In items so short that none need survive, single words are seeds.
2. A document is aligned with an item around places that have that many,
   unless the item's words and pairs there are too few for the threshold.
3. The alignment is local, over words: +1 for a match, PENALTY for an edit.
   Its score is divided by the item's length; THRESHOLD and above counts.

So the result is that of aligning every document with every item. Items go to
the workers in blocks of at most BLOCK_WORDS words, one pass over the
documents for each block, so what is broadcast has a fixed bound.

Defined results: null and empty texts match nothing, nor do items of fewer
than N words. An item's best place in a document is given once. Equal texts
under several item_ids are given each, and different texts under one item_id
are searched each; repeated rows are one item. Rows without an item_id are no
items. Documents without a key are searched as others. Texts are read whole.
Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import slices, table

N, PENALTY, THRESHOLD = 3, 0.5, 0.6
BLOCK_WORDS = 1_000_000
SCHEMA = "doc_id long, item_id long, score double, start long, end long"

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Items:
    """A block of items as numbers: word ids, and seeds, which are codes of words or pairs of words."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.vocabulary: dict[str, int] = {}
        self.keys: list[int] = []
        self.words: list[np.ndarray] = []
        for key, text in rows:
            w = words_of(text)
            if len(w) >= N:
                self.keys.append(key)
                self.words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64))
        self.base = len(self.vocabulary) + 1
        size = np.array([len(w) for w in self.words], np.int64)
        edits = (1 - threshold) / PENALTY * size  # most that an alignment can have
        pairs = np.ceil(size - edits - 1 - 1e-9).astype(np.int64)
        self.paired = pairs > 0
        self.least = np.where(self.paired, pairs, np.maximum(1, np.ceil(threshold * size - 1e-9)).astype(np.int64))
        self.span = size + np.floor(edits + 1e-9).astype(np.int64)
        # seeds[i] is in the items owner[first[i]:first[i + 1]]
        codes = [np.unique(w[:-1] * self.base + w[1:] if paired else w) for w, paired in zip(self.words, self.paired, strict=True)]
        every = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order]
        self.seeds, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.own = [np.searchsorted(self.seeds, c) for c in codes]

    def number(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        w = words_of(text)
        return np.fromiter([get(x, 0) for x in w], np.int64, len(w))

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of w where a seed starts, and which."""
        known = w > 0
        spots = np.nonzero(known[:-1] & known[1:])[0]
        codes = w[spots] * self.base + w[spots + 1]
        if not self.paired.all():
            single = np.nonzero(known)[0]
            spots, codes = np.concatenate([spots, single]), np.concatenate([codes, w[single]])
        at = np.minimum(np.searchsorted(self.seeds, codes), len(self.seeds) - 1)
        right = self.seeds[at] == codes
        return spots[right], at[right]

    def likely(self, seeds: np.ndarray) -> np.ndarray:
        """The items of which the seeds found are enough."""
        found, times = np.unique(seeds, return_counts=True)
        n = self.first[found + 1] - self.first[found]
        inside = np.arange(n.sum()) + np.repeat(self.first[found] - (np.cumsum(n) - n), n)
        return np.nonzero(np.bincount(self.owner[inside], np.repeat(times, n), len(self.words)) >= self.least)[0]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment's score, and where in the passage it ends. Unknown words (0) match nothing."""
    steps = PENALTY * np.arange(1, len(passage) + 1)
    before = np.zeros(len(passage) + 1)
    best, end = 0.0, 0
    for word in item:
        row = np.maximum(before[:-1] + np.where(passage == word, 1.0, -PENALTY), before[1:] - PENALTY)
        np.maximum(row, 0.0, out=row)
        row = np.maximum.accumulate(row + steps) - steps  # gaps in the item
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top + 1
        before[1:] = row
    return best, end


def matches(items: Items, w: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(item, score, start, end) of the items that a document's words contain."""
    out = []
    spots, seeds = items.hits(w)
    for k in items.likely(seeds).tolist() if len(spots) else []:
        item, least, span = items.words[k], int(items.least[k]), int(items.span[k])
        need = items.threshold * len(item) - 1e-9
        found = np.sort(spots[np.isin(seeds, items.own[k])])
        dense = np.nonzero(found[least - 1 :] - found[: len(found) - least + 1] < span)[0]
        if not len(dense):
            continue
        starts, ends = np.maximum(found[dense] - span, 0), np.minimum(found[dense + least - 1] + span + 1, len(w))
        cuts = np.nonzero(starts[1:] > ends[:-1])[0] + 1
        best = None
        for a, b in zip(starts[np.append(0, cuts)].tolist(), ends[np.append(cuts - 1, len(ends) - 1)].tolist(), strict=True):
            passage = w[a:b]
            most = np.count_nonzero(np.isin(item, passage))
            if items.paired[k]:
                pairs = np.searchsorted(found, b) - np.searchsorted(found, a)
                most = min(most, (1 - PENALTY) * most + PENALTY * (pairs + 1))  # words that aren't in pairs stand between edits
            if most >= need:
                score, end = align(item, passage)
                if score >= need and (best is None or score > best[0]):
                    last = passage[max(0, end - span) : end]
                    best = (score, a + end - align(item[::-1], last[::-1])[1], a + end)
        if best:
            out.append((items.keys[k], best[0] / len(item), best[1], best[2]))
    return out


def find_block(docs: DataFrame, items: Items, key: str, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        own = shared.value
        for part in slices(batches):
            rows = [(k, *m) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for m in matches(own, own.number(t))]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["doc_id", "item_id", "score", "start", "end"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, SCHEMA)


def blocks_of(benchmark: DataFrame, threshold: float) -> Iterator[Items]:
    """The test items in blocks of about BLOCK_WORDS words: what is at the driver, and broadcast, at once has that bound."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null").distinct()
    total = sized.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # no text has more words
    blocks = int(total // BLOCK_WORDS) + 1
    for i in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()
        items = Items([(r["item_id"], r["text"]) for r in rows], threshold)
        if items.words:
            yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start, end) of every document and the test items in it; places count words."""
    out = None
    for items in blocks_of(benchmark, threshold):
        found = find_block(docs, items, key, text)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that contain no test item, all columns as they are; needs no key and no shuffle."""
    names, field = docs.columns, docs.columns.index(text)

    def without(docs: DataFrame, items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches):
            own = shared.value
            for part in slices(batches, field):
                keep = [not matches(own, own.number(t)) for t in part.column(field).to_pylist()]
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(keep, pa.bool_())).columns, names=names)

        return docs.mapInArrow(run, docs.schema)

    for items in blocks_of(benchmark, threshold):
        docs = without(docs, items)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that contain a copy of a test item, edited or not; clean documents have no row."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
