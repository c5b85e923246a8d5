"""Language identification by words first, then ever shorter character n-grams.

A model has, per language, log frequencies of known words and of character
n-grams of 4, 3, 2 and 1 letters. A known word adds its log frequency in each
language. An unseen word is covered place by place with the longest n-gram
that the model knows there, and adds the mean of their log frequencies. The
score is the share of the best language in the posterior.

Defined results: null text, empty text and text without a letter get `und`
and score 0. Equal scores go to the language that sorts first. Without a row
to learn from every text gets `und`. Texts are read whole, of any length.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proseline.llm.common import map_texts, slices, smallest, table

#: Bounds of the sample that the model is fitted on, and of the words and n-grams that it keeps, each for one language.
TRAIN_DOCS_PER_LANGUAGE = 4000
MOST_WORDS = 20_000
MOST_GRAMS = 10_000
#: Occurrences in the sample from which a word or n-gram is known.
LEAST_COUNT = 3
GRAM_SIZES = (4, 3, 2, 1)
#: Unseen words that a worker remembers before it starts anew.
REMEMBERED = 100_000
#: A document's evidence is tempered, so that scores stay below 1 for mixed texts.
TEMPER = 0.1

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for n in GRAM_SIZES for i in range(len(marked) - n + 1)]


def train_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: a language is known and crc32 of the id isn't divisible by 5."""
    return docs.where("lang is not null and text is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")


def fit(docs: DataFrame, per_language: int = TRAIN_DOCS_PER_LANGUAGE) -> dict:
    """Fit on per_language documents of each language at most, those with the smallest hashes of the id.

    The words and n-grams are counted by partition and summed by Spark; those
    that are among the MOST_WORDS and MOST_GRAMS commonest of any language
    come to the driver, so that no language crowds out another. The model has
    a number for each language and word: its size is bounded by the languages.
    """
    sample = docs.where(smallest(docs, "lang", "doc_id", per_language, 17))

    def count(batches):
        words: dict[str, Counter] = {}
        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
        for lang, found in words.items():
            grams: Counter = Counter()
            for word, n in found.items():
                for gram in grams_of(word):
                    grams[gram] += n
            for kind, counts in (("w", found), ("g", grams)):
                items = list(counts.items())
                for at in range(0, len(items), 10_000):
                    some = items[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([kind] * len(some)), pa.array([k for k, _ in some]), pa.array([n for _, n in some], pa.int64())], names=["lang", "kind", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, kind string, gram string, n long").groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "gram"))
    by_gram = counts.withColumn("place", place).groupBy("kind", "gram").agg(F.sum("n").alias("total"), F.min("place").alias("place"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    common = (F.col("total") >= LEAST_COUNT) & (F.col("place") <= F.when(F.col("kind") == "w", MOST_WORDS).otherwise(MOST_GRAMS))
    rows = by_gram.where(common).collect()
    langs = sorted({k for r in rows for k in r["by"]})
    model: dict = {"langs": langs}
    for name, kind in (("words", "w"), ("grams", "g")):
        own = [r for r in rows if r["kind"] == kind]
        totals = {k: sum(r["by"].get(k, 0) for r in own) for k in langs}
        model[name] = {r["gram"]: tuple(math.log((r["by"].get(k, 0) + 0.5) / (totals[k] + 0.5 * len(own))) for k in langs) for r in own}
    return model


class Scorer:
    """Applies a model; remembers the scores of unseen words up to a bound."""

    def __init__(self, model: dict):
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self.seen: dict[str, tuple] = {}

    def unseen(self, word: str) -> tuple:
        if (known := self.seen.get(word)) is not None:
            return known
        marked, found = f"<{word}>", []
        for i in range(len(marked)):
            for n in GRAM_SIZES:
                if i + n <= len(marked) and (score := self.grams.get(marked[i : i + n])) is not None:
                    found.append(score)
                    break
        out = tuple(sum(x) / len(found) for x in zip(*found, strict=True)) if found else (0.0,) * len(self.langs)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        if len(word) < 64:
            self.seen[word] = out
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        counts = Counter(words_of(text))
        if not counts and not any(map(str.isalpha, text)):
            return "und", 0.0
        sums = [0.0] * len(self.langs)
        get, unseen = self.words.get, self.unseen
        for word, n in counts.items():
            for i, x in enumerate(get(word) or unseen(word)):
                sums[i] += n * x
        total = max(1, sum(counts.values()))
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        scale = TEMPER * min(total, 100 / TEMPER) / total if total else 1
        return self.langs[best], 1 / sum(math.exp(max(-700, scale * (x - sums[best]))) for x in sums)


def identify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row. The model's size is bounded by its parameters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def work(texts):
            out = [scorer.predict(t) for t in texts]
            return {"lang_pred": pa.array([a for a, _ in out], pa.string()), "score": pa.array([b for _, b in out], pa.float64())}

        return work

    return map_texts(docs, [key, text], make, f"{key} {dict(docs.dtypes)[key]}, lang_pred string, score double")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the rows that may be learnt from, predict all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False))
    return identify(docs, fit(train_rows(docs))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
