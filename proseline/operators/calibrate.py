"""Calibration: distributions of densities over two corpora, bands, verdicts, totals."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents under which a side is too few to judge.
MIN_DOCS = 10


def labelled_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with provenance: accepted for quality 1, generated for 0. Documents without words go."""
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.join(marks, "doc_id").where(F.col("text").rlike(r"\S"))
    return rows.withColumn("provenance", F.when(F.col("quality") == 1, "accepted").otherwise("generated"))


GROUP = ("language", "rule", "provenance")
SHARES = {"p10": 0.1, "median": 0.5, "p90": 0.9}


def densities(results: DataFrame) -> DataFrame:
    """(language, rule, provenance, density, times, excluded, min_words): how often each density comes; abstentions are the rows without one."""
    rows = results.where("kind = 'density'")
    return rows.groupBy(*GROUP, F.col("per_thousand").alias("density")).agg(F.count(F.lit(1)).alias("times"), F.count_if(F.col("outcome") == "abstained").alias("excluded"), F.max("min_words").alias("min_words"))


def observations(results: DataFrame) -> DataFrame:
    """Per language, rule and provenance: exact percentiles of scored densities; abstentions count as excluded, never as zero.

    Equal densities are one row with a number. The rows are counted in
    buckets of one unit of density; only the buckets that hold a wanted rank
    are sorted, so no task holds a group's densities. The counts, which are
    read several times, are persisted on memory and disk.
    """
    seen = densities(results).persist(StorageLevel.MEMORY_AND_DISK)
    scored = F.when(F.col("density").isNotNull(), F.col("times")).otherwise(0)
    total = seen.groupBy(*GROUP).agg(F.sum(scored).alias("n"), F.sum("excluded").alias("excluded"), F.min("density").alias("least"), F.max("density").alias("most"), F.max("min_words").alias("min_words"))
    values = seen.where("density is not null").withColumn("bucket", F.floor("density"))
    before = Window.partitionBy(*GROUP).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = values.groupBy(*GROUP, "bucket").agg(F.sum("times").alias("held")).withColumn("first", F.coalesce(F.sum("held").over(before), F.lit(0)))
    ranks = total.where("n > 0").select(*GROUP, F.explode(F.array(*(F.struct(F.lit(k).alias("share"), ((F.col("n") - 1) * v).alias("place")) for k, v in SHARES.items()))).alias("x")).select(*GROUP, "x.*")
    ranks = ranks.select(*GROUP, "share", "place", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    wanted = buckets.join(ranks, list(GROUP)).where("rank >= first and rank < first + held")
    within = Window.partitionBy(*GROUP, "bucket", "share", "rank").orderBy("density").rowsBetween(Window.unboundedPreceding, -1)
    found = values.join(wanted, [*GROUP, "bucket"]).withColumn("start", F.col("first") + F.coalesce(F.sum("times").over(within), F.lit(0)))
    found = found.where("rank >= start and rank < start + times").groupBy(*GROUP, "share", "place").agg(F.min_by("density", "rank").alias("low"), F.max_by("density", "rank").alias("high"))
    found = found.select(*GROUP, "share", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias("value"))
    shares = found.groupBy(*GROUP).pivot("share", list(SHARES)).agg(F.first("value"))
    out = total.join(shares, list(GROUP), "left")
    return out.select(*GROUP, "n", "excluded", "least", "most", "p10", F.when(F.col("n") >= MIN_DOCS, F.col("median")).alias("median"), "p90", "min_words")


def bands(observed: DataFrame) -> DataFrame:
    """Accepted observations with the generated ones of the same language and rule, none where there are none."""
    side = lambda name: observed.where(F.col("provenance") == name).select("language", "rule", *(F.col(c).alias(f"{name}_{c}") for c in ("n", "excluded", "least", "most", "p10", "p90")), *(["min_words"] if name == "accepted" else []))
    joined = side("accepted").join(side("generated"), ["language", "rule"], "left")
    return joined.fillna(0, ["generated_n", "generated_excluded"])


def verdicts(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Floor (accepted p90), ceiling (generated p10), margin and verdict of each band, in the order of the cases."""
    a, g = F.col("accepted_n"), F.col("generated_n")
    silent = (g >= min_docs) & (F.col("generated_least") == 0) & (F.col("generated_most") == 0)
    empty = (a == 0) | (g == 0)
    margin = F.col("generated_p10") - F.col("accepted_p90")
    few = (a < min_docs) | (g < min_docs)
    pick = lambda on_silent, value: F.when(silent, on_silent).when(empty, None).otherwise(value)
    status = F.when(silent, "no-signal").when(empty | few, "insufficient").when(margin > 0, "separates").otherwise("overlaps")
    return found.select(
        "language", "rule", "accepted_n", "generated_n", pick(F.col("accepted_p90"), F.col("accepted_p90")).alias("floor"), pick(F.lit(0.0), F.col("generated_p10")).alias("ceiling"),
        pick(F.lit(None).cast("double"), margin).alias("margin"), pick(F.lit(None).cast("boolean"), F.col("generated_least") <= F.col("accepted_most")).alias("extremes_overlap"), status.alias("status"),
    )


def corpus_totals(rows: DataFrame, words: Column) -> DataFrame:
    """Documents and words of each language and provenance, with totals."""
    return rows.withColumn("w", words).rollup("language", "provenance").agg(F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"))


def refuse_undeclared(rows: DataFrame) -> DataFrame:
    """Raise ValueError unless every row declares the provenance `generated`."""
    wrong = rows.where(F.coalesce(F.col("provenance") != "generated", F.lit(True))).count()
    if wrong:
        raise ValueError(f"{wrong} documents don't declare that they are generated")
    return rows
