"""Merged highlight spans, and text marked with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_spans(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, rules, observed_only): overlapping findings become one span, touching ones don't.

    Gaps and islands: one sort by document serves the running maximum, the
    islands' numbers and the aggregate, which share its partitioning.
    """
    w = Window.partitionBy(key).orderBy("offset", F.desc("end"), "rule")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = findings.select(key, "rule", "outcome", "offset", "end").withColumn("reach", F.max("end").over(before))
    rows = rows.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("offset") >= F.col("reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(
        F.min("offset").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("rule")).alias("rules"), F.bool_and(F.col("outcome") == "abstained").alias("observed_only")
    ).drop("island")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def highlight(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, html): the text with a mark around each span; fragments are escaped after they are cut."""
    lists = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "rules"))).alias("spans"))
    rows = docs.select(key, text).join(lists, key, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,rules:array<string>>>")))
    t = F.col(text)
    cut = lambda a, b: escape_html(F.substring(t, a + 1, b - a))
    before = lambda i: F.when(i > 0, F.col("spans")[F.greatest(i - 1, F.lit(0))]["end"]).otherwise(0)
    mark = lambda s: F.concat(F.lit('<mark data-rules="'), F.array_join(s["rules"], " "), F.lit('">'), cut(s["start"], s["end"]), F.lit("</mark>"))
    marked = F.array_join(F.transform("spans", lambda s, i: F.concat(cut(before(i), s["start"]), mark(s))), "")
    last = F.when(F.size("spans") > 0, F.element_at("spans", F.greatest(F.size("spans"), F.lit(1)))["end"]).otherwise(0)
    return rows.select(key, F.concat(marked, cut(last, F.length(t))).alias("html"))
