"""Labels of sentences: files and their checks, and scores of an analysis against them.

A mark is a letter: C for the claim, E for evidence, H for hype. labels has a
row (key, idx, text, marks) for each sentence, marked or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proseline.operators.trace import verify_labels

MARKS = ("C", "E", "H")
SCHEMA = "source string, language string, idx int, text string, marks array<string>"


def parse_labels(content: dict) -> list[tuple]:
    """Rows of SCHEMA from parsed YAML of a label file. Unknown or missing fields, unknown marks and a file without a labeller raise ValueError."""
    fields = {"source", "labelledBy", "labelledAt", "language", "entries"}
    if set(content) != fields or not all(content[k] for k in fields - {"entries"}):
        raise ValueError(f"label file: needs {sorted(fields)}, none of them empty")
    if content["language"] not in ("sr", "en"):
        raise ValueError(f"wrong language: {content['language']}")
    rows = []
    for e in content["entries"] or ():
        if set(e) - {"index", "text", "marks", "note"} or not isinstance(e.get("index"), int) or e["index"] < 1 or not e.get("text") or not set(e.get("marks") or ()) <= set(MARKS):
            raise ValueError(f"label file {content['source']}: wrong entry {e}")
        rows.append((content["source"], content["language"], e["index"], e["text"], list(e.get("marks") or ())))
    return rows


def read_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The labels of some files, in the order of their names."""
    import yaml

    rows: list[tuple] = []
    for path in sorted(paths):
        with open(path, encoding="utf-8") as file:
            rows += parse_labels(yaml.safe_load(file))
    return spark.createDataFrame(rows, SCHEMA)


def labelled_sources(labels: DataFrame, sources: DataFrame, name: str = "name") -> DataFrame:
    """labels with the text of the source that each one names; those whose source is missing have none."""
    return labels.join(sources.select(F.col(name).alias("source"), F.col("text").alias("source_text")), "source", "left")


def indices_for(labels: DataFrame, mark: str, key: str = "doc_id") -> DataFrame:
    """(key, idx) of the sentences that carry a mark, each once."""
    return labels.where(F.array_contains("marks", mark)).select(key, "idx").distinct()


def check_labels(labels: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, problem): sentences that are missing, moved or labelled twice, and sources without any mark (idx null)."""
    blank = labels.groupBy(key).agg(F.max(F.size("marks")).alias("most")).where("most <= 0 or most is null")
    return verify_labels(labels, sentences, key).unionByName(blank.select(key, F.lit(None).cast("int").alias("idx"), F.lit("no marks").alias("problem")))


def sentence_at(places: DataFrame, sentences: DataFrame, key: str = "doc_id", at: str = "offset") -> DataFrame:
    """places with idx, the sentence that an offset lies in, null between sentences.

    As-of by one sort: places and starts of sentences are one list by key and
    offset, in which each place takes the last start before it.
    """
    names = places.columns
    s = sentences.select(F.col(key), F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct("idx", "end").alias("_s"), F.lit(None).cast(places.select(F.struct("*")).schema[0].dataType).alias("_p"))
    p = places.select(F.col(key), F.col(at).cast("int").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), F.struct("*").alias("_p"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = s.unionByName(p).withColumn("_last", F.last("_s", ignorenulls=True).over(w)).where("_kind = 1")
    return rows.select(*(F.col(f"_p.{c}").alias(c) for c in names), F.when(F.col("_at") < F.col("_last.end"), F.col("_last.idx")).alias("idx"))


def claim_locates(located: DataFrame, labels: DataFrame, key: str = "doc_id", field: str = "claim") -> DataFrame:
    """(key, value, claim_density): 1 where the claim's quote lies in a sentence marked C, else 0, also without a quote or a place; and the share of C among all sentences, of four decimals."""
    wanted = indices_for(labels, "C", key).withColumn("hit", F.lit(1))
    hits = located.where(F.col("field") == field).join(wanted, [key, "idx"], "left").groupBy(key).agg(F.max(F.coalesce("hit", F.lit(0))).alias("value"))
    of = labels.groupBy(key).agg(F.count_distinct("idx").alias("n"), F.count_distinct(F.when(F.array_contains("marks", "C"), F.col("idx"))).alias("c"))
    return of.join(hits, key, "left").select(key, F.coalesce("value", F.lit(0)).alias("value"), F.round(F.col("c") / F.greatest("n", F.lit(1)), 4).alias("claim_density"))


def mark_recall(located: DataFrame, labels: DataFrame, mark: str, prefix: str, key: str = "doc_id") -> DataFrame:
    """(key, wanted, covered, missed, recall): of the sentences with a mark those that a quote of the fields with a prefix covers; missed lists the others, at most a document's sentences. Documents without the mark have no row."""
    wanted = indices_for(labels, mark, key)
    own = located.where(F.col("field").startswith(prefix)).select(key, "idx").distinct().withColumn("hit", F.lit(1))
    rows = wanted.join(own, [key, "idx"], "left")
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("idx")))).alias("missed"))
    return out.withColumn("recall", F.col("covered") / F.col("wanted"))


def match_totals(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of quotes of each kind for each document, and for all (key null)."""
    kinds = ("exact", "normalized", "foreign", "absent")
    return matches.rollup(key).agg(*(F.count_if(F.col("match") == k).alias(k) for k in kinds))


def worksheets(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, worksheet): YAML for a labeller to fill in, an entry with blank marks for each sentence."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("sentence").alias("x"))), r"(?s)\A\{\"x\":(.*)\}\z", 1)
    entry = F.concat(F.lit("  - index: "), F.col("idx").cast("string"), F.lit("\n    text: "), quoted, F.lit("\n    marks: []"))
    head = F.concat(F.lit("source: "), F.col(key).cast("string"), F.lit("\nlabelledBy: \"\"\nlabelledAt: \"\"\n# "), F.size("e").cast("string"), F.lit(" sentences\nentries:\n"))
    lists = sentences.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", entry.alias("x")))).alias("e"))
    return lists.select(key, F.concat(head, F.array_join(F.transform("e", lambda x: x["x"]), "\n"), F.lit("\n")).alias("worksheet"))


ANALYSIS = "struct<claim:struct<statement:string,quote:string>,evidence:array<struct<statement:string,quote:string>>,novelty:struct<genuinelyNew:array<struct<statement:string,quote:string>>,restated:array<struct<statement:string,quote:string>>>,hype:array<struct<statement:string,quote:string>>>"


def recorded(fixtures: DataFrame, column: str = "json") -> DataFrame:
    """fixtures with analysis, a recorded tool output read by an explicit schema; null where it isn't JSON."""
    return fixtures.withColumn("analysis", F.from_json(column, ANALYSIS))


def cases(sources: DataFrame, fixtures: DataFrame, key: str = "case_id") -> DataFrame:
    """Each case's source with its recorded output; cases that lack one are left out."""
    return sources.join(fixtures, key)
