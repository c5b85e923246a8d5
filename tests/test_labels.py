"""Label files, their checks, and the scores of an analysis against them."""

import pytest
import yaml
from proseline.operators import labels
from proseline.sources import documents as sources
from proseline.streaming.limiter import each_batch
from pyspark.sql import functions as F

FILE = {"source": "a.md", "labelledBy": "x", "labelledAt": "2024-01-01", "language": "en", "entries": [{"index": 1, "text": "A.", "marks": ["C", "E"]}, {"index": 2, "text": "B.", "marks": []}]}


def test_files(spark, tmp_path):
    (tmp_path / "b.yaml").write_text(yaml.safe_dump(FILE | {"source": "b.md"}))
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(FILE))
    rows = labels.read_labels(spark, [str(tmp_path / "b.yaml"), str(tmp_path / "a.yaml")])
    assert [r.source for r in rows.collect()] == ["a.md", "a.md", "b.md", "b.md"]
    for bad in (FILE | {"labelledBy": ""}, FILE | {"x": 1}, FILE | {"language": "de"}, FILE | {"entries": [{"index": 1, "text": "A.", "marks": ["Q"]}]}, FILE | {"entries": [{"index": 0, "text": "A."}]}):
        with pytest.raises(ValueError):
            labels.parse_labels(bad)
    texts = spark.createDataFrame([("a.md", "A. B.")], "name string, text string")
    assert {(r.source, r.source_text) for r in labels.labelled_sources(rows, texts).collect()} == {("a.md", "A. B."), ("b.md", None)}
    assert [tuple(r) for r in labels.indices_for(rows, "E", "source").orderBy("source").collect()] == [("a.md", 1), ("b.md", 1)]


def test_scores(spark):
    marks = spark.createDataFrame([(1, 1, "A.", ["C"]), (1, 2, "B.", ["H"]), (1, 3, "C.", ["H"]), (2, 1, "x", ["H"]), (3, 1, "y", [])], "doc_id long, idx int, text string, marks array<string>")
    located = spark.createDataFrame([(1, "claim", 1), (1, "claim", 2), (1, "hype[0]", 3), (2, "claim", 1)], "doc_id long, field string, idx int")
    assert {r.doc_id: (r.value, r.claim_density) for r in labels.claim_locates(located, marks).collect()} == {1: (1, 0.3333), 2: (0, 0.0), 3: (0, 0.0)}
    got = {r.doc_id: (r.wanted, r.covered, r.missed, r.recall) for r in labels.mark_recall(located, marks, "H", "hype").collect()}
    assert got == {1: (2, 1, [2], 0.5), 2: (1, 0, [1], 0.0)}
    sentences = marks.select("doc_id", "idx", F.col("text").alias("sentence"), (F.col("idx") * 10).alias("start"), (F.col("idx") * 10 + 5).alias("end"))
    assert [tuple(r) for r in labels.check_labels(marks, sentences).collect()] == [(3, None, "no marks")]
    places = spark.createDataFrame([(1, 10), (1, 14), (1, 15), (1, 3), (1, 29), (9, 10)], "doc_id long, offset int")
    assert sorted(map(tuple, labels.sentence_at(places, sentences).collect()), key=str) == sorted([(1, 10, 1), (1, 14, 1), (1, 15, None), (1, 3, None), (1, 29, None), (9, 10, None)], key=str)
    sheet = labels.worksheets(sentences.where("doc_id = 1").withColumn("sentence", F.lit('He said "no": 1\n2'))).first().worksheet
    assert [e["text"] for e in yaml.safe_load(sheet)["entries"]] == ['He said "no": 1\n2'] * 3 and yaml.safe_load(sheet)["entries"][1] == {"index": 2, "text": 'He said "no": 1\n2', "marks": []}


def test_fixtures(spark):
    one = '{"claim":{"statement":"s","quote":"q"},"evidence":[{"statement":"e","quote":"f"}],"novelty":{"genuinelyNew":[],"restated":[]},"hype":[]}'
    rows = labels.recorded(spark.createDataFrame([(1, one), (2, "{")], "case_id int, json string"))
    assert {r.case_id: r.quote for r in rows.select("case_id", "analysis.claim.quote").collect()} == {1: "q", 2: None}
    assert [r.case_id for r in labels.cases(spark.createDataFrame([(1, "t"), (3, "u")], "case_id int, text string"), rows).collect()] == [1]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("b", "Text b.", "x: \"y\""), ("a", "Text a.", None)], "name string, text string, subject string")
    made = sources.with_frontmatter(df, {"subject": "subject"})
    sources.write_corpus(made, f"{tmp_path}/c")
    with pytest.raises(Exception):
        sources.write_corpus(made, f"{tmp_path}/c")
    back = {r.text.strip(): r.provenance for r in sources.strip_frontmatter(spark.read.text(f"{tmp_path}/c", wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"))).collect()}
    assert back == {"Text a.": "generated", "Text b.": "generated"}
    front = {r.name: yaml.safe_load(r.document.split("---")[1]) for r in made.collect()}
    assert front == {"b": {"provenance": "generated", "subject": 'x: "y"'}, "a": {"provenance": "generated", "subject": None}}
    assert [r.name for r in sources.chosen_subjects(df, first=1, key="name").collect()] == ["a"] and [r.name for r in sources.chosen_subjects(df, ["b", "z"], key="name").collect()] == ["b"]
    pages = spark.createDataFrame([("w " * 120, 200, "text/html; charset=utf-8"), ("w " * 119, 200, "text/plain"), ("w " * 200, 404, "text/html"), ("w " * 200, 200, "image/png"), (None, 204, "text/html")], "t string, s int, c string")
    assert [r.x for r in pages.select(sources.extraction_status(F.col("t"), F.col("s"), F.col("c")).alias("x")).collect()] == [None, "too short", "status 404", "no text", "too short"]
    sent = spark.createDataFrame([("🙂" * 20_001, True), ("🙂" * 20_000, True), ("x", False)], "t string, ok boolean")
    assert [r.s for r in sent.select(sources.submission_status(F.col("t"), allowed=F.col("ok")).alias("s")).collect()] == [413, 200, 429]


def test_batches_of_a_long_job(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k,)], "i int").write.parquet(f"{tmp_path}/in/{k}")
    rows = spark.readStream.schema("i int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = each_batch(rows, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(r.i for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1]
