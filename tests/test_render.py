import json

import pytest
from pyspark.sql import functions as F

import proseline
from proseline.__main__ import main
from proseline.operators import calibrate, check, render
from proseline.operators.rules import RULES


def test_markdown(spark):
    df = spark.createDataFrame([(1, "**a** **b** **c** **d** — x — y"), (2, "")], "doc_id long, text string")
    rules = tuple(r for r in RULES if r.name in ("bold-ratio", "em-dash-density", "sentence-uniformity"))
    got = {r.doc_id: r.markdown for r in render.markdown(check.checked(df, rules=rules), rules=rules).collect()}
    assert got[1].startswith("# Report: 1\n\n**0.000** over 2 density rules · 6 words · en · lexicon 0.3.0+0126033ab30f\n\nHard rules: none measured\n\n## Not measured (1)\n\n- sentence-uniformity")
    assert "### bold-ratio 0.00\n\n4 found; clean up to 20, zero from 120\n\n- a\n- b\n- c\n- and 1 more" in got[1] and "| em-dash-density | 0.00 | 333.33 | 2 |" in got[1]
    assert got[1].endswith("---\n\n7 uncalibrated constants in this run:\n- bold-ratio.ceiling = 120\n- bold-ratio.floor = 20\n- em-dash-density.ceiling = 15\n- em-dash-density.floor = 2\n- report.pass-threshold = 0.8\n- sentence-uniformity.min-sentences = 6\n- sentence-uniformity.target-sd = 6\n")
    assert "not measured: needs 6 sentences" in got[2]


def test_observed_and_not_scored(spark):
    df = spark.createDataFrame([(1, "A short note — no more.")], "doc_id long, text string")
    text = render.markdown(check.checked(df)).first().markdown
    assert "### Observed, not scored\n\n**em-dash-density**: 1\n\n- —" in text
    page = render.html(check.checked(df.withColumn("text", F.lit("**<b>** — x")))).first().html
    assert "<li>&lt;b&gt;</li>" in page and page.startswith("<!doctype html>")
    report = json.loads(render.json_reports(check.checked(df)).first().json)
    assert report["lexiconVersion"] == "0.3.0+0126033ab30f" and report["wordCount"] == 5 and len(report["rules"]) == 13


def test_collapsed(spark):
    df = spark.createDataFrame([("a \n b",), ("x" * 91,), ("x" * 90,)], "t string")
    assert [r.c for r in df.select(render.collapsed(F.col("t")).alias("c")).collect()] == ["a b", "x" * 87 + "…", "x" * 90]


def test_numbers(spark):
    df = spark.createDataFrame([(0.125,), (1.0,), (0.005,), (99.995,)], "x double")
    assert [r.s for r in df.select(render.fixed(F.col("x"), 2).alias("s")).collect()] == ["0.13", "1.00", "0.01", "100.00"]
    assert [render.plain_number(x) for x in (1.0, 0.5, 120)] == ["1", "0.5", "120"]


def test_calibration(spark):
    rows = [("en", r, "density", p, float(v), "scored", None) for r, p, values in (("a", "accepted", range(12)), ("a", "generated", range(30, 42)), ("b", "accepted", [1] * 12), ("b", "generated", [0] * 12), ("c", "accepted", [1]), ("c", "generated", [2])) for v in values]
    df = spark.createDataFrame(rows, "language string, rule string, kind string, provenance string, per_thousand double, outcome string, min_words int")
    text = render.calibration(calibrate.verdicts(calibrate.bands(calibrate.observations(df))))
    assert "| en | a | 12 | 12 | 9.90 | 31.10 | 21.20 | separates |" in text and "## No signal\n\n- en: b" in text and "## Too few documents\n\n- en: c" in text and "23 uncalibrated constants" in text


def test_command_line(spark, tmp_path, capsys):
    good, bad = tmp_path / "good.md", tmp_path / "bad.md"
    good.write_text("A short note. It is plain.")
    bad.write_text("Ovo je tekst koji se na to da za sa " * 12)
    assert main([str(good)]) == 0 and capsys.readouterr().out.startswith("# Report: good.md")
    assert main([str(bad), "--language", "sr", "--json"]) == 1 and json.loads(capsys.readouterr().out)["hardFailures"] == ["diacritics"]
    assert main([str(tmp_path / "none.md")]) == 2
    with pytest.raises(SystemExit):
        main(["--wrong"])


def test_public_names():
    assert all(hasattr(proseline, name) for name in proseline.__all__)
