"""Calibration, spans, sources, quotes, costs and streams on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proseline.operators import calibrate, costs, spans, trace
from proseline.operators.language import detect
from proseline.sources import documents as sources
from proseline.streaming.limiter import limited_stream


def test_verdicts(spark):
    def rows(rule, provenance, values, left=0):
        return [("en", rule, "density", provenance, v, "scored", None) for v in values] + [("en", rule, "density", provenance, None, "abstained", 51)] * left

    data = rows("apart", "accepted", [float(x) for x in range(10)]) + rows("apart", "generated", [20.0] * 10, 2) + rows("mixed", "accepted", [5.0] * 10) + rows("mixed", "generated", [3.0] * 10)
    data += rows("silent", "accepted", [1.0] * 3) + rows("silent", "generated", [0.0] * 12) + rows("few", "accepted", [1.0]) + rows("few", "generated", [2.0] * 12) + rows("none", "accepted", [1.0] * 12)
    df = spark.createDataFrame(data, "language string, rule string, kind string, provenance string, per_thousand double, outcome string, min_words int")
    seen = calibrate.observations(df)
    assert seen.where("rule = 'apart' and provenance = 'accepted'").first().p90 == pytest.approx(8.1)
    assert seen.where("rule = 'apart' and provenance = 'generated'").first().excluded == 2
    got = {r.rule: r for r in calibrate.verdicts(calibrate.bands(seen)).collect()}
    assert {k: r.status for k, r in got.items()} == {"apart": "separates", "mixed": "overlaps", "silent": "no-signal", "few": "insufficient", "none": "insufficient"}
    assert got["silent"].ceiling == 0 and got["silent"].margin is None and got["silent"].floor == 1.0
    assert got["few"].margin == 1.0 and got["none"].floor is None and got["apart"].margin == pytest.approx(11.9)
    seen = {(r.rule, r.provenance, r.density): (r.times, r.excluded) for r in calibrate.densities(df).collect()}
    assert seen["apart", "accepted", 3.0] == (1, 0) and seen["mixed", "accepted", 5.0] == (10, 0) and seen["apart", "generated", None] == (2, 2)


def test_percentiles_as_sorted_lists(spark):
    rng = np.random.default_rng(3)
    groups = {f"r{n}": np.round(rng.gamma(1.0, 3.0, n) * (rng.random(n) > 0.4), 2) for n in (1, 2, 9, 10, 11, 300)}
    df = spark.createDataFrame([("en", k, "density", "accepted", float(v), "scored", None) for k, x in groups.items() for v in x], "language string, rule string, kind string, provenance string, per_thousand double, outcome string, min_words int")
    got = {r.rule: r for r in calibrate.observations(df).collect()}
    for k, x in groups.items():
        assert got[k].n == len(x) and got[k].p10 == pytest.approx(np.percentile(x, 10)) and got[k].p90 == pytest.approx(np.percentile(x, 90))
        assert got[k].median == (pytest.approx(np.percentile(x, 50)) if len(x) >= 10 else None)
    assert calibrate.observations(df.limit(0)).count() == 0


def test_undeclared(spark):
    ok = spark.createDataFrame([("generated",)], "provenance string")
    assert calibrate.refuse_undeclared(ok).count() == 1
    with pytest.raises(ValueError):
        calibrate.refuse_undeclared(spark.createDataFrame([("accepted",), (None,)], "provenance string"))


def test_spans(spark):
    rows = [(1, "a", "scored", 0, 6), (1, "b", "abstained", 2, 4), (1, "c", "abstained", 6, 8), (2, "a", "abstained", 3, 5), (1, "d", "scored", 7, 12)]
    df = spark.createDataFrame(rows, "doc_id long, rule string, outcome string, offset int, end int")
    got = sorted(map(tuple, spans.merged_spans(df).collect()))
    assert got == [(1, 0, 6, ["a", "b"], False), (1, 6, 12, ["c", "d"], False), (2, 3, 5, ["a"], True)]
    docs = spark.createDataFrame([(1, "a<b>&'\"cdefgh"), (3, "x")], "doc_id long, text string")
    marks = spans.merged_spans(df.where("doc_id = 1 and rule in ('a', 'b')"))
    html = {r.doc_id: r.html for r in spans.highlight(docs, marks).collect()}
    assert html == {1: '<mark data-rules="a b">a&lt;b&gt;&amp;&#39;</mark>&quot;cdefgh', 3: "x"}


def test_language(spark):
    df = spark.createDataFrame([(1, "xxx yyy"), (2, None), (3, "je da se"), (4, "šta"), (5, "the of and")], "i int, text string")
    assert {r.i: r.language for r in detect(df).collect()} == {1: "en", 2: "en", 3: "sr", 4: "sr", 5: "en"}


@pytest.mark.parametrize(
    "html,text",
    [
        ("<body><main><script>x</script><style>y</style><p>Text.</p></main></body>", "Text."),
        ("<p>First.</p><p>Second.</p>", "First.\n\nSecond."),
        ("A &amp; B &mdash; C&nbsp;D &#353; &#x1F642; &unknown; &amp;#65; &#99999999;", "A & B — C D š 🙂 &unknown; &#65; &#99999999;"),
        ("<div></div>", ""),
        ("x<br/>y<nav>menu</nav><article class='a'>in</article>", "in"),
        (None, ""),
        ("<!-- <p> --><article>a<br>b   c\n\n\n\nd</article>", "a\nb c\n\nd"),
    ],
)
def test_html(spark, html, text):
    assert sources.extract_text(spark.createDataFrame([(html,)], "html string")).first().text == text


def test_corpus_folder(spark, tmp_path):
    for name, body in {"a.md": "---\nprovenance: generated\n---\nText a.", "b.txt": "Text b.", "c.html": "no", "d.md": "---\nx: y\n---\n \n", "sub/e.MARKDOWN": "Text e.", "sub/deep/f.md": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = sorted((r.name, r.text, r.provenance) for r in sources.read_corpus(spark, str(tmp_path)).collect())
    assert got == [("a.md", "Text a.", "generated"), ("b.txt", "Text b.", "accepted"), ("sub/e.MARKDOWN", "Text e.", "accepted")]
    assert sources.read_text(spark, f"{tmp_path}/b.txt").first().text == "Text b."


def test_quotes(spark):
    source = "Prvi red\nteksta. The Quote (with) stops."
    rows = [(1, source, "Prvi red", "sr"), (1, source, "PRVI  RED TEKSTA", "sr"), (1, source, "nothing of it", "en"), (2, "Ово је извор", "Latin quote", "sr"), (1, source, " ", "en"), (1, source, "the quote (WITH)", "en"), (3, "Ovo je šuma", "this is the end of the forest", "sr")]
    df = spark.createDataFrame(rows, "doc_id long, source string, quote string, language string")
    got = {r.quote: r for r in trace.check_quotes(df).collect()}
    assert {k: r.match for k, r in got.items()} == {"Prvi red": "exact", "PRVI  RED TEKSTA": "normalized", "nothing of it": "absent", "Latin quote": "foreign", "the quote (WITH)": "normalized", "this is the end of the forest": "foreign"}
    assert source[got["PRVI  RED TEKSTA"].start : got["PRVI  RED TEKSTA"].end] == "Prvi red\nteksta"
    assert got["nothing of it"].start is None
    assert {r.doc_id: r.fails for r in trace.fails(trace.check_quotes(df), "doc_id").collect()} == {1: True, 2: True, 3: True}


@pytest.mark.parametrize("text,n", [("Use e.g. this one. And that.", 2), ("To je npr. ovo. I to.", 2), ("J. Smith came. He left.", 2), ("It was 0.392 then. Yes.", 2), ("See 22.22.1 now. Yes.", 2), ("A\n\nB", 2), ("", 0), ("What?! Yes… no", 3), ("end", 1)])
def test_labelling_splitter(text, n):
    got = trace.split_labelled(text)
    assert len(got) == n and all(text[a:z] == s for _, s, a, z in got) and [i for i, *_ in got] == list(range(1, n + 1))


def test_labelling_without_python(spark, capsys):
    """The query's sentences are the splitter's, with odd spaces, look-backs, the mark itself and no text, and no Python runs for them."""
    texts = ["Dr. No came. K. \u212a. left... Yes", " \x1c a\x85. B\u3000\n \t\n\n c.\u00a0d. E.\n\n", "x\ufdd0. Y\ufdd1 z.", "𐐀. B. 😀. C", "İd. ſt. A MRS. b", "3. a 4 . b. ", "", None, ".", "A. " * 3000, "eco. Co. a" + " " * 5000 + ". b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = trace.labelled_sentences(df)
    assert sorted(map(tuple, rows.select("doc_id", "idx", "sentence", "start", "end").collect())) == [(i, *x) for i, t in enumerate(texts) for x in trace.split_labelled(t)]
    rows.explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas"))


def test_scores(spark):
    sentences = spark.createDataFrame([(1, 1, "A.", 0, 2), (1, 2, "B.", 3, 5), (1, 3, "C.", 6, 8)], "doc_id long, idx int, sentence string, start int, end int")
    quotes = spark.createDataFrame([(1, "A.", "exact", 0, 2), (1, "C.", "exact", 6, 8), (1, "?", "absent", None, None)], "doc_id long, quote string, match string, start int, end int")
    located = trace.quote_sentences(quotes, sentences)
    assert sorted((r.quote, r.idx) for r in located.collect()) == [("A.", 1), ("C.", 3)]
    wanted = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id long, idx int")
    got = {r.doc_id: (r.recall, r.precision) for r in trace.recall_precision(located, wanted).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0)}
    labels = spark.createDataFrame([(1, 1, "A."), (1, 2, "X"), (1, 9, "Y"), (1, 1, "A.")], "doc_id long, idx int, text string")
    assert sorted((r.idx, r.problem) for r in trace.verify_labels(labels, sentences).collect()) == [(1, "duplicate"), (2, "moved"), (9, "missing")]
    assert trace.match_table(quotes).first().asDict() == {"doc_id": 1, "exact": 2, "normalized": 0, "foreign": 0, "absent": 1}


def test_quoted_fields(spark):
    one = "struct<statement:string,quote:string>"
    df = spark.createDataFrame([(1, ("s", "q"), [("e", "f")], ([("g", "h")], []), [])], f"id int, claim {one}, evidence array<{one}>, novelty struct<genuinelyNew:array<{one}>,restated:array<{one}>>, hype array<{one}>")
    assert sorted((r.field, r.quote) for r in trace.quoted_fields(df, "id").collect()) == [("claim", "q"), ("evidence[0]", "f"), ("novelty.genuinelyNew[0]", "h")]


def test_costs(spark):
    usage = spark.createDataFrame([("m", 8280, 2347, 0, 0), ("x", 1, 1, 0, 0)], "model string, input_tokens long, output_tokens long, cache_write long, cache_read long")
    rates = spark.createDataFrame([("m", 5.0, 25.0)], "model string, input_per_mtok double, output_per_mtok double")
    got = {r.model: r for r in costs.priced(usage, rates).withColumn("shown", costs.format_cost(F.col("cost"))).collect()}
    assert got["m"].cost == pytest.approx(0.100075) and got["m"].unknown_reason is None and got["x"].cost is None and got["x"].shown == "unpriced"


def brute_limit(hits, limit, window):
    state, out = {}, []
    for k, t in sorted(hits, key=lambda x: x[1]):
        n, until = state.get(k, (0, None))
        if until is None or t >= until:
            n, until = 0, t + window
        state[k] = (n + 1, until)
        out.append((k, t, n + 1 <= limit))
    return sorted(out)


def test_limiter(spark):
    hits = [("a", 1000)] * 4 + [("b", t) for t in (0, 100, 60000)] + [("c", 37 * i % 9000) for i in range(60)]
    df = spark.createDataFrame(hits, "key string, now_ms long")
    for limit, window in ((3, 60000), (1, 60000), (2, 500)):
        assert sorted(map(tuple, costs.limited(df, limit, window).collect())) == brute_limit(hits, limit, window)


def test_limiter_without_keys_and_with_their_columns(spark):
    hits = [(None, 5), (None, 6), (None, 7), ("a", None), ("a", 1), ("a", 2), ("a", 3)]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(hits)], "key string, now_ms long, count int")
    got = {r["count"]: r.allowed for r in costs.limited(df, 2, 100, order="count").collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False}
    with pytest.raises(ValueError):
        costs.limited(df.withColumnRenamed("count", "allowed"), 2, 100)
    assert costs.limited(df.limit(0), 2, 100).count() == 0


def test_usage_and_retries(spark):
    usage = spark.createDataFrame([(1, "m", 8000, 2000, 0, 0), (1, "m", 280, 347, 0, 0), (1, "x", 5, 5, 0, 0)], "run int, model string, input_tokens long, output_tokens long, cache_write long, cache_read long")
    rates = spark.createDataFrame([("m", 5.0, 25.0)], "model string, input_per_mtok double, output_per_mtok double")
    got = {r.model: r for r in costs.usage_totals(usage, rates, "run").collect()}
    assert got["m"].cost == pytest.approx(0.100075) and got["m"].input_tokens == 8280 and got["x"].unknown_reason == "unpriced"
    tries = spark.createDataFrame([("r", 1), ("r", 1), ("r", 2), ("s", 1)], "run string, call int")
    assert sorted(map(tuple, costs.retries(tries, "run").collect())) == [("r", 2, 3, 1), ("s", 1, 1, 0)]
    assert costs.set_cost(0.5, None) == {"cost": 0.5, "unknown_reason": None}
    for bad in ((None, None), (1.0, "x"), (float("nan"), None)):
        with pytest.raises(ValueError):
            costs.set_cost(*bad)
    codes = spark.createDataFrame([(None,), (400,), (408,), (429,), (500,), (529,), (404,)], "s int")
    assert [r.t for r in codes.select(costs.is_transient(F.col("s")).alias("t")).collect()] == [True, False, True, True, True, True, False]


@pytest.mark.parametrize("sweep", [False])
def test_limiter_on_a_stream(spark, tmp_path, sweep):
    parts = [[("a", 1000), ("a", 1001), ("b", 5)], [("a", 1002), ("a", 70000), ("b", 6)]]
    for i, rows in enumerate(parts):
        pd.DataFrame(rows, columns=["key", "now_ms"]).to_parquet(tmp_path / f"{i}.parquet")
    stream = spark.readStream.schema("key string, now_ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = limited_stream(stream, 2, 60000, sweep).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(45)
        assert sorted(map(tuple, spark.table("limited").collect())) == brute_limit([x for p in parts for x in p], 2, 60000)
    finally:
        query.stop()


def test_submissions(spark):
    df = spark.createDataFrame([("",), (None,), ("x",), ("y" * 40001,), (" ",)], "t string")
    assert [r.s for r in df.select(sources.submission_status(F.col("t")).alias("s")).collect()] == [400, 400, 200, 413, 400]
