"""The queries over the reference tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.functions import kernel as K
from proseline.functions.lexicon import Entry, Lexicon
from proseline.functions.shipped import ENGLISH, SERBIAN, SHIPPED
from proseline.operators import calibrate, check, costs, labels, render, spans, trace
from proseline.operators.language import detect, detect_label_language
from proseline.operators.rules import RULES, declared_constants, rules_for
from proseline.plans import oracles
from proseline.sources import documents as sources

#: Lexicons of words that the test tables are full of, so that matching, stems, exceptions and double counting are put to use.
_DENSE = {"weasel-words": (Entry("the"), Entry("of the"), Entry("an*")), "inflated-vocabulary": (Entry("the", unless=("of the",)), Entry("de"))}
CUSTOM = {x.language: Lexicon(x.language, "custom", {**x.entries, **_DENSE}, x.exceptions) for x in (ENGLISH, SERBIAN)}
_DENSITIES = ("per_thousand", "score")


#: Bytes of files that one task gets.
SPREAD = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, and over as many tasks as its size needs, where it has fewer files than that: a file of one row group feeds one task. Inputs of many files stay as they are."""
    sizes = df._jdf.queryExecution().analyzed().collectLeaves()
    most = max(df.sparkSession.sparkContext.defaultParallelism, sum(int(str(sizes.apply(i).stats().sizeInBytes())) for i in range(sizes.size())) // SPREAD)
    return df.repartition(most) if len(df.inputFiles()) < most else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def results(spark: SparkSession, sf_dir: str, rules: tuple[str, ...] | None = None, lexicons: dict[str, Lexicon] | None = None) -> DataFrame:
    chosen = RULES if rules is None else tuple(r for r in RULES if r.name in rules)
    rows = check.rule_results(check.checked(docs(spark, sf_dir), lexicons, chosen))
    return rounded(rows.select("doc_id", "language", "rule", "kind", "outcome", "n_findings", *_DENSITIES, "passed", "min_words"), *_DENSITIES)


def of_rules(*rules: str, lexicons: dict[str, Lexicon] | None = None) -> tuple[Callable, str]:
    return (lambda spark, sf_dir: results(spark, sf_dir, rules, lexicons)), oracles.rule_results_sql(lexicons, list(rules))


def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", K.count_words(t).cast("long").alias("words"), K.utf16(t).cast("long").alias("n_utf16"), F.regexp_count(t, F.lit("\n")).cast("long").alias("newlines"))


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", K.sentence_lengths(F.col("text")).alias("x"))
    mean = F.aggregate("x", F.lit(0.0), lambda a, n: a + n) / F.greatest(F.size("x"), F.lit(1))
    return rounded(rows.select("doc_id", F.size("x").cast("long").alias("n_sentences"), mean.alias("mean_words"), K.deviation("x").alias("sd")), "mean_words", "sd")


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("_text", K.plain(F.col("text"))).select("doc_id", F.posexplode_outer(K.sentences("_text")).alias("i", "s"))
    rows = rows.where("s is not null")  # for a plain explode Spark would make the sentences again in a filter
    return rows.select("doc_id", (F.col("i") + 1).alias("idx"), "s.offset", "s.words", F.md5(F.col("s.text").cast("binary")).alias("text_md5"))


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(docs(spark, sf_dir)).select("doc_id", "language", F.col("sr_votes").cast("long").alias("sr_votes"), F.col("en_votes").cast("long").alias("en_votes"), "basis")


def label_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", detect_label_language(F.col("text")).alias("language"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = check.reports(check.checked(docs(spark, sf_dir)))
    rows = rows.select("doc_id", "language", F.col("word_count").cast("long").alias("word_count"), "score", F.size("hard_failures").cast("long").alias("n_hard_failures"), F.size("abstentions").cast("long").alias("n_abstentions"), F.col("n_findings").cast("long").alias("n_findings"))
    return rounded(rows, "score")


def hard_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = tuple(r for r in RULES if r.kind == "hard")
    rows = check.rule_results(check.checked(docs(spark, sf_dir), rules=hard))
    return rows.where("kind = 'hard' and not passed").select("doc_id", "rule")


def abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).where("outcome = 'abstained'").select("doc_id", "rule", "min_words")


def findings_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.findings(check.checked(docs(spark, sf_dir)))


def topk_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.top_findings(check.checked(docs(spark, sf_dir))).withColumn("first", F.array_join("first", " | "))


def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merged_spans(check.findings(check.checked(docs(spark, sf_dir), CUSTOM))).withColumn("rules", F.array_join("rules", " "))


def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    return spans.highlight(rows, spans.merged_spans(check.findings(check.checked(rows))))


def _graded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibrate.labelled_corpus(docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    done = check.checked(rows.select("doc_id", "text", "provenance"))
    return check.rule_results(done.withColumn("doc_id", F.struct("doc_id", "provenance"))).withColumn("provenance", F.col("doc_id.provenance"))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.observations(_graded_corpus(spark, sf_dir))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_observed(spark, sf_dir), "least", "most", "p10", "median", "p90")


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibrate.bands(_observed(spark, sf_dir)).select("language", "rule", "accepted_n", "generated_n", "accepted_excluded", "generated_excluded", "accepted_p90", "generated_p10")
    return rounded(rows, "accepted_p90", "generated_p10")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.verdicts(calibrate.bands(_observed(spark, sf_dir))), "floor", "ceiling", "margin")


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibrate.labelled_corpus(docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return calibrate.corpus_totals(detect(rows), K.count_words(F.col("text"))).withColumn("words", F.col("words").cast("long"))


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "text")


def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    head = F.when(F.col("doc_id") % 3 == 0, "---\nprovenance: generated\nwords: 3\n---\n").when(F.col("doc_id") % 3 == 1, "---\nsubject: s\n---\n").otherwise("")
    rows = sources.strip_frontmatter(docs(spark, sf_dir).withColumn("text", F.concat(head, t)))
    return rows.select("doc_id", "provenance", F.length("text").alias("n"))


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from the start, the middle and the end of each text: as they are, spaced, turned, and with words of another script."""
    t = F.col("text")
    parts = {"start": F.substring(t, 21, 60), "middle": F.substr(t, F.floor(F.length(t) / 2).cast("int") + 1, F.lit(60)), "end": F.right(t, F.lit(60))}
    kinds = {"as is": lambda x: x, "spaced": lambda x: F.lower(F.replace(x, F.lit(" "), F.lit("   "))), "turned": lambda x: F.concat(F.lit("zzqq "), F.reverse(x)), "script": lambda x: F.concat(F.lit("да "), x)}
    quotes = F.explode(F.array(*(F.struct(F.lit(f"{p} {k}").alias("field"), make(x).alias("quote")) for p, x in parts.items() for k, make in kinds.items())))
    rows = detect(docs(spark, sf_dir)).select("doc_id", t.alias("source"), "language", quotes.alias("q"))
    return trace.check_quotes(rows.select("doc_id", "source", "q.field", "q.quote", "language"))


def quote_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quoted(spark, sf_dir)
    there = K.normalise(F.substr(F.col("source"), F.col("start") + 1, F.col("end") - F.col("start"))) == K.normalise(F.col("quote"))
    return rows.select("doc_id", "field", "match", F.when(F.col("match") == "exact", F.col("start")).alias("exact_start"), F.coalesce(there, F.lit(False)).alias("traced"))


def match_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.match_table(_quoted(spark, sf_dir))


def labelled_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.labelled_sentences(docs(spark, sf_dir)).select("doc_id", "idx", "start", "end", F.md5(F.col("sentence").cast("binary")).alias("sentence_md5"))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.quote_sentences(_quoted(spark, sf_dir).where("match = 'exact'"), trace.labelled_sentences(docs(spark, sf_dir)))


def quote_sentence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).select("doc_id", "field", "idx")


def evidence_recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = trace.labelled_sentences(docs(spark, sf_dir)).where(F.contains("sentence", F.lit("an")))
    return rounded(trace.recall_precision(_located(spark, sf_dir), wanted), "recall", "precision")


def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    user = F.col("role") == "user"
    model = F.when(F.col("conv_id") % 3 == 0, "large").when(F.col("conv_id") % 3 == 1, "small").otherwise("unlisted")
    usage = rows.groupBy("conv_id").agg(F.sum(F.when(user, F.length("text")).otherwise(0)).alias("input_tokens"), F.sum(F.when(user, 0).otherwise(F.length("text"))).alias("output_tokens"), F.count(F.lit(1)).alias("cache_write"))
    rates = spark.createDataFrame([("large", 5.0, 25.0), ("small", 1.0, 5.0)], "model string, input_per_mtok double, output_per_mtok double")
    out = costs.priced(usage.withColumn("model", model).withColumn("cache_read", F.lit(0)), F.broadcast(rates))
    return rounded(out.select("conv_id", "model", "input_tokens", "output_tokens", "cost", "unknown_reason"), "cost")


def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"))
    return costs.limited(hits, 2, 3_600_000, "user_id", order="event_id").select("event_id", "user_id", "allowed")


def engine_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(x, SHIPPED[x].identity(), len(rules_for(x)), len(declared_constants(rules_for(x)))) for x in ("en", "sr")]
    return spark.createDataFrame(rows, "language string, lexicon string, rules int, constants int")


def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, float(v), render.plain_number(v)) for k, v in declared_constants(calibration=True)], "id string, value double, shown string")


def markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.markdown(check.checked(docs(spark, sf_dir)))


def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.json_reports(check.checked(docs(spark, sf_dir)))
    of = lambda path: F.get_json_object("json", path)
    n = lambda path, kind: F.size(F.coalesce(F.from_json(of(path), f"array<{kind}>"), F.array().cast(f"array<{kind}>"))).cast("long")
    rows = rows.select("doc_id", of("$.language").alias("language"), of("$.wordCount").cast("long").alias("words"), of("$.score").cast("double").alias("score"), of("$.lexiconVersion").alias("lexicon"), n("$.rules", "struct<rule:string>").alias("n_rules"), n("$.abstentions", "struct<rule:string>").alias("n_left"), n("$.hardFailures", "string").alias("n_failed"))
    return rounded(rows, "score")


def html_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.html(check.checked(docs(spark, sf_dir)))
    n = lambda pattern: F.regexp_count("html", F.lit(pattern)).cast("long")
    return rows.select("doc_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("score"), *(n(f'<section class="{x}">').alias(f"n_{x}") for x in ("failed", "left", "scored")), n("<li>").alias("n_items"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels made from the sentences: C, E and H for those that hold `the `, `an` and `ing`."""
    marks = F.filter(F.array(*(F.when(F.contains("sentence", F.lit(x)), F.lit(m)) for m, x in (("C", "the "), ("E", "an"), ("H", "ing")))), lambda m: m.isNotNull())
    return trace.labelled_sentences(docs(spark, sf_dir)).select("doc_id", "idx", F.col("sentence").alias("text"), marks.alias("marks"))


def claim_locates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.claim_locates(_located(spark, sf_dir), _labels(spark, sf_dir), field="middle as is"), "claim_density")


def hype_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.mark_recall(_located(spark, sf_dir), _labels(spark, sf_dir), "H", "end")
    return rounded(rows.withColumn("missed", F.array_join(F.col("missed").cast("array<string>"), ",")), "recall")


def match_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.match_totals(_quoted(spark, sf_dir))


def label_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.indices_for(_labels(spark, sf_dir), "E")


def label_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels with some texts changed, the second of each document twice, and a sentence behind the last one."""
    own = _labels(spark, sf_dir).withColumn("text", F.when(F.col("idx") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    behind = own.groupBy("doc_id").agg((F.max("idx") + 1).cast("int").alias("idx")).select("doc_id", "idx", F.lit("x").alias("text"), F.array().cast("array<string>").alias("marks"))
    return labels.check_labels(own.union(own.where("idx = 2")).union(behind), trace.labelled_sentences(docs(spark, sf_dir)))


def sentence_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _quoted(spark, sf_dir).where("match = 'exact'").select("doc_id", "field", F.col("start").alias("offset"))
    return labels.sentence_at(places, trace.labelled_sentences(docs(spark, sf_dir)))


def worksheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.worksheets(trace.labelled_sentences(docs(spark, sf_dir)))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    usage = rows.select(F.when(F.col("role") == "user", "large").when(F.col("role") == "assistant", "small").otherwise("unlisted").alias("model"), "conv_id", F.length("text").alias("input_tokens"), (F.col("turn") * 10).alias("output_tokens"), F.lit(1).alias("cache_write"), F.col("turn").alias("cache_read"))
    rates = spark.createDataFrame([("large", 5.0, 25.0), ("small", 1.0, 5.0)], "model string, input_per_mtok double, output_per_mtok double")
    return rounded(costs.usage_totals(usage, F.broadcast(rates), "conv_id").select("conv_id", "model", F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"), "cost", "unknown_reason"), "cost")


def retry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.floor(F.col("event_id") / 300).alias("call"))
    return costs.retries(rows, "user_id")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    return rows.select("doc_id", sources.submission_status(F.col("text"), 5000, F.col("doc_id") % 5 != 0).alias("status"), sources.via(F.substring("text", 1, 20)).alias("via"))


def extraction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select("page_id", sources.extraction_status(F.col("text")).alias("reason"))


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.concat(F.lit('a "'), "source", F.lit('"')).alias("subject"), "n_chars")
    return sources.with_frontmatter(rows, {"subject": "subject", "language": "lang", "words": "n_chars"}).select("doc_id", F.md5(F.col("document").cast("binary")).alias("document_md5"))


def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(K.normalise(F.col("text")).cast("binary")).alias("normalised_md5"), render.collapsed(F.col("text")).alias("collapsed"))


_PAIRS = {
    "em_dash": of_rules("em-dash-density"),
    "bold_ratio": of_rules("bold-ratio"),
    "bullet_bold": of_rules("bullet-bold-shape"),
    "rule_of_three": of_rules("rule-of-three"),
    "participial_close": of_rules("participial-close"),
    "verbal_adverb_close": of_rules("verbal-adverb-close"),
    "negative_parallelism": of_rules("negative-parallelism"),
    "formal_address": of_rules("formal-address"),
    "diacritics_hard": of_rules("diacritics"),
    "sentence_uniformity": of_rules("sentence-uniformity"),
    "phrase_rule_custom_lexicon": of_rules("weasel-words", lexicons=CUSTOM),
    "except_suppression": of_rules("inflated-vocabulary", lexicons=CUSTOM),
    "rule_results": ((lambda spark, sf_dir: results(spark, sf_dir)), oracles.rule_results_sql()),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, (f, _) in _PAIRS.items()} | {
    f.__name__: f
    for f in (
        word_stats, sentence_stats, sentence_rows, detect_language, label_language, report, hard_failures, abstentions, findings_positions, topk_findings, span_merge, highlighted, observations, bands, verdicts,
        corpus_totals, html_extract, frontmatter, quote_checks, match_pivot, labelled_sentences, quote_sentence_join, evidence_recall_precision, pricing, rate_limiter, engine_info,
        constants, markdown_reports, json_reports, html_reports, claim_locates, hype_recall, match_totals, label_indices, label_problems, sentence_at, worksheets, usage_totals, retry_counts, submissions, extraction_gate, corpus_documents, normalised_texts,
    )
}
ORACLES: dict[str, str] = {k: sql for k, (_, sql) in _PAIRS.items()} | {
    "word_stats": oracles.WORDS, "sentence_stats": oracles.SENTENCES, "detect_language": oracles.DETECT, "label_language": oracles.LABEL_DETECT, "report": oracles.REPORT, "hard_failures": oracles.HARD, "abstentions": oracles.ABSTENTIONS,
    "observations": oracles.OBSERVATIONS, "bands": oracles.BANDS, "verdicts": oracles.VERDICTS, "corpus_totals": oracles.TOTALS, "html_extract": oracles.HTML, "frontmatter": oracles.FRONT, "quote_checks": oracles.QUOTES,
    "match_pivot": oracles.PIVOT, "findings_positions": oracles.FINDINGS, "topk_findings": oracles.TOP, "span_merge": oracles.spans_sql(CUSTOM), "highlighted": oracles.HIGHLIGHTED, "sentence_rows": oracles.SENTENCE_ROWS,
    "labelled_sentences": oracles.LABELLED_SENTENCES, "quote_sentence_join": oracles.QUOTE_SENTENCES, "evidence_recall_precision": oracles.RECALL, "rate_limiter": oracles.LIMITER, "pricing": oracles.PRICING,
    "engine_info": oracles.INFO, "constants": oracles.CONSTANTS, "markdown_reports": oracles.MARKDOWN, "json_reports": oracles.JSON, "html_reports": oracles.HTML_REPORTS, "claim_locates": oracles.CLAIM, "hype_recall": oracles.HYPE, "match_totals": oracles.MATCH_TOTALS,
    "label_indices": oracles.LABEL_INDICES, "label_problems": oracles.LABEL_PROBLEMS, "sentence_at": oracles.SENTENCE_AT, "worksheets": oracles.WORKSHEETS, "usage_totals": oracles.USAGE, "retry_counts": oracles.RETRIES, "submissions": oracles.SUBMISSIONS, "extraction_gate": oracles.GATE,
    "corpus_documents": oracles.CORPUS_DOCUMENTS, "normalised_texts": oracles.NORMALISED,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all documents."""
    return report(spark, sf_dir)
