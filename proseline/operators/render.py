"""Reports as text: Markdown, JSON and HTML documents of checked rows, and of a calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseline.functions.kernel import WS, trim
from proseline.functions.lexicon import Lexicon
from proseline.functions.shipped import SHIPPED
from proseline.operators.rules import RULES, Rule, declared_constants, rules_for
from proseline.operators.spans import escape_html


def collapsed(text: Column, most: int = 90) -> Column:
    """White space collapsed; what is longer than `most` characters ends in an ellipsis."""
    one = trim(F.regexp_replace(text, rf"{WS}+", " "))
    return F.when(F.length(one) > most, F.concat(F.left(one, F.lit(most - 3)), F.lit("…"))).otherwise(one)


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, halves rounded up."""
    return F.format_string(f"%.{digits}f", F.floor(x * 10**digits + 0.5) / 10**digits)


def plain_number(x: float) -> str:
    """A constant as text: whole numbers without a point."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def constants_footer(rules: list[Rule] | tuple[Rule, ...] = RULES, calibration: bool = False) -> str:
    """The constants of a run that no corpus has set, by id."""
    found = declared_constants(rules, calibration)
    if not found:
        return "No constant of this run is uncalibrated."
    return f"{len(found)} uncalibrated constant{'' if len(found) == 1 else 's'} in this run:\n" + "\n".join(f"- {k} = {plain_number(v)}" for k, v in found)


def _by_language(make, rules: tuple[Rule, ...]) -> Column:
    return F.when(F.col("language") == "sr", make(rules_for("sr", rules), "sr")).when(F.col("language") == "en", make(rules_for("en", rules), "en"))


def _identity(lexicons: dict[str, Lexicon]) -> Column:
    return F.when(F.col("language") == "sr", lexicons["sr"].identity()).when(F.col("language") == "en", lexicons["en"].identity())


def _split(rules: str = "rules") -> dict[str, Column]:
    hard = lambda r: (r["kind"] == "hard") & (r["outcome"] == "scored")
    return {
        "failed": F.filter(rules, lambda r: hard(r) & ~r["passed"]), "passed": F.filter(rules, lambda r: hard(r) & r["passed"]), "left": F.filter(rules, lambda r: r["outcome"] == "abstained"),
        "observed": F.filter(rules, lambda r: (r["outcome"] == "abstained") & (F.size(r["findings"]) > 0)), "scored": F.filter(rules, lambda r: (r["kind"] == "density") & (r["outcome"] == "scored")),
    }


def _joined(rows: Column, one, between: str = "\n") -> Column:
    return F.array_join(F.transform(rows, one), between)


def _section(rows: Column, head: str | Column, body: Column) -> Column:
    """A part with a head, empty where there are no rows."""
    return F.when(F.size(rows) > 0, F.concat(F.lit(head) if isinstance(head, str) else head, F.lit("\n\n"), body)).otherwise("")


def markdown(done: DataFrame, key: str = "doc_id", shown: int = 3, basis: str | None = None, lexicons: dict[str, Lexicon] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, markdown) of checked documents.

    Score, number of scored density rules, words, language and lexicon; the
    basis of the language if its column is named; hard failures; what wasn't
    measured, before all scores, and what was seen there; the table of
    densities; the first findings of each rule that has any or isn't clean;
    the constants.
    """
    part = _split()
    quotes = lambda r: F.concat(
        _joined(F.slice(r["findings"], 1, shown), lambda f: F.concat(F.lit("- "), collapsed(f["text"]))),
        F.when(F.size(r["findings"]) > shown, F.concat(F.lit("\n- and "), (F.size(r["findings"]) - shown).cast("string"), F.lit(" more"))).otherwise(""),
    )
    rule = lambda head: lambda r: F.concat(F.lit("### "), head(r), F.lit("\n\n"), r["reason"], F.when(F.size(r["findings"]) > 0, F.concat(F.lit("\n\n"), quotes(r))).otherwise(""))
    loud = F.filter(part["scored"], lambda r: (F.size(r["findings"]) > 0) | (r["score"] < 1))
    n = F.size(part["scored"])
    parts = [
        F.concat(F.lit("# Report: "), F.col(key).cast("string")),
        F.concat(F.lit("**"), F.coalesce(fixed(F.col("score"), 3), F.lit("not scored")), F.lit("** over "), counted(n, "density rule", "density rules"), F.lit(" · "), counted(F.col("word_count"), "word", "words"), F.lit(" · "), F.col("language"), F.lit(" · lexicon "), _identity(lexicons or SHIPPED)),
        F.concat(F.lit("Language detected: "), F.col(basis)) if basis else F.lit(""),
        F.when(F.size(part["failed"]) > 0, F.concat(F.lit("## Hard failures\n\n"), _joined(part["failed"], rule(lambda r: r["rule"]), "\n\n"))).otherwise(F.concat(F.lit("Hard rules: "), F.when(F.size(part["passed"]) > 0, F.concat(F.size(part["passed"]).cast("string"), F.lit(" passed"))).otherwise("none measured"))),
        _section(part["left"], F.concat(F.lit("## Not measured ("), F.size(part["left"]).cast("string"), F.lit(")")), _joined(part["left"], lambda r: F.concat(F.lit("- "), r["rule"], F.lit(": "), r["reason"]))),
        _section(part["observed"], "### Observed, not scored", _joined(part["observed"], lambda r: F.concat(F.lit("**"), r["rule"], F.lit("**: "), F.size(r["findings"]).cast("string"), F.lit("\n\n"), quotes(r)), "\n\n")),
        _section(part["scored"], "## Density rules", F.concat(F.lit("| rule | score | measured | findings |\n| --- | --- | --- | --- |\n"), _joined(part["scored"], lambda r: F.concat(F.lit("| "), r["rule"], F.lit(" | "), fixed(r["score"], 2), F.lit(" | "), F.coalesce(fixed(r["per_thousand"], 2), F.lit("-")), F.lit(" | "), F.size(r["findings"]).cast("string"), F.lit(" |"))))),
        F.when(F.size(loud) > 0, _joined(loud, rule(lambda r: F.concat(r["rule"], F.lit(" "), fixed(r["score"], 2))), "\n\n")).otherwise(""),
        F.concat(F.lit("---\n\n"), _by_language(lambda own, _: F.lit(constants_footer(own)), rules)),
    ]
    rows = with_score(done)
    return rows.select(key, F.concat(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n"), F.lit("\n")).alias("markdown"))


def with_score(done: DataFrame) -> DataFrame:
    """done with its report's score, by weights of 1."""
    scored = F.filter("rules", lambda r: (r["kind"] == "density") & (r["outcome"] == "scored"))
    total = F.aggregate(scored, F.lit(0.0), lambda a, r: a + r["score"])
    return done.withColumn("score", F.when(F.size(scored) > 0, total / F.greatest(F.size(scored), F.lit(1))))


def json_reports(done: DataFrame, key: str = "doc_id", lexicons: dict[str, Lexicon] | None = None) -> DataFrame:
    """(key, json): the report of each document as one JSON object."""
    part = _split()
    report = F.struct(
        "language", F.col("word_count").alias("wordCount"), "score", F.transform(part["failed"], lambda r: r["rule"]).alias("hardFailures"), F.transform(part["left"], lambda r: F.struct(r["rule"].alias("rule"), r["reason"].alias("reason"))).alias("abstentions"),
        _identity(lexicons or SHIPPED).alias("lexiconVersion"),
        F.transform("rules", lambda r: F.struct(r["rule"].alias("rule"), r["kind"].alias("kind"), r["outcome"].alias("outcome"), r["score"].alias("score"), r["passed"].alias("passed"), r["per_thousand"].alias("perThousand"), r["reason"].alias("reason"), r["findings"].alias("findings"))).alias("rules"),
    )
    return with_score(done).select(key, F.to_json(report, {"ignoreNullFields": "false"}).alias("json"))


def html(done: DataFrame, key: str = "doc_id", shown: int = 5) -> DataFrame:
    """(key, html): the same report as a page, with the first five findings of each rule."""
    part = _split()
    items = lambda r: F.concat(F.lit("<ul>"), _joined(F.slice(r["findings"], 1, shown), lambda f: F.concat(F.lit("<li>"), escape_html(collapsed(f["text"])), F.lit("</li>")), ""), F.when(F.size(r["findings"]) > shown, F.concat(F.lit("<li>and "), (F.size(r["findings"]) - shown).cast("string"), F.lit(" more</li>"))).otherwise(""), F.lit("</ul>"))
    rows = lambda x, css: _joined(x, lambda r: F.concat(F.lit(f'<section class="{css}"><h2>'), r["rule"], F.coalesce(F.concat(F.lit(" "), fixed(r["score"], 2)), F.lit("")), F.lit("</h2><p>"), escape_html(r["reason"]), F.lit("</p>"), F.when(F.size(r["findings"]) > 0, items(r)).otherwise(""), F.lit("</section>")), "")
    page = F.concat(F.lit("<!doctype html><html><body><h1>"), F.coalesce(fixed(F.col("score"), 3), F.lit("not scored")), F.lit("</h1>"), rows(part["failed"], "failed"), rows(part["left"], "left"), rows(part["scored"], "scored"), F.lit("</body></html>\n"))
    return with_score(done).select(key, page.alias("html"))


def finding_line(row: str = "f") -> Column:
    """One finding as line:column and its text."""
    return F.concat(F.col(f"{row}.line").cast("string"), F.lit(":"), F.col(f"{row}.column").cast("string"), F.lit(" "), collapsed(F.col(f"{row}.finding")))


def calibration(verdicts: DataFrame, totals: DataFrame | None = None) -> str:
    """A calibration as Markdown: a table of the verdicts, and lists of the rules without signal and of those whose corpora overlap.

    There is a row for each rule and language, a fixed number.
    """
    rows = sorted(verdicts.collect(), key=lambda r: (r["language"], r["rule"]))
    show = lambda x: "-" if x is None else f"{x:.2f}"
    out = ["# Calibration", ""]
    if totals is not None:
        for r in sorted(totals.collect(), key=lambda r: (r["language"] or "", r["provenance"] or "")):
            out.append(f"- {r['language'] or 'all'}, {r['provenance'] or 'all'}: {r['docs']} documents, {r['words'] or 0} words")
        out.append("")
    out += ["| language | rule | accepted | generated | floor | ceiling | margin | verdict |", "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    out += [f"| {r['language']} | {r['rule']} | {r['accepted_n']} | {r['generated_n']} | {show(r['floor'])} | {show(r['ceiling'])} | {show(r['margin'])} | {r['status']} |" for r in rows]
    for status, head in (("no-signal", "No signal"), ("overlaps", "Overlap"), ("insufficient", "Too few documents")):
        own = [r for r in rows if r["status"] == status]
        if own:
            out += ["", f"## {head}", "", *(f"- {r['language']}: {r['rule']}" for r in own)]
    return "\n".join(out) + "\n\n" + constants_footer(calibration=True) + "\n"
