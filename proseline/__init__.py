"""Documents graded against a declarative style guide, as DataFrames. The names here are the public interface."""

from proseline.functions.lexicon import Entry, Lexicon, load_lexicon, parse_lexicon
from proseline.operators.check import checked, findings, reports, rule_results, top_findings
from proseline.operators.language import detect
from proseline.operators.render import html, json_reports, markdown
from proseline.operators.rules import RULES, Rule, rules_for

__all__ = ["RULES", "Entry", "Lexicon", "Rule", "checked", "detect", "findings", "html", "json_reports", "load_lexicon", "markdown", "parse_lexicon", "reports", "rule_results", "rules_for", "top_findings"]
