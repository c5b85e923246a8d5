"""The registry of rules: each builds a struct column from a text and its word count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseline.functions import kernel as K
from proseline.functions.lexicon import Lexicon, quick_phrase
from proseline.operators.language import has_diacritics

#: Score from which a rule counts as passed.
PASS = 0.8
#: Findings up to which a short text abstains.
FEW = 1


def gate_words(ceiling: float) -> int:
    """Words from which one finding alone stays under the ceiling."""
    return int(1000 // ceiling) + 1 if ceiling > 0 else 0


@dataclass(frozen=True)
class Rule:
    """A rule in two steps, so that the plan stays linear in the number of rules.

    find(source, lexicon) gives SQL for the findings; grade(findings, row)
    gives the rule's struct from them and from what a Row holds.
    """

    name: str
    kind: str
    languages: tuple[str, ...]
    find: Callable[[Source, Lexicon], str]
    grade: Callable[[Column, Row], Column]
    constants: tuple[tuple[str, float], ...] = ()
    weight: float = 1.0


@dataclass(frozen=True)
class Source:
    """The names of a text column, and of its folded form for plain searches."""

    text: str
    low: str

    def has(self, *strings: str) -> str | None:
        return " AND ".join(f"contains({self.low}, {K.quoted(x)})" for x in strings) or None


@dataclass(frozen=True)
class Row:
    text: Column
    words: Column
    lengths: Column
    deviation: Column


def result(rule: str, kind: str, findings: Column, measure: Column, score: Column, abstains: Column, min_words: Column, reason: Column) -> Column:
    scored = F.when(~abstains, score)
    return F.struct(
        F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.when(abstains, "abstained").otherwise("scored").alias("outcome"), findings.alias("findings"),
        F.when(~abstains, measure).alias("per_thousand"), scored.alias("score"), (scored >= PASS).alias("passed"),
        F.when(abstains, min_words).cast("int").alias("min_words"), reason.alias("reason"),
    )


def density(rule: str, findings: Column, words: Column, floor: float, ceiling: float, measure: Column | None = None, gated: bool = True) -> Column:
    n = F.size(findings)
    measure = K.per_thousand(n, words) if measure is None else measure
    gate = gate_words(ceiling)
    abstains = (words < gate) & (n <= FEW) if gated else F.lit(False)
    reason = F.when(abstains, F.concat(F.lit("not scored: "), n.cast("string"), F.lit(f" found in too few words; needs {gate}, or two findings"))).otherwise(
        F.concat(n.cast("string"), F.lit(f" found; clean up to {floor:g}, zero from {ceiling:g}"))
    )
    return result(rule, "density", findings, measure.cast("double"), K.band_score(measure, floor, ceiling), abstains, F.lit(gate), reason)


def entry_findings(source: Source, lexicon: Lexicon, rule: str) -> str:
    """Hits of all entries, each counted for itself, without those that exceptions suppress, by offset."""
    found = []
    for e in lexicon.of(rule):
        sure = [f"rlike({source.text}, {K.quoted('(?iu)' + e.sure.replace(r'\s', K.WS))})"] if e.sure else []
        hits = K.find(source.text, e.pattern, needs=" AND ".join([*filter(None, [source.has(*e.literals)]), *sure]) or None)
        if e.unless:
            hits = K.without_contained(hits, *(K.find(source.text, p) for p in e.unless_pattern))
        found.append(hits)
    if not found:
        raise ValueError(f"lexicon {lexicon.language} has no entry for {rule}")
    if len(found) == 1:
        return rule_exceptions(found[0], source, lexicon, rule)
    return K.by_offset(rule_exceptions(f"concat({', '.join(found)})", source, lexicon, rule))


def rule_exceptions(findings: str, source: Source, lexicon: Lexicon, rule: str) -> str:
    phrases = lexicon.exceptions.get(rule, ())
    if not phrases:
        return findings
    return K.without_contained(findings, K.find(source.text, f"(?iu)(?:{'|'.join(quick_phrase(p) for p in phrases)})"))


def lexicon_rule(name: str, floor: float, ceiling: float, constants: tuple = ()) -> Rule:
    return Rule(name, "density", ("sr", "en"), lambda t, lex: entry_findings(t, lex, name), lambda f, row: density(name, f, row.words, floor, ceiling), constants)


def pattern_rule(name: str, languages: tuple[str, ...], pattern: str, floor: float, ceiling: float, needs: str) -> Rule:
    """A pattern of three groups, what precedes the finding, the finding and what follows; rule exceptions of the lexicon apply."""
    constants = ((f"{name}.floor", floor), (f"{name}.ceiling", ceiling))
    return Rule(name, "density", languages, lambda t, lex: rule_exceptions(K.find(t.text, pattern, True, t.has(needs)), t, lex, name), lambda f, row: density(name, f, row.words, floor, ceiling), constants)


# The patterns of the rules.
FORMAL = r"(?=V)(?<![\p{L}])V(?:i|as|am|ama|aš\p{L}{0,4}|aše\p{L}{0,3})(?![\p{L}])"
LINE_BLANK = K.WS.replace(r"\s", r"\x20\t\r\f")
#: What may stand before a word in mid-sentence: neither nothing, nor an end of a sentence, nor an opening quote or bracket.
MID_SENTENCE = rf"[^\n\s.!?…:\"'“„«(\[]{LINE_BLANK}*\z"


def _none(_: Source, __: Lexicon) -> str:
    return K.NONE_FOUND


def _grade_diacritics(f: Column, row: Row) -> Column:
    few = row.words < 40
    return result("diacritics", "hard", f, F.lit(None).cast("double"), F.when(has_diacritics(row.text), 1.0).otherwise(0.0), few, F.lit(40), F.when(few, "not measured: needs 40 words").otherwise("letters with diacritics looked for"))


def _find_formal(source: Source, _: Lexicon) -> str:
    before = "concat(CASE WHEN fi > 1 THEN right(ps[fi - 2], 1) ELSE '' END, ps[fi - 1])"  # as far back as the last match's end
    return K.find(source.text, FORMAL, needs=f"contains({source.text}, 'V')", where=f"rlike({before}, {K.quoted(MID_SENTENCE)})")


def _grade_formal(f: Column, row: Row) -> Column:
    return result("formal-address", "hard", f, F.lit(None).cast("double"), F.when(F.size(f) == 0, 1.0).otherwise(0.0), F.lit(False), F.lit(None), F.concat(F.size(f).cast("string"), F.lit(" capitals in mid-sentence")))


def _find_bold(source: Source, _: Lexicon) -> str:
    stars, lines = K.find(source.text, r"(\*\*)([^*\n]+)(\*\*)", True, source.has("**")), K.find(source.text, r"(__)([^_\n]+)(__)", True, source.has("__"))
    return K.by_offset(f"concat({stars}, {lines})")


def _grade_bold(f: Column, row: Row) -> Column:
    bold = F.aggregate(f, F.lit(0), lambda a, h: a + K.utf16(h["text"]))
    share = F.when(F.size(f) == 0, 0.0).otherwise(K.per_thousand(bold, K.utf16(row.text)))
    return density("bold-ratio", f, row.words, 20.0, 120.0, share, gated=False)


def _grade_uniformity(f: Column, row: Row) -> Column:
    sd, few = row.deviation, F.size(row.lengths) < 6
    return result("sentence-uniformity", "density", f, sd, F.least(F.lit(1.0), sd / 6.0), few, F.lit(None), F.when(few, "not measured: needs 6 sentences").otherwise("deviation of sentence lengths"))


_PHRASE = (("density.phrase-floor", 1.0), ("density.phrase-ceiling", 6.0))
END = r"[ \t]*(?=[.!?…]|\n|\z)"
#: All rules in the order of reports.
RULES: tuple[Rule, ...] = (
    Rule("diacritics", "hard", ("sr",), _none, _grade_diacritics, (("diacritics.min-words", 40.0),)),
    Rule("formal-address", "hard", ("sr",), _find_formal, _grade_formal),
    lexicon_rule("negative-parallelism", 0.5, 3.0, (("negative-parallelism.floor", 0.5), ("negative-parallelism.ceiling", 3.0))),
    *(lexicon_rule(n, 1.0, 6.0, _PHRASE) for n in ("weasel-words", "editorializing", "promotional-tone", "inflated-vocabulary", "summary-close")),
    lexicon_rule("transition-density", 4.0, 20.0, (("transition-density.floor", 4.0), ("transition-density.ceiling", 20.0))),
    lexicon_rule("rule-of-three", 2.0, 12.0, (("rule-of-three.floor", 2.0), ("rule-of-three.ceiling", 12.0))),
    pattern_rule("bullet-bold-shape", ("sr", "en"), r"((?<![^\n\r  ])[ \t]*[-*+][ \t]+)(\*\*[^*\n]+\*\*:?)([ \t]*\S)", 2.0, 20.0, "**"),
    pattern_rule("verbal-adverb-close", ("sr",), rf"(?<![\p{{L}}])()(\p{{L}}{{2,}}(?:jući|ći))({END})", 1.5, 8.0, "ći"),
    pattern_rule("participial-close", ("en",), rf"(,[ \t]+)(\p{{L}}{{3,}}ing)((?![\p{{L}}])[^.!?\n]{{0,120}}?{END})", 2.0, 12.0, "ing"),
    Rule("em-dash-density", "density", ("sr", "en"), lambda t, _: K.find(t.text, "—", needs=f"contains({t.text}, '—')"), lambda f, row: density("em-dash-density", f, row.words, 2.0, 15.0), (("em-dash-density.floor", 2.0), ("em-dash-density.ceiling", 15.0))),
    Rule("bold-ratio", "density", ("sr", "en"), _find_bold, _grade_bold, (("bold-ratio.floor", 20.0), ("bold-ratio.ceiling", 120.0))),
    Rule("sentence-uniformity", "density", ("sr", "en"), _none, _grade_uniformity, (("sentence-uniformity.target-sd", 6.0), ("sentence-uniformity.min-sentences", 6.0))),
)
ORDER = {r.name: i + 1 for i, r in enumerate(RULES)}


def rules_for(language: str, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    return [r for r in rules if language in r.languages]


def declared_constants(rules: list[Rule] | tuple[Rule, ...] = RULES, calibration: bool = False) -> list[tuple[str, float]]:
    """Constants that the rules declare, each once, by id. An id with two values raises."""
    found: dict[str, float] = {}
    more = (("report.pass-threshold", PASS), *((("calibrate.min-docs", 10.0),) if calibration else ()))
    for name, value in [c for r in rules for c in r.constants] + list(more):
        if found.setdefault(name, value) != value:
            raise ValueError(f"{name} has two values")
    return sorted(found.items())
