"""DuckDB SQL for the queries, generated from the same rules and lexicons.

DuckDB's regular expressions have no lookaround. A boundary is consumed
instead; so that neighbours don't share one, each character that isn't part of
a word stands twice in the text that phrases are looked for in.
"""

from __future__ import annotations

import re

from proseline.functions.lexicon import Entry, Lexicon
from proseline.functions.shipped import DIACRITICS, SHIPPED, STOPWORDS
from proseline.operators.rules import ORDER, RULES, gate_words
from proseline.operators.trace import ABBREVIATIONS, ENGLISH

WORD = r"\p{L}[\p{L}\p{N}'’-]*"
TWICE = r"regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g')"
BOUNDS = {"negative-parallelism": (0.5, 3.0), "transition-density": (4.0, 20.0), "rule-of-three": (2.0, 12.0), "bullet-bold-shape": (2.0, 20.0), "verbal-adverb-close": (1.5, 8.0), "participial-close": (2.0, 12.0), "em-dash-density": (2.0, 15.0), "bold-ratio": (20.0, 120.0)} | {
    k: (1.0, 6.0) for k in ("weasel-words", "editorializing", "promotional-tone", "inflated-vocabulary", "summary-close")
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(pattern: str, text: str = "text", group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def count(pattern: str, text: str = "text") -> str:
    return f"len({matches(pattern, text)})"


def phrase_count(phrase: str) -> str:
    stem, star = (phrase[:-1], r"\p{L}{0,4}") if phrase.endswith("*") else (phrase, "")
    words = ["".join("['’]['’]" if c in "'’" else c if re.match(r"\w", c) else re.escape(c) * 2 for c in w) for w in stem.split()]
    return count(rf"(?i)(?:^|[^\p{{L}}\p{{N}}_]){r'\s+'.join(words)}{star}(?:$|[^\p{{L}}\p{{N}}_])", "t2")


# the lexicons' patterns with their boundaries consumed
PATTERNS = {
    ("en", "negative-parallelism"): [r"(?i)(?:^|[^\p{L}])not\s+just[^\p{L}.!?\n](?:[^.!?\n]{0,78}?[^\p{L}.!?\n])?but(?:$|[^\p{L}])", r"(?i)(?:^|[^\p{L}])it[’']?s\s+not(?:[^\p{L}.!?\n][^.!?\n]{0,59}?)?,\s*it[’']?s(?:$|[^\p{L}])"],
    ("sr", "negative-parallelism"): [r"(?i)(?:^|[^\p{L}])nije[^\p{L}.!?\n](?:[^.!?\n]{0,78}?[^\p{L}.!?\n])?(?:već|nego)(?:$|[^\p{L}])", r"(?i)(?:^|[^\p{L}])ne\s+samo[^\p{L}.!?\n](?:[^.!?\n]{0,78}?[^\p{L}.!?\n])?(?:već|nego)(?:$|[^\p{L}])"],
    ("en", "rule-of-three"): [r"(?i)(?:^|[^\p{L}])\p{L}{3,}(?:[ \t]+\p{L}+){0,2},\s+\p{L}{3,}(?:[ \t]+\p{L}+){0,2},?\s+and\s+\p{L}{3,}"],
    ("sr", "rule-of-three"): [r"(?i)(?:^|[^\p{L}])\p{L}{3,}(?:[ \t]+\p{L}+){0,2},\s+\p{L}{3,}(?:[ \t]+\p{L}+){0,2}\s+i\s+\p{L}{3,}"],
}
PARTICIPIAL = r",[ \t]+(\p{L}{3,}ing)(?:[^\p{L}.!?\n][^.!?\n]{0,119}?)?[ \t]*(?:[.!?…\n]|$)"
VERBAL = r"(?:^|[^\p{L}])(\p{L}{2,}(?:jući|ći))[ \t]*(?:[.!?…\n]|$)"
FORMAL = "(?:[^\\s.!?…:\"'“„«(\\[][ \\t]+|[^\\s\\p{L}.!?…:\"'“„«(\\[])V(?:i|as|am|ama|aš\\p{L}{0,4}|aše\\p{L}{0,3})(?:$|[^\\p{L}])"
BOLD = (r"\*\*([^*\n]+)\*\*", r"__([^_\n]+)__")
BULLET = r"(?m)^[ \t]*[-*+][ \t]+\*\*[^*\n]+\*\*:?[ \t]*\S"


def entry_count(e: Entry, language: str, rule: str, i: int) -> str:
    if e.kind == "pattern":
        return count(PATTERNS[language, rule][i])
    return " - ".join([phrase_count(e.source), *map(phrase_count, e.unless)])


def lexicon_count(lexicon: Lexicon, rule: str) -> str:
    return " + ".join(entry_count(e, lexicon.language, rule, i) for i, e in enumerate(lexicon.of(rule)))


def without(pattern: str, words: tuple[str, ...]) -> str:
    return f"len(list_filter({matches(pattern, 'text', 1)}, lambda x: lower(x) NOT IN ({', '.join(map(q, words))})))"


def count_of(rule: str, language: str, lexicon: Lexicon) -> str:
    if rule in ("diacritics", "sentence-uniformity"):
        return "0"
    special = {"formal-address": lambda: count(FORMAL), "participial-close": lambda: without(PARTICIPIAL, lexicon.exceptions.get(rule, ())), "verbal-adverb-close": lambda: without(VERBAL, lexicon.exceptions.get(rule, ())), "em-dash-density": lambda: count("—"), "bold-ratio": lambda: " + ".join(map(count, BOLD)), "bullet-bold-shape": lambda: count(BULLET)}
    return special[rule]() if rule in special else lexicon_count(lexicon, rule)


def votes(language: str) -> str:
    return f"len(list_filter(tokens, lambda x: x IN ({', '.join(map(q, STOPWORDS[language]))})))"


LENGTHS = (
    "list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\n([ \\t]*(?:#{1,6}[ \\t]|[-*+][ \\t]|>[ \\t]|\\d+[.)][ \\t]))', '¦\\1', 'g'), "
    f"'[.!?…]+|\\n[ \\t]*\\n|¦'), lambda x: {count(WORD, 'x')}), lambda n: n > 0)"
)
BOLD_CHARS = " + ".join(f"coalesce(list_sum(list_transform({matches(p, 'text', 1)}, lambda x: length(x))), 0)" for p in BOLD)

#: Documents with their language, words, sentence lengths and bold characters.
DOCS = f"""
tok AS (SELECT doc_id, text, list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+')) AS tokens, {TWICE} AS t2 FROM documents),
vote AS (SELECT doc_id, text, t2, {votes('sr')} AS sr_votes, {votes('en')} AS en_votes, regexp_matches(text, '[{DIACRITICS}]') AS marks FROM tok),
d AS (SELECT doc_id, text, t2, sr_votes, en_votes, marks, CASE WHEN sr_votes > en_votes THEN 'sr' WHEN sr_votes < en_votes THEN 'en' WHEN marks THEN 'sr' ELSE 'en' END AS language,
  {count(WORD)} AS words, {LENGTHS} AS lens, {BOLD_CHARS} AS bold, length(text) AS chars FROM vote)"""


def _rule_select(rule: str, language: str, lexicons: dict[str, Lexicon]) -> str:
    spec = next(r for r in RULES if r.name == rule)
    n = count_of(rule, language, lexicons[language])
    head = f"SELECT doc_id, language, {q(rule)} AS rule, {ORDER[rule]} AS rule_ord, {q(spec.kind)} AS kind, CAST({n} AS INTEGER) AS n_findings, words"
    if rule == "diacritics":
        rest = "words < 40 AS abstains, 40 AS gate, CAST(NULL AS DOUBLE) AS dens, CASE WHEN marks THEN 1.0 ELSE 0.0 END AS raw"
    elif rule == "formal-address":
        rest = f"false AS abstains, 0 AS gate, CAST(NULL AS DOUBLE) AS dens, CASE WHEN {n} = 0 THEN 1.0 ELSE 0.0 END AS raw"
    elif rule == "sentence-uniformity":
        sd = "CASE WHEN len(lens) < 2 THEN 0.0 ELSE list_stddev_pop(lens) END"
        rest = f"len(lens) < 6 AS abstains, CAST(NULL AS INTEGER) AS gate, {sd} AS dens, least(1.0, ({sd}) / 6.0) AS raw"
    else:
        lo, hi = BOUNDS[rule]
        dens = "CASE WHEN chars = 0 THEN 0.0 ELSE bold * 1000.0 / chars END" if rule == "bold-ratio" else f"CASE WHEN words = 0 THEN 0.0 ELSE ({n}) * 1000.0 / words END"
        abstains = "false" if rule == "bold-ratio" else f"(words < {gate_words(hi)} AND ({n}) <= 1)"
        rest = f"{abstains} AS abstains, {gate_words(hi)} AS gate, {dens} AS dens, CASE WHEN ({dens}) <= {lo} THEN 1.0 WHEN ({dens}) >= {hi} THEN 0.0 ELSE ({hi} - ({dens})) / {hi - lo} END AS raw"
    return f"{head}, {rest} FROM d WHERE language = {q(language)}"


def results_cte(lexicons: dict[str, Lexicon] | None = None, rules: list[str] | None = None) -> str:
    """WITH ... r: a row for each document and rule."""
    lexicons = lexicons or SHIPPED
    parts = [_rule_select(r.name, x, lexicons) for x in ("sr", "en") for r in RULES if x in r.languages and (rules is None or r.name in rules)]
    return f"WITH {DOCS},\nraw_r AS ({' UNION ALL '.join(parts)}),\n" + (
        "r AS (SELECT doc_id, language, rule, rule_ord, kind, n_findings, words, CASE WHEN abstains THEN 'abstained' ELSE 'scored' END AS outcome, "
        "CASE WHEN NOT abstains THEN CAST(dens AS DOUBLE) END AS per_thousand, CASE WHEN NOT abstains THEN CAST(raw AS DOUBLE) END AS score, CASE WHEN NOT abstains THEN raw >= 0.8 END AS passed, CASE WHEN abstains THEN CAST(gate AS INTEGER) END AS min_words FROM raw_r)"
    )


def rule_results_sql(lexicons=None, rules=None) -> str:
    return f"{results_cte(lexicons, rules)}\nSELECT doc_id, language, rule, kind, outcome, n_findings, round(per_thousand, 9) AS per_thousand, round(score, 9) AS score, passed, min_words FROM r"


REPORT = f"""{results_cte()}
SELECT doc_id, language, CAST(max(words) AS BIGINT) AS word_count, round(avg(score) FILTER (WHERE kind = 'density'), 9) AS score, count(*) FILTER (WHERE kind = 'hard' AND NOT passed) AS n_hard_failures,
  count(*) FILTER (WHERE outcome = 'abstained') AS n_abstentions, CAST(sum(n_findings) AS BIGINT) AS n_findings FROM r GROUP BY doc_id, language"""
HARD = f"{results_cte(rules=['diacritics', 'formal-address'])}\nSELECT doc_id, rule FROM r WHERE kind = 'hard' AND NOT passed"
ABSTENTIONS = f"{results_cte()}\nSELECT doc_id, rule, min_words FROM r WHERE outcome = 'abstained'"
_LABELLED = "m AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id), c AS (SELECT r.*, CASE WHEN m.quality = 1 THEN 'accepted' ELSE 'generated' END AS provenance FROM r JOIN m ON r.doc_id = m.doc_id WHERE kind = 'density' AND words >= 0)"
_OBSERVED = """o AS (SELECT language, rule, provenance, count(per_thousand) AS n, count(*) FILTER (WHERE outcome = 'abstained') AS excluded, min(per_thousand) AS least, max(per_thousand) AS most,
  quantile_cont(per_thousand, 0.1) AS p10, CASE WHEN count(per_thousand) >= 10 THEN quantile_cont(per_thousand, 0.5) END AS median, quantile_cont(per_thousand, 0.9) AS p90, max(min_words) AS min_words FROM c GROUP BY language, rule, provenance)"""
OBSERVATIONS = f"{results_cte()},\n{_LABELLED},\n{_OBSERVED}\nSELECT language, rule, provenance, n, excluded, round(least, 9) AS least, round(most, 9) AS most, round(p10, 9) AS p10, round(median, 9) AS median, round(p90, 9) AS p90, min_words FROM o"
_BANDS = """b AS (SELECT a.language AS language, a.rule AS rule, a.n AS accepted_n, coalesce(g.n, 0) AS generated_n, a.excluded AS accepted_excluded, coalesce(g.excluded, 0) AS generated_excluded, a.most AS a_most, a.p90 AS a_p90, g.least AS g_least, g.most AS g_most, g.p10 AS g_p10
  FROM (SELECT * FROM o WHERE provenance = 'accepted') a LEFT JOIN (SELECT * FROM o WHERE provenance = 'generated') g ON a.language = g.language AND a.rule = g.rule)"""
BANDS = f"{results_cte()},\n{_LABELLED},\n{_OBSERVED},\n{_BANDS}\nSELECT language, rule, accepted_n, generated_n, accepted_excluded, generated_excluded, round(a_p90, 9) AS accepted_p90, round(g_p10, 9) AS generated_p10 FROM b"
VERDICTS = f"""{results_cte()},\n{_LABELLED},\n{_OBSERVED},\n{_BANDS},
v AS (SELECT *, generated_n >= 10 AND g_least = 0 AND g_most = 0 AS silent, accepted_n = 0 OR generated_n = 0 AS empty, accepted_n < 10 OR generated_n < 10 AS few FROM b)
SELECT language, rule, accepted_n, generated_n, round(CASE WHEN coalesce(silent, false) OR NOT empty THEN a_p90 END, 9) AS floor,
  round(CASE WHEN coalesce(silent, false) THEN 0.0 WHEN NOT empty THEN g_p10 END, 9) AS ceiling, round(CASE WHEN NOT coalesce(silent, false) AND NOT empty THEN g_p10 - a_p90 END, 9) AS margin,
  CASE WHEN NOT coalesce(silent, false) AND NOT empty THEN g_least <= a_most END AS extremes_overlap,
  CASE WHEN coalesce(silent, false) THEN 'no-signal' WHEN empty OR few THEN 'insufficient' WHEN g_p10 - a_p90 > 0 THEN 'separates' ELSE 'overlaps' END AS status FROM v"""
TOTALS = f"""WITH {DOCS}, m AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
c AS (SELECT language, CASE WHEN quality = 1 THEN 'accepted' ELSE 'generated' END AS provenance, words FROM d JOIN m ON d.doc_id = m.doc_id)
SELECT language, provenance, count(*) AS docs, CAST(sum(words) AS BIGINT) AS words FROM c GROUP BY ROLLUP(language, provenance)"""
ASTRAL = "[\\x{10000}-\\x{10ffff}]"
WORDS = f"SELECT doc_id, CAST({count(WORD)} AS BIGINT) AS words, CAST(length(text) + {count(ASTRAL)} AS BIGINT) AS n_utf16, CAST({count(chr(10))} AS BIGINT) AS newlines FROM documents"
SENTENCES = f"WITH {DOCS} SELECT doc_id, CAST(len(lens) AS BIGINT) AS n_sentences, round(coalesce(list_avg(lens), 0), 9) AS mean_words, round(CASE WHEN len(lens) < 2 THEN 0.0 ELSE list_stddev_pop(lens) END, 9) AS sd FROM d"
DETECT = f"WITH {DOCS} SELECT doc_id, language, sr_votes, en_votes, CASE WHEN sr_votes <> en_votes THEN 'vote' WHEN marks THEN 'tie, diacritics' ELSE 'tie, default' END AS basis FROM d"
LABEL_DETECT = f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\p{{Cyrillic}}|[{DIACRITICS}]') THEN 'sr' ELSE 'en' END AS language FROM conversations"
PRICING = """WITH u AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'small' ELSE 'unlisted' END AS model,
  sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS i, sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END) AS o, count(*) AS w FROM conversations GROUP BY conv_id)
SELECT conv_id, model, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens,
  round(CASE model WHEN 'large' THEN ((i + w * 1.25) * 5.0 + o * 25.0) / 1e6 WHEN 'small' THEN ((i + w * 1.25) * 1.0 + o * 5.0) / 1e6 END, 9) AS cost, CASE WHEN model = 'unlisted' THEN 'unpriced' END AS unknown_reason FROM u"""
WS = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def squeezed(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g')))"


# quotes cut from the start, the middle and the end of a text, and what becomes of them when they are spaced, turned or written in another script
_QUOTES = f"""s AS (SELECT doc_id, text AS source, language, unnest([substring(text, 21, 60), substring(text, length(text) // 2 + 1, 60), right(text, 60)]) AS piece, unnest(['start', 'middle', 'end']) AS part FROM d),
kinds AS (SELECT doc_id, source, language, part, unnest(['as is', 'spaced', 'turned', 'script']) AS kind, unnest([piece, lower(replace(piece, ' ', '   ')), concat('zzqq ', reverse(piece)), concat('да ', piece)]) AS quote FROM s),
n AS (SELECT doc_id, source, language, concat(part, ' ', kind) AS field, quote, {squeezed('source')} AS ns, {squeezed('quote')} AS nq, len(list_filter(regexp_extract_all(lower(quote), '\\p{{L}}+'), lambda w: w IN ({', '.join(map(q, ENGLISH))}))) AS english,
  len(regexp_extract_all(quote, '\\p{{L}}+')) AS n_words, regexp_matches(quote, '\\p{{Cyrillic}}') AS qc, regexp_matches(source, '\\p{{Cyrillic}}') AS sc, regexp_matches(quote, '[{DIACRITICS}]') AS qd, regexp_matches(source, '[{DIACRITICS}]') AS sd FROM kinds WHERE length(trim(regexp_replace(quote, {q(WS)}, ' ', 'g'))) > 0),
k AS (SELECT doc_id, field, quote, source, CASE WHEN strpos(source, quote) > 0 THEN 'exact' WHEN strpos(ns, nq) > 0 THEN 'normalized' WHEN qc <> sc OR (language = 'sr' AND sd AND NOT qd AND n_words >= 5 AND english >= 2) THEN 'foreign' ELSE 'absent' END AS match,
  CASE WHEN strpos(source, quote) > 0 THEN strpos(source, quote) - 1 END AS exact_start FROM n)"""
QUOTES = f"WITH {DOCS},\n{_QUOTES} SELECT doc_id, field, match, CAST(exact_start AS INTEGER) AS exact_start, match IN ('exact', 'normalized') AS traced FROM k"
PIVOT = f"WITH {DOCS},\n{_QUOTES} SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE match = '{x}') AS \"{x}\"" for x in ("exact", "normalized", "foreign", "absent")) + " FROM k GROUP BY doc_id"
# The published identities of the lexicons, and the numbers of rules and of constants of a run.
INFO = """SELECT 'en' AS language, '0.3.0+0126033ab30f' AS lexicon, CAST(13 AS INTEGER) AS rules, CAST(19 AS INTEGER) AS constants
UNION ALL SELECT 'sr', '0.3.0+a1e590743b64', CAST(15 AS INTEGER), CAST(20 AS INTEGER)"""
FRONT = """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('---', chr(10), 'provenance: generated', chr(10), 'words: 3', chr(10), '---', chr(10), text) WHEN doc_id % 3 = 1 THEN concat('---', chr(10), 'subject: s', chr(10), '---', chr(10), text) ELSE text END AS raw, text FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'generated' ELSE 'accepted' END AS provenance, CAST(length(text) AS INTEGER) AS n FROM x"""


def _html() -> str:
    x = "regexp_replace(coalesce(html, ''), '<!--[\\s\\S]*?-->', ' ', 'g')"
    for tag in "script style noscript svg form nav header footer aside".split():
        x = f"regexp_replace({x}, '(?i)<{tag}\\b[\\s\\S]*?</{tag}>', ' ', 'g')"
    part = " ".join(f"WHEN regexp_matches(x, '(?i)<{t}\\b[^>]*>[\\s\\S]*?</{t}>') THEN regexp_extract(x, '(?i)<{t}\\b[^>]*>([\\s\\S]*?)</{t}>', 1)" for t in ("article", "main", "body"))
    y = "regexp_replace(regexp_replace(regexp_replace(y, '(?i)</(p|div|li|h[1-6]|blockquote|tr|section)>', chr(10) || chr(10), 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    from proseline.sources.documents import ENTITIES

    z = "z"
    for name, value in sorted(ENTITIES.items(), key=lambda kv: kv[0] == "amp"):
        z = f"regexp_replace({z}, '(?i)&{name};', {q(value)}, 'g')"
    out = f"regexp_replace(regexp_replace({z}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    blank = "[ \\t\\r\\f\\x{a0}]"
    return f"""WITH a AS (SELECT page_id, {x} AS x FROM pages), b AS (SELECT page_id, CASE {part} ELSE x END AS y FROM a), c AS (SELECT page_id, {y} AS z FROM b), e AS (SELECT page_id, {out} AS o FROM c)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(o, '{blank}+\\n', chr(10), 'g'), '\\n{blank}+', chr(10), 'g'), '^[\\s\\x{{a0}}]+', ''), '[\\s\\x{{a0}}]+$', '') AS text FROM e"""


HTML = _html()


# --- places of matches: gaps and groups of each match, summed up in order ---

NOT_WORD = r"[^\p{L}\p{N}_]"


def phrase_groups(phrase: str) -> str:
    stem, star = (phrase[:-1], r"\p{L}{0,4}") if phrase.endswith("*") else (phrase, "")
    words = ["".join("['’]['’]" if c in "'’" else c if re.match(r"\w", c) else re.escape(c) * 2 for c in w) for w in stem.split()]
    return rf"(?i)(^|{NOT_WORD})({r'\s+'.join(words)}{star})($|{NOT_WORD})"


GROUPS = {
    ("en", "negative-parallelism"): [r"(?i)(^|[^\p{L}])(not\s+just[^\p{L}.!?\n](?:[^.!?\n]{0,78}?[^\p{L}.!?\n])?but)($|[^\p{L}])", r"(?i)(^|[^\p{L}])(it[’']?s\s+not(?:[^\p{L}.!?\n][^.!?\n]{0,59}?)?,\s*it[’']?s)($|[^\p{L}])"],
    ("sr", "negative-parallelism"): [r"(?i)(^|[^\p{L}])(nije[^\p{L}.!?\n](?:[^.!?\n]{0,78}?[^\p{L}.!?\n])?(?:već|nego))($|[^\p{L}])", r"(?i)(^|[^\p{L}])(ne\s+samo[^\p{L}.!?\n](?:[^.!?\n]{0,78}?[^\p{L}.!?\n])?(?:već|nego))($|[^\p{L}])"],
    ("en", "rule-of-three"): [r"(?i)(^|[^\p{L}])(\p{L}{3,}(?:[ \t]+\p{L}+){0,2},\s+\p{L}{3,}(?:[ \t]+\p{L}+){0,2},?\s+and\s+\p{L}{3,})()"],
    ("sr", "rule-of-three"): [r"(?i)(^|[^\p{L}])(\p{L}{3,}(?:[ \t]+\p{L}+){0,2},\s+\p{L}{3,}(?:[ \t]+\p{L}+){0,2}\s+i\s+\p{L}{3,})()"],
}
RULE_GROUPS = {
    "participial-close": [r"(,[ \t]+)(\p{L}{3,}ing)((?:[^\p{L}.!?\n][^.!?\n]{0,119}?)?[ \t]*(?:[.!?…\n]|$))"],
    "verbal-adverb-close": [r"(^|[^\p{L}])(\p{L}{2,}(?:jući|ći))([ \t]*(?:[.!?…\n]|$))"],
    "formal-address": ["([^\\s.!?…:\"'“„«(\\[][ \\t]+|[^\\s\\p{L}.!?…:\"'“„«(\\[])(V(?:i|as|am|ama|aš\\p{L}{0,4}|aše\\p{L}{0,3}))($|[^\\p{L}])"],
    "em-dash-density": ["()(—)()"],
    "bold-ratio": [r"(\*\*)([^*\n]+)(\*\*)", r"(__)([^_\n]+)(__)"],
    "bullet-bold-shape": [r"(?m)(^[ \t]*[-*+][ \t]+)(\*\*[^*\n]+\*\*:?)([ \t]*\S)"],
}


def _places(language: str, rule: str, e: int, pattern: str, doubled: bool, without: tuple[str, ...] = ()) -> str:
    """Offsets of a pattern's second group; in the doubled text, half of the characters that aren't of words come off."""
    x, p = ("t2" if doubled else "text"), q(pattern)
    off = lambda y: f"length({y}) - (length({y}) - length(regexp_replace({y}, {q(NOT_WORD)}, '', 'g'))) // 2" if doubled else f"length({y})"
    some = f" WHERE lower(b) NOT IN ({', '.join(map(q, without))})" if without else ""
    whole = "sum(length(g) + length(a) + length(b) + length(c)) OVER w - length(b) - length(c)"
    odd = f"sum(length(concat(g, a, b, c)) - length(regexp_replace(concat(g, a, b, c), {q(NOT_WORD)}, '', 'g'))) OVER w - (length(concat(b, c)) - length(regexp_replace(concat(b, c), {q(NOT_WORD)}, '', 'g')))"
    start = f"{whole} - ({odd}) // 2" if doubled else whole
    return f"""SELECT doc_id, {q(language)} AS language, {q(rule)} AS rule, {e} AS e, CAST(o AS BIGINT) AS o, CAST(o + n AS BIGINT) AS z FROM (SELECT doc_id, b, {off('b')} AS n, {start} AS o FROM (
  SELECT doc_id, unnest(range(1, len(b) + 1)) AS i, unnest(g[:len(b)]) AS g, unnest(a) AS a, unnest(b) AS b, unnest(c) AS c FROM (SELECT doc_id, regexp_split_to_array({x}, {p}) AS g, regexp_extract_all({x}, {p}, 1) AS a, regexp_extract_all({x}, {p}, 2) AS b, regexp_extract_all({x}, {p}, 3) AS c FROM d WHERE language = {q(language)} AND regexp_matches({x}, {p})))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)){some}"""


def found_cte(lexicons: dict[str, Lexicon] | None = None) -> str:
    """WITH ... f: a row for each finding."""
    lexicons = lexicons or SHIPPED
    hits, spared = [], []
    for language, lexicon in lexicons.items():
        for r in RULES:
            if language not in r.languages:
                continue
            for e, pattern in enumerate(RULE_GROUPS.get(r.name, ())):
                hits.append(_places(language, r.name, e, pattern, False, lexicon.exceptions.get(r.name, ())))
            for e, entry in enumerate(lexicon.of(r.name)):
                hits.append(_places(language, r.name, e, phrase_groups(entry.source), True) if entry.kind == "phrase" else _places(language, r.name, e, GROUPS[language, r.name][e], False))
                spared += [_places(language, r.name, e, phrase_groups(x), True) for x in entry.unless]
    spared = spared or ["SELECT 0 AS doc_id, '' AS language, '' AS rule, 0 AS e, 0 AS o, 0 AS z WHERE false"]
    return f"""{results_cte(lexicons)},
hits AS ({' UNION ALL '.join(hits)}),
spared AS ({' UNION ALL '.join(spared)}),
f AS (SELECT h.doc_id AS doc_id, h.language AS language, h.rule AS rule, r.outcome AS outcome, h.e AS e, h.o AS o, h.z AS z, row_number() OVER (PARTITION BY h.doc_id, h.rule ORDER BY h.o, h.e) - 1 AS seq, d.text AS text, substring(d.text, h.o + 1, h.z - h.o) AS finding
  FROM hits h JOIN d ON h.doc_id = d.doc_id JOIN r ON r.doc_id = h.doc_id AND r.rule = h.rule
  WHERE NOT EXISTS (SELECT 1 FROM spared u WHERE u.doc_id = h.doc_id AND u.rule = h.rule AND u.e = h.e AND ((h.o >= u.o AND h.z <= u.z) OR (u.o >= h.o AND u.z <= h.z))))"""


_HEAD = "regexp_extract(left(text, o), '[^\\n]*$')"
FINDINGS = f"""{found_cte()}
SELECT doc_id, language, rule, outcome, CAST(seq AS INTEGER) AS seq, finding, CAST({count(chr(10), 'left(text, o)')} + 1 AS INTEGER) AS line, CAST(length({_HEAD}) + {count(ASTRAL, _HEAD)} + 1 AS INTEGER) AS "column", CAST(o AS INTEGER) AS "offset", CAST(z AS INTEGER) AS "end" FROM f"""
TOP = f"{found_cte()}\nSELECT doc_id, rule, string_agg(finding, ' | ' ORDER BY seq) FILTER (WHERE seq < 3) AS first, CAST(greatest(0, count(*) - 3) AS INTEGER) AS more FROM f GROUP BY doc_id, rule"
_SPANS = """reach AS (SELECT doc_id, rule, e, outcome, o, z, max(z) OVER (PARTITION BY doc_id ORDER BY o, z DESC, rule, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR o >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY o, z DESC, rule, e ROWS UNBOUNDED PRECEDING) AS island FROM reach),
spans AS (SELECT doc_id, min(o) AS a, max(z) AS b, string_agg(DISTINCT rule, ' ' ORDER BY rule) AS rules, bool_and(outcome = 'abstained') AS observed_only FROM islands GROUP BY doc_id, island)"""


def spans_sql(lexicons: dict[str, Lexicon] | None = None) -> str:
    return f'{found_cte(lexicons)},\n{_SPANS}\nSELECT doc_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", rules, observed_only FROM spans'


def escaped(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = f"replace({x}, {q(raw)}, {q(safe)})"
    return x


HIGHLIGHTED = f"""{found_cte()},\n{_SPANS},
cut AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
marked AS (SELECT cut.doc_id AS doc_id, max(b) AS last, string_agg(concat({escaped('substring(d.text, before + 1, a - before)')}, '<mark data-rules="', rules, '">', {escaped('substring(d.text, a + 1, b - a)')}, '</mark>'), '' ORDER BY a) AS html FROM cut JOIN d ON cut.doc_id = d.doc_id GROUP BY cut.doc_id)
SELECT d.doc_id AS doc_id, concat(coalesce(html, ''), {escaped('substring(d.text, coalesce(last, 0) + 1)')}) AS html FROM d LEFT JOIN marked ON d.doc_id = marked.doc_id"""

_ENDS = "[.!?…]+|\\n[ \\t]*\\n|¦"
SENTENCE_ROWS = f"""WITH x AS (SELECT doc_id, regexp_replace(text, '\\n([ \\t]*(?:#{{1,6}}[ \\t]|[-*+][ \\t]|>[ \\t]|\\d+[.)][ \\t]))', '¦\\1', 'g') AS t FROM documents),
y AS (SELECT doc_id, regexp_split_to_array(t, '{_ENDS}') AS g, list_concat(regexp_extract_all(t, '{_ENDS}'), ['']) AS e FROM x),
p AS (SELECT doc_id, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS g, unnest(e) AS e FROM y),
o AS (SELECT doc_id, i, sum(length(g) + length(e)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(g) - length(e) AS pos, CASE WHEN e = '' OR e[1] IN (chr(10), '¦') THEN g ELSE concat(g, e) END AS raw FROM p),
b AS (SELECT doc_id, i, pos + length(raw) - length(regexp_replace(raw, '^{WS}+', '')) AS pos, regexp_replace(regexp_replace(raw, '^{WS}+', ''), '{WS}+$', '') AS body FROM o),
c AS (SELECT doc_id, i, pos, body, {count(WORD, 'body')} AS words FROM b)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS idx, CAST(pos AS INTEGER) AS "offset", CAST(words AS INTEGER) AS words, md5(body) AS text_md5 FROM c WHERE words > 0"""

#: Sentences for labelling: a run of terminators ends one unless what stands around a period says that it doesn't; blank lines end them too.
_LABELLED_SENTENCES = f"""y AS (SELECT doc_id, text, regexp_split_to_array(text, '[.!?…]+') AS g, regexp_extract_all(text, '[.!?…]+') AS e FROM documents),
p AS (SELECT doc_id, text, unnest(range(1, len(e) + 1)) AS i, unnest(g[:len(e)]) AS g, unnest(e) AS e FROM y),
z AS (SELECT doc_id, text, e, CAST(sum(length(g) + length(e)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS z FROM p),
t AS (SELECT doc_id, text, e, z, regexp_extract(left(text, z - 1), '[^ \\t\\r\\n\\f]+$') AS token, substring(text, z + 1, 1) AS next, regexp_extract(substring(text, z + 1, 400), '^{WS}*(.)', 1) AS following FROM z),
cuts AS (SELECT doc_id, z FROM t WHERE e <> '.' OR NOT (token <> '' AND (regexp_matches(token, '[0-9]$') OR lower(token) IN ({', '.join(map(q, sorted(ABBREVIATIONS)))}) OR regexp_matches(token, '^\\p{{L}}$')))
  AND (next = '' OR (regexp_matches(next, '{WS}') AND NOT regexp_matches(following, '^\\p{{Ll}}'))) UNION SELECT doc_id, length(text) FROM documents),
parts AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY z), 0) AS a, z FROM cuts),
raw AS (SELECT parts.doc_id AS doc_id, a, substring(text, a + 1, z - a) AS raw FROM parts JOIN documents ON parts.doc_id = documents.doc_id),
pieces AS (SELECT doc_id, a, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS g, unnest(e) AS e FROM (SELECT doc_id, a, regexp_split_to_array(raw, '\\n[ \\t]*\\n') AS g, list_concat(regexp_extract_all(raw, '\\n[ \\t]*\\n'), ['']) AS e FROM raw)),
placed AS (SELECT doc_id, a + sum(length(g) + length(e)) OVER (PARTITION BY doc_id, a ORDER BY i ROWS UNBOUNDED PRECEDING) - length(g) - length(e) AS pos, g FROM pieces),
bare AS (SELECT doc_id, pos + length(g) - length(regexp_replace(g, '^{WS}+', '')) AS a, regexp_replace(regexp_replace(g, '^{WS}+', ''), '{WS}+$', '') AS sentence FROM placed),
sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS idx, sentence, a, a + length(sentence) AS z FROM bare WHERE sentence <> '')"""
_LOCATED = "located AS (SELECT k.doc_id AS doc_id, field, match, quote, s.idx AS idx FROM k JOIN sentences s ON k.doc_id = s.doc_id AND k.exact_start < s.z AND k.exact_start + length(quote) > s.a WHERE match = 'exact')"
LABELLED_SENTENCES = f"WITH {_LABELLED_SENTENCES} SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(a AS INTEGER) AS start, CAST(z AS INTEGER) AS \"end\", md5(sentence) AS sentence_md5 FROM sentences"
QUOTE_SENTENCES = f"WITH {DOCS},\n{_QUOTES},\n{_LABELLED_SENTENCES},\n{_LOCATED} SELECT doc_id, field, CAST(idx AS INTEGER) AS idx FROM located"
RECALL = f"""WITH {DOCS},\n{_QUOTES},\n{_LABELLED_SENTENCES},\n{_LOCATED},
wanted AS (SELECT doc_id, idx FROM sentences WHERE contains(sentence, 'an')),
own AS (SELECT doc_id, quote, bool_or(idx IN (SELECT w.idx FROM wanted w WHERE w.doc_id = located.doc_id)) AS hit FROM located GROUP BY doc_id, quote),
l AS (SELECT doc_id, count(*) AS located, count(*) FILTER (WHERE hit) AS hits FROM own GROUP BY doc_id),
c AS (SELECT w.doc_id AS doc_id, count(*) AS wanted, count(x.idx) AS covered FROM wanted w LEFT JOIN (SELECT DISTINCT doc_id, idx FROM located) x ON w.doc_id = x.doc_id AND w.idx = x.idx GROUP BY w.doc_id)
SELECT c.doc_id AS doc_id, wanted, covered, coalesce(located, 0) AS located, coalesce(hits, 0) AS hits, round(covered / wanted, 9) AS recall, round(CASE WHEN coalesce(located, 0) > 0 THEN hits / located ELSE 0.0 END, 9) AS precision FROM c LEFT JOIN l ON c.doc_id = l.doc_id"""
LIMITER = """WITH RECURSIVE hits AS (SELECT event_id, user_id, epoch_ms(ts) AS now_ms FROM events),
w AS (SELECT user_id, min(now_ms) AS s FROM hits GROUP BY user_id UNION ALL SELECT h.user_id, min(h.now_ms) FROM w JOIN hits h ON h.user_id IS NOT DISTINCT FROM w.user_id AND h.now_ms >= w.s + 3600000 GROUP BY h.user_id),
own AS (SELECT h.event_id AS event_id, h.user_id AS user_id, h.now_ms AS now_ms, max(w.s) AS s FROM hits h JOIN w ON h.user_id IS NOT DISTINCT FROM w.user_id AND w.s <= h.now_ms GROUP BY h.event_id, h.user_id, h.now_ms)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, s ORDER BY now_ms, event_id) <= 2 AS allowed FROM own"""


# --- reports ---

#: The uncalibrated constants.
CONSTANTS_LIST = [
    ("bold-ratio.ceiling", 120), ("bold-ratio.floor", 20), ("bullet-bold-shape.ceiling", 20), ("bullet-bold-shape.floor", 2), ("calibrate.min-docs", 10), ("density.phrase-ceiling", 6), ("density.phrase-floor", 1), ("diacritics.min-words", 40), ("em-dash-density.ceiling", 15),
    ("em-dash-density.floor", 2), ("negative-parallelism.ceiling", 3), ("negative-parallelism.floor", 0.5), ("participial-close.ceiling", 12), ("participial-close.floor", 2), ("report.pass-threshold", 0.8), ("rule-of-three.ceiling", 12), ("rule-of-three.floor", 2),
    ("sentence-uniformity.min-sentences", 6), ("sentence-uniformity.target-sd", 6), ("transition-density.ceiling", 20), ("transition-density.floor", 4), ("verbal-adverb-close.ceiling", 8), ("verbal-adverb-close.floor", 1.5),
]
CONSTANTS = " UNION ALL ".join(f"SELECT {q(k)} AS id, CAST({v} AS DOUBLE) AS value, '{v}' AS shown" for k, v in CONSTANTS_LIST)


def _footer(language: str) -> str:
    other = {"en": ("diacritics.", "verbal-adverb-close."), "sr": ("participial-close.",)}[language]
    own = [(k, v) for k, v in CONSTANTS_LIST if not k.startswith(other) and k != "calibrate.min-docs"]
    return f"{len(own)} uncalibrated constants in this run:\n" + "\n".join(f"- {k} = {v}" for k, v in own)


def _fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', floor({x} * {10**digits} + 0.5) / {10**digits})"


_BAND = " ".join(f"WHEN '{k}' THEN '{lo:g}, zero from {hi:g}'" for k, (lo, hi) in BOUNDS.items())
_REASON = f"""CASE rule WHEN 'diacritics' THEN CASE outcome WHEN 'abstained' THEN 'not measured: needs 40 words' ELSE 'letters with diacritics looked for' END WHEN 'formal-address' THEN concat(n_findings, ' capitals in mid-sentence')
  WHEN 'sentence-uniformity' THEN CASE outcome WHEN 'abstained' THEN 'not measured: needs 6 sentences' ELSE 'deviation of sentence lengths' END
  ELSE CASE outcome WHEN 'abstained' THEN concat('not scored: ', n_findings, ' found in too few words; needs ', min_words, ', or two findings') ELSE concat(n_findings, ' found; clean up to ', CASE rule {_BAND} END) END END"""
_SHORT = f"trim(regexp_replace(regexp_replace(regexp_replace(x, {q(WS + '+')}, ' ', 'g'), '^ ', ''), ' $', ''))"
_COLLAPSED = f"CASE WHEN length({_SHORT}) > 90 THEN concat(left({_SHORT}, 87), '…') ELSE {_SHORT} END"
_QUOTED_FINDINGS = f"""q AS (SELECT doc_id, rule, concat(string_agg(concat('- ', {_COLLAPSED}), chr(10) ORDER BY seq) FILTER (WHERE seq < 3), CASE WHEN count(*) > 3 THEN concat(chr(10), '- and ', count(*) - 3, ' more') ELSE '' END) AS quotes FROM (SELECT doc_id, rule, seq, finding AS x FROM f) GROUP BY doc_id, rule),
z AS (SELECT own.*, coalesce(q.quotes, '') AS quotes FROM (SELECT *, {_REASON} AS reason FROM r) own LEFT JOIN q ON own.doc_id = q.doc_id AND own.rule = q.rule)"""
_NL = "chr(10), chr(10)"


def _part(what: str, where: str, between: str = "chr(10)") -> str:
    return f"string_agg({what}, {between} ORDER BY rule_ord) FILTER (WHERE {where})"


_RULE_PART = f"concat('### ', %s, {_NL}, reason, CASE WHEN quotes <> '' THEN concat({_NL}, quotes) ELSE '' END)"
_GAP = "chr(10) || chr(10)"
MARKDOWN = f"""{found_cte()},
{_QUOTED_FINDINGS},
parts AS (SELECT doc_id, language, max(words) AS words, avg(score) FILTER (WHERE kind = 'density') AS score, count(*) FILTER (WHERE kind = 'density' AND outcome = 'scored') AS n, count(*) FILTER (WHERE kind = 'hard' AND outcome = 'scored' AND passed) AS good, count(*) FILTER (WHERE outcome = 'abstained') AS left_out,
  {_part(_RULE_PART % 'rule', "kind = 'hard' AND outcome = 'scored' AND NOT passed", _GAP)} AS failed, {_part("concat('- ', rule, ': ', reason)", "outcome = 'abstained'")} AS left_rules,
  {_part(f"concat('**', rule, '**: ', n_findings, {_NL}, quotes)", "outcome = 'abstained' AND n_findings > 0", _GAP)} AS observed,
  {_part(f"concat('| ', rule, ' | ', {_fixed('score', 2)}, ' | ', {_fixed('per_thousand', 2)}, ' | ', n_findings, ' |')", "kind = 'density' AND outcome = 'scored'")} AS measured,
  {_part(_RULE_PART % f"concat(rule, ' ', {_fixed('score', 2)})", "kind = 'density' AND outcome = 'scored' AND (n_findings > 0 OR score < 1)", _GAP)} AS loud FROM z GROUP BY doc_id, language)
SELECT doc_id, concat(concat_ws({_GAP}, concat('# Report: ', doc_id), concat('**', coalesce({_fixed('score', 3)}, 'not scored'), '** over ', n, CASE n WHEN 1 THEN ' density rule' ELSE ' density rules' END, ' · ', words, CASE words WHEN 1 THEN ' word' ELSE ' words' END, ' · ', language, ' · lexicon ', CASE language WHEN 'en' THEN '0.3.0+0126033ab30f' ELSE '0.3.0+a1e590743b64' END),
  CASE WHEN failed IS NOT NULL THEN concat('## Hard failures', {_NL}, failed) WHEN good > 0 THEN concat('Hard rules: ', good, ' passed') ELSE 'Hard rules: none measured' END, CASE WHEN left_out > 0 THEN concat('## Not measured (', left_out, ')', {_NL}, left_rules) END, CASE WHEN observed IS NOT NULL THEN concat('### Observed, not scored', {_NL}, observed) END,
  CASE WHEN n > 0 THEN concat('## Density rules', {_NL}, '| rule | score | measured | findings |', chr(10), '| --- | --- | --- | --- |', chr(10), measured) END, loud, concat('---', {_NL}, CASE language WHEN 'en' THEN {q(_footer('en'))} ELSE {q(_footer('sr'))} END)), chr(10)) AS markdown FROM parts"""
JSON = f"""{results_cte()}
SELECT doc_id, language, CAST(max(words) AS BIGINT) AS words, round(avg(score) FILTER (WHERE kind = 'density'), 9) AS score, CASE language WHEN 'en' THEN '0.3.0+0126033ab30f' ELSE '0.3.0+a1e590743b64' END AS lexicon, count(*) AS n_rules, count(*) FILTER (WHERE outcome = 'abstained') AS n_left, count(*) FILTER (WHERE kind = 'hard' AND NOT passed) AS n_failed FROM r GROUP BY doc_id, language"""
_SHOWN = "outcome = 'abstained' OR kind = 'density' OR NOT passed"
HTML_REPORTS = f"""{results_cte()}
SELECT doc_id, coalesce({_fixed("avg(score) FILTER (WHERE kind = 'density')", 3)}, 'not scored') AS score, count(*) FILTER (WHERE kind = 'hard' AND outcome = 'scored' AND NOT passed) AS n_failed, count(*) FILTER (WHERE outcome = 'abstained') AS n_left, count(*) FILTER (WHERE kind = 'density' AND outcome = 'scored') AS n_scored,
  CAST(coalesce(sum(least(n_findings, 5) + CASE WHEN n_findings > 5 THEN 1 ELSE 0 END) FILTER (WHERE {_SHOWN}), 0) AS BIGINT) AS n_items FROM r GROUP BY doc_id"""

# --- labels ---

_MARKED = "marked AS (SELECT doc_id, idx, sentence, contains(sentence, 'the ') AS c, contains(sentence, 'an') AS e, contains(sentence, 'ing') AS h FROM sentences)"
CLAIM = f"""WITH {DOCS},\n{_QUOTES},\n{_LABELLED_SENTENCES},\n{_LOCATED},\n{_MARKED},
hit AS (SELECT DISTINCT l.doc_id AS doc_id FROM located l JOIN marked m ON l.doc_id = m.doc_id AND l.idx = m.idx WHERE l.field = 'middle as is' AND m.c)
SELECT m.doc_id AS doc_id, CAST(CASE WHEN max(hit.doc_id) IS NULL THEN 0 ELSE 1 END AS INTEGER) AS value, round(count(*) FILTER (WHERE c) / count(*), 4) AS claim_density FROM marked m LEFT JOIN hit ON m.doc_id = hit.doc_id GROUP BY m.doc_id"""
HYPE = f"""WITH {DOCS},\n{_QUOTES},\n{_LABELLED_SENTENCES},\n{_LOCATED},\n{_MARKED},
own AS (SELECT DISTINCT doc_id, idx FROM located WHERE starts_with(field, 'end'))
SELECT m.doc_id AS doc_id, count(*) AS wanted, count(own.idx) AS covered, coalesce(string_agg(m.idx, ',' ORDER BY m.idx) FILTER (WHERE own.idx IS NULL), '') AS missed, round(count(own.idx) / count(*), 9) AS recall FROM marked m LEFT JOIN own ON m.doc_id = own.doc_id AND m.idx = own.idx WHERE h GROUP BY m.doc_id"""
MATCH_TOTALS = f"WITH {DOCS},\n{_QUOTES} SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE match = '{x}') AS \"{x}\"" for x in ("exact", "normalized", "foreign", "absent")) + " FROM k GROUP BY ROLLUP(doc_id)"
LABEL_INDICES = f"WITH {_LABELLED_SENTENCES},\n{_MARKED} SELECT doc_id, CAST(idx AS INTEGER) AS idx FROM marked WHERE e"
LABEL_PROBLEMS = f"""WITH {_LABELLED_SENTENCES},\n{_MARKED}
SELECT doc_id, CAST(idx AS INTEGER) AS idx, 'moved' AS problem FROM marked WHERE idx % 7 = 0 UNION ALL SELECT doc_id, CAST(2 AS INTEGER), 'duplicate' FROM marked WHERE idx = 2
UNION ALL SELECT doc_id, CAST(max(idx) + 1 AS INTEGER), 'missing' FROM marked GROUP BY doc_id UNION ALL SELECT doc_id, NULL, 'no marks' FROM marked GROUP BY doc_id HAVING NOT bool_or(c OR e OR h)"""
SENTENCE_AT = f"""WITH {DOCS},\n{_QUOTES},\n{_LABELLED_SENTENCES}
SELECT k.doc_id AS doc_id, field, CAST(exact_start AS INTEGER) AS "offset", CAST(s.idx AS INTEGER) AS idx FROM k LEFT JOIN sentences s ON k.doc_id = s.doc_id AND k.exact_start >= s.a AND k.exact_start < s.z WHERE match = 'exact'"""
WORKSHEETS = f"""WITH {_LABELLED_SENTENCES}
SELECT doc_id, concat('source: ', doc_id, chr(10), 'labelledBy: ""', chr(10), 'labelledAt: ""', chr(10), '# ', count(*), ' sentences', chr(10), 'entries:', chr(10), string_agg(concat('  - index: ', idx, chr(10), '    text: ', CAST(to_json(sentence) AS VARCHAR), chr(10), '    marks: []'), chr(10) ORDER BY idx), chr(10)) AS worksheet FROM sentences GROUP BY doc_id"""

# --- costs and sources ---

USAGE = """WITH u AS (SELECT conv_id, CASE role WHEN 'user' THEN 'large' WHEN 'assistant' THEN 'small' ELSE 'unlisted' END AS model, sum(length(text)) AS i, sum(turn * 10) AS o, count(*) AS w, sum(turn) AS c FROM conversations GROUP BY 1, 2)
SELECT conv_id, model, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, round(CASE model WHEN 'large' THEN ((i + w * 1.25 + c * 0.1) * 5.0 + o * 25.0) / 1e6 WHEN 'small' THEN (i + w * 1.25 + c * 0.1 + o * 5.0) / 1e6 END, 9) AS cost, CASE WHEN model = 'unlisted' THEN 'unpriced' END AS unknown_reason FROM u"""
RETRIES = "SELECT user_id, count(DISTINCT event_id // 300) AS calls, count(*) AS attempts, count(*) - count(DISTINCT event_id // 300) AS retries FROM events GROUP BY user_id"
SUBMISSIONS = f"SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 429 WHEN NOT regexp_matches(text, '[^{WS[1:-1]}]') THEN 400 WHEN length(text) + {count(ASTRAL)} > 5000 THEN 413 ELSE 200 END AS INTEGER) AS status, CASE WHEN regexp_matches(text, '(?i)^https?://') THEN 'url' ELSE 'file' END AS via FROM documents"
GATE = f"WITH x AS ({HTML}) SELECT page_id, CASE WHEN len(list_filter(regexp_split_to_array(text, {q(WS + '+')}), lambda w: w <> '')) < 120 THEN 'too short' END AS reason FROM x"
CORPUS_DOCUMENTS = """SELECT doc_id, md5(concat('---', chr(10), 'provenance: generated', chr(10), 'subject: ', CASE WHEN source IS NULL THEN 'null' ELSE concat('"a \\"', source, '\\""') END, chr(10), 'language: ', CASE WHEN lang IS NULL THEN 'null' ELSE concat('"', lang, '"') END, chr(10),
  'words: ', CASE WHEN n_chars IS NULL THEN 'null' ELSE concat('"', n_chars, '"') END, chr(10), '---', chr(10), coalesce(text, ''))) AS document_md5 FROM documents"""
NORMALISED = f"SELECT doc_id, md5(lower({_SHORT.replace('(x,', '(text,')})) AS normalised_md5, {_COLLAPSED.replace('(x,', '(text,')} AS collapsed FROM documents"
