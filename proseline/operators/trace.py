"""Quotes traced to sources, sentences, and scores of located quotes against labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseline.functions.kernel import MARK, WS, let, normalise, quoted, running, trim
from proseline.operators.language import has_cyrillic, has_diacritics

# English function words of a translated quote; abbreviations that end no sentence.
ENGLISH = "the of and to is in that it for with was as".split()
ABBREVIATIONS = frozenset("br itd tj npr god str dr mr prof inž ul sl tzv odn uporedi v vidi st os rč mrs ms jr sr vs etc ie eg al fig no approx dept est inc ltd co cf ca pp ed eds vol ch".split())


def looks_foreign(quote: Column, source: Column, language: Column) -> Column:
    """Another script; or an English quote of a Serbian source."""
    words = F.regexp_extract_all(F.lower(quote), F.lit(r"\p{L}+"), F.lit(0))
    english = F.size(F.filter(words, lambda w: w.isin(ENGLISH))) >= 2
    return (has_cyrillic(quote) != has_cyrillic(source)) | ((language == "sr") & has_diacritics(source) & ~has_diacritics(quote) & (F.size(words) >= 5) & english)


def _tolerant(quote: Column) -> Column:
    """A pattern that finds a quote whatever its case and white space."""
    words = F.split(trim(quote), f"{WS}+", -1)
    return F.concat(F.lit("(?iu)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), f"{WS}+"))


def check_quotes(df: DataFrame, source: str = "source", quote: str = "quote", language: str = "language") -> DataFrame:
    """df with match (exact, normalized, foreign, absent), start and end; blank quotes go."""
    s, q = F.col(source), F.col(quote)
    df = df.where(F.length(trim(q)) > 0).withColumn("_exact", F.instr(s, q))
    missed = F.col("_exact") == 0
    df = df.withColumn("_found", F.when(missed, F.regexp_substr(s, _tolerant(q))))
    place = F.when(~missed, F.col("_exact") - 1).when(F.col("_found").isNotNull(), F.instr(s, F.col("_found")) - 1)
    length = F.when(~missed, F.length(q)).otherwise(F.length("_found"))
    kind = F.when(~missed, "exact").when(F.col("_found").isNotNull(), "normalized").when(looks_foreign(q, s, F.col(language)), "foreign").otherwise("absent")
    return df.withColumn("match", kind).withColumn("start", place).withColumn("end", place + length).drop("_exact", "_found")


def fails(matches: DataFrame, key: str) -> DataFrame:
    """(key, fails): whether any quote of a document is absent or foreign."""
    return matches.groupBy(key).agg(F.bool_or(F.col("match").isin("absent", "foreign")).alias("fails"))


def quoted_fields(analyses: DataFrame, key: str) -> DataFrame:
    """(key, field, statement, quote) of all quoted fields of analyses(claim, evidence, novelty, hype)."""
    out = analyses.select(key, F.lit("claim").alias("field"), "claim.statement", "claim.quote")
    for name in ("evidence", "novelty.genuinelyNew", "novelty.restated", "hype"):
        rows = analyses.select(key, F.posexplode(F.col(name)).alias("i", "x"))
        out = out.unionByName(rows.select(key, F.concat(F.lit(f"{name}["), F.col("i").cast("string"), F.lit("]")).alias("field"), "x.statement", "x.quote"))
    return out


_TERMINATOR, _BLANK = re.compile(r"[.!?…]+"), re.compile(r"\n[ \t]*\n")
_LAST = re.compile(r"(\S+)\Z")


def split_labelled(text: str | None) -> list[tuple[int, str, int, int]]:
    """Sentences for labelling: (index from 1, text, start, end). A period after a digit, an abbreviation or an initial, or before lower case, ends none."""
    text = text or ""

    def ends(a: int, z: int) -> bool:
        if text[a:z] != ".":
            return True
        token = _LAST.search(text, max(0, text.rfind(" ", 0, a)), a)
        token = token[1] if token else ""
        if token and (token[-1] in "0123456789" or token.lower() in ABBREVIATIONS or (len(token) == 1 and token.isalpha())):
            return False
        rest = text[z : z + 1]
        if not rest:
            return True
        if not rest.isspace():
            return False
        following = re.compile(r"\S").search(text, z)
        return following is None or not following[0].islower()

    cuts, at = [], 0
    for m in _TERMINATOR.finditer(text):
        if ends(*m.span()):
            cuts.append((at, m.end()))
            at = m.end()
    cuts.append((at, len(text)))
    out: list[tuple[int, str, int, int]] = []
    for a, z in cuts:
        body = a
        for b in [*(m.span() for m in _BLANK.finditer(text, a, z)), (z, z)]:
            piece = text[body : b[0]]
            lead = len(piece) - len(piece.lstrip())
            if piece.strip():
                out.append((len(out) + 1, piece.strip(), body + lead, body + lead + len(piece.strip())))
            body = b[1]
    return out


#: White space as str.strip() has it.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _cuts() -> str:
    """A pattern for what a sentence ends with, as split_labelled() has it: a run of terminators, or a blank line.

    The look-back is of bounded length: the longest abbreviation and what
    stands before it. K is also the Kelvin sign's lower case. The letter
    beyond the basic plane makes Java look back by code points.
    """
    space = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _SPACES) + "]"
    any_case = lambda word: "".join(f"[{c}{c.upper()}{chr(0x212A) if c == 'k' else ''}]" for c in word)
    short = "|".join([*map(any_case, sorted(ABBREVIATIONS)), r"[\p{L}\x{10400}𐐀]"])
    period = rf"\.(?<![0-9].)(?<!(?:\A|{space})(?:{short})\.)(?:\z|(?={space})(?!{space}*+\p{{IsLowercase}}))"
    return rf"(?=[.!?\n…])(?:[.!?…]{{2,}}+|[!?…]|{period}|\n[ \t]*\n)"  # one test of most characters


def labelled(text: str) -> str:
    """SQL for the sentences of a column as split_labelled() gives them, array<struct<sentence, start, end>>; no UDF, so no Python memory.

    Marks go behind each cut. A text that holds the mark itself is cut with
    another character in its place, and its sentences are taken from the text.
    """
    safe = f"CASE WHEN lm THEN translate({text}, '{MARK}', '\ufffd') ELSE coalesce({text}, '') END"
    spaces = quoted(_SPACES)
    start = "st[li] + length(ps[li]) - length(ll[li])"
    one = f"named_struct('sentence', CASE WHEN lm THEN substring({text}, {start} + 1, length(lb[li])) ELSE lb[li] END, 'start', {start}, 'end', {start} + length(lb[li]))"
    rows = f"transform(filter(sequence(0, size(ps) - 1), li -> lb[li] <> ''), li -> {one})"
    rows = let("ll", f"transform(ps, lp -> trim(LEADING {spaces} FROM lp))", let("lb", f"transform(ll, lp -> trim(TRAILING {spaces} FROM lp))", let("st", running("transform(ps, lp -> length(lp))"), rows)))
    return let("lm", f"coalesce(contains({text}, '{MARK}'), false)", let("ps", f"split(regexp_replace({safe}, {quoted(_cuts())}, '$0{MARK}'), '{MARK}', -1)", rows))


def labelled_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, sentence, start, end). explode_outer: for a plain explode Spark would evaluate the array again in a filter."""
    rows = df.select(key, F.posexplode_outer(F.expr(labelled(f"`{text}`"))).alias("i", "s")).where("s is not null")
    return rows.select(key, (F.col("i") + 1).alias("idx"), "s.*")


def quote_sentences(quotes: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each located quote with the sentences it overlaps: an equi-join on the document, then the ranges."""
    q, s = quotes.where("start is not null").alias("q"), sentences.alias("s")
    near = (F.col(f"q.{key}") == F.col(f"s.{key}")) & (F.col("q.start") < F.col("s.end")) & (F.col("q.end") > F.col("s.start"))
    return q.join(s, near).select("q.*", F.col("s.idx").alias("idx"))


def recall_precision(located: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: recall, of the wanted sentences those that a located quote covers; precision, of the located quotes those on a wanted one.

    located(key, quote, idx) has no untraceable quotes; wanted(key, idx). Nothing wanted, or nothing located, scores 0.
    """
    want = wanted.select(key, "idx").distinct().withColumn("w", F.lit(1))
    rows = located.join(want, [key, "idx"], "left")
    hits = rows.groupBy(key, "quote").agg(F.max(F.coalesce("w", F.lit(0))).alias("hit")).groupBy(key).agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("located"))
    covered = rows.where("w = 1").groupBy(key).agg(F.count_distinct("idx").alias("covered"))
    total = want.groupBy(key).agg(F.count(F.lit(1)).alias("wanted"))
    out = total.join(covered, key, "left").join(hits, key, "left").fillna(0, ["covered", "hits", "located"])
    return out.select(key, "wanted", "covered", "located", "hits", (F.col("covered") / F.col("wanted")).alias("recall"), F.when(F.col("located") > 0, F.col("hits") / F.greatest("located", F.lit(1))).otherwise(0.0).alias("precision"))


def verify_labels(labels: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, problem) of labels whose sentence is missing, has another text, or is labelled twice."""
    s = sentences.select(key, "idx", F.col("sentence").alias("now"))
    rows = labels.select(key, "idx", "text").join(s, [key, "idx"], "left")
    wrong = rows.withColumn("problem", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("text"), "moved")).where("problem is not null").select(key, "idx", "problem")
    twice = labels.groupBy(key, "idx").count().where("count > 1").select(key, "idx", F.lit("duplicate").alias("problem"))
    return wrong.distinct().unionByName(twice)


def match_table(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of quotes of each kind for each document."""
    kinds = ["exact", "normalized", "foreign", "absent"]
    return matches.groupBy(key).pivot("match", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


__all__ = ["check_quotes", "fails", "labelled_sentences", "match_table", "normalise", "quote_sentences", "quoted_fields", "recall_precision", "split_labelled", "verify_labels"]
