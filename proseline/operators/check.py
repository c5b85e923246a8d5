"""check(): from texts to rule results, findings and reports. All of it is one narrow projection of each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseline.functions import kernel as K
from proseline.functions.lexicon import Lexicon
from proseline.functions.shipped import SHIPPED
from proseline.operators.language import votes, winner
from proseline.operators.rules import ORDER, RULES, Row, Rule, Source, rules_for

#: Prefix of the columns that checked() makes for itself.
OWN = "_proseline_"


def checked(df: DataFrame, lexicons: dict[str, Lexicon] | None = None, rules: tuple[Rule, ...] = RULES, language: str | None = None, text: str = "text") -> DataFrame:
    """df with language, word_count and rules, an array with a struct for each rule of the language.

    language names the column with `sr` or `en`; without it the language is
    detected. Null text counts as empty; the two noncharacters that mark
    matches count as U+FFFD. All columns of df stay as they are: one that has
    the name of a column to be added is an error, except a language column
    that is named. Works on streams too.
    """
    lexicons = lexicons or SHIPPED
    for x in lexicons.values():
        if x.language not in ("sr", "en"):
            raise ValueError(f"unknown language {x.language}")
    added = {"language", "word_count", "rules"} - ({"language"} if language == "language" else set())
    clash = [c for c in df.columns if c.lower() in added or c.startswith(OWN)]
    if clash:
        raise ValueError(f"columns in the way: {clash}")
    own = lambda name: F.col(f"`{OWN}{name}`")
    df = df.withColumn(f"{OWN}text", K.plain(F.col(text)))
    if language is None:
        df = df.withColumns({f"{OWN}sr": votes(own("text"), "sr"), f"{OWN}en": votes(own("text"), "en")})
        df = df.withColumn("language", winner(own("sr"), own("en"), own("text")))
    elif language != "language":
        df = df.withColumn("language", F.col(language))
    ascii_only = all(x.isascii() for r in rules for e in lexicons["en"].of(r.name) for x in e.literals)  # the patterns of English rules need ASCII strings
    df = df.withColumn(f"{OWN}low", K.folded(own("text"), (F.col("language") == "en") & F.lit(ascii_only)))
    source = Source(f"`{OWN}text`", f"`{OWN}low`")
    # step 1: what needs the text's regular expressions; step 2: structs from these columns
    found, graded = {}, {}
    for x in ("sr", "en"):
        for r in rules_for(x, rules):
            found.setdefault(r.name, []).append((x, F.expr(r.find(source, lexicons[x]))))
    hits = {}
    for name, options in found.items():
        column = None
        for x, value in options:
            column = F.when(F.col("language") == x, value) if column is None else column.when(F.col("language") == x, value)
        hits[name] = column
    df = df.select("*", K.sentence_lengths(own("text")).alias(f"{OWN}lengths"), *(v.alias(f"{OWN}f_{k}") for k, v in hits.items()))
    # no word goes beyond a sentence's end, so the words of the sentences are those of the text
    df = df.withColumns({f"{OWN}sd": K.deviation(f"`{OWN}lengths`"), "word_count": F.expr(f"aggregate(`{OWN}lengths`, 0, (wa, wn) -> wa + wn)")})
    row = Row(own("text"), F.col("word_count"), own("lengths"), own("sd"))
    for x in ("sr", "en"):
        graded[x] = F.array(*(r.grade(own(f"f_{r.name}"), row) for r in rules_for(x, rules)))
    df = df.withColumn("rules", F.when(F.col("language") == "sr", graded["sr"]).when(F.col("language") == "en", graded["en"]))
    return df.drop(*(c for c in df.columns if c.startswith(OWN)))


def rule_results(done: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each document and rule.

    explode_outer: for a plain explode Spark would infer a filter on the array
    and push a copy of all its expressions below.
    """
    order = F.create_map(*[x for k, v in ORDER.items() for x in (F.lit(k), F.lit(v))])
    rows = done.select(key, "language", "word_count", F.explode_outer("rules").alias("r")).where("r is not null").select(key, "language", "word_count", "r.*")
    return rows.withColumn("n_findings", F.size("findings")).withColumn("rule_ord", F.coalesce(order[F.col("rule")], F.lit(99)))


def findings(done: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each finding, with line, column (UTF-16) and offset.

    The lines of a document are found once, each finding's by halving, and no
    text is carried beyond its own row. No filter stands on the rules here: one
    would be pushed below everything that makes them.
    """
    lines = done.select(key, "language", "rules", F.when(F.expr("exists(rules, r -> size(r.findings) > 0)"), K.plain(F.col(text))).otherwise("").alias(f"{OWN}text"))
    lines = lines.withColumn(f"{OWN}starts", F.expr(K.line_starts(f"`{OWN}text`"))).withColumn(f"{OWN}lines", F.split(f"{OWN}text", "\n", -1))
    line = K.let("fl", K.line_at(f"`{OWN}starts`", "f.offset"), f"named_struct('line', fl, 'head', left(`{OWN}lines`[fl - 1], f.offset - `{OWN}starts`[fl - 1]))")
    placed = K.let("fp", line, "named_struct('finding', f.text, 'line', fp.line, 'column', cast(octet_length(encode(fp.head, 'UTF-16BE')) / 2 as int) + 1, 'offset', f.offset, 'end', f.`end`)")
    of_rule = f"transform(rules, r -> named_struct('rule', r.rule, 'outcome', r.outcome, 'found', transform(r.findings, f -> {placed})))"
    rows = lines.select(key, "language", F.explode_outer(F.expr(of_rule)).alias("r")).where(F.size("r.found") > 0)
    rows = rows.select(key, "language", "r.rule", "r.outcome", F.posexplode_outer("r.found").alias("seq", "f"))
    return rows.select(key, "language", "rule", "outcome", "seq", "f.finding", "f.line", "f.column", "f.offset", "f.end")


def reports(done: DataFrame, key: str = "doc_id", weights: dict[str, float] | None = None) -> DataFrame:
    """A row for each document: weighted mean of the scored density rules (null if none), hard failures, abstentions. No shuffle."""
    weights = weights or {r.name: r.weight for r in RULES}
    weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    scored = F.filter("rules", lambda r: (r["kind"] == "density") & (r["outcome"] == "scored"))
    total = F.aggregate(scored, F.lit(0.0), lambda a, r: a + r["score"] * F.coalesce(weight[r["rule"]], F.lit(1.0)))
    of = F.aggregate(scored, F.lit(0.0), lambda a, r: a + F.coalesce(weight[r["rule"]], F.lit(1.0)))
    hard = F.transform(F.filter("rules", lambda r: (r["kind"] == "hard") & (r["outcome"] == "scored") & ~r["passed"]), lambda r: r["rule"])
    left = F.transform(F.filter("rules", lambda r: r["outcome"] == "abstained"), lambda r: F.struct(r["rule"].alias("rule"), r["reason"].alias("reason")))
    n = F.aggregate("rules", F.lit(0), lambda a, r: a + F.size(r["findings"]))
    out = done.select(key, "language", "word_count", F.when(of > 0, total / F.greatest(of, F.lit(1e-9))).alias("score"), hard.alias("hard_failures"), left.alias("abstentions"), n.alias("n_findings"))
    return out.withColumn("status", F.when(F.size("hard_failures") > 0, 1).otherwise(0))


def top_findings(done: DataFrame, k: int = 3, key: str = "doc_id") -> DataFrame:
    """The first k findings of each rule of each document, and how many more there are."""
    rows = done.select(key, F.explode_outer("rules").alias("r")).where(F.size("r.findings") > 0)
    return rows.select(key, F.col("r.rule").alias("rule"), F.transform(F.slice("r.findings", 1, k), lambda f: f["text"]).alias("first"), F.greatest(F.lit(0), F.size("r.findings") - k).alias("more"))
