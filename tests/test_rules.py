"""Contract of the kernel, the rules and the reports on short texts."""

import hashlib
import time

import pytest

from proseline.functions import kernel as K
from proseline.functions.lexicon import Entry, Lexicon, parse_lexicon, phrase_pattern
from proseline.functions.shipped import ENGLISH, SERBIAN, SHIPPED
from proseline.operators import check
from proseline.operators.language import detect
from proseline.operators.rules import RULES, Rule, declared_constants, gate_words, rules_for
from proseline.plans import registry
from pyspark.sql import functions as F

CASES = [
    # name, language, text, rule, findings as (text, line, column), outcome, score
    ("bold", "en", "This is **bold** text.", "bold-ratio", [("bold", 1, 11)], "scored", None),
    ("bolds", "en", "**one** and __two__ …", "bold-ratio", [("one", 1, 3), ("two", 1, 15)], "scored", None),
    ("bullets", "en", "- **term**: said\n- **other** said\n- plain", "bullet-bold-shape", [("**term**:", 1, 3), ("**other**", 2, 3)], "scored", 0.0),
    ("bullet alone", "en", "- **term**", "bullet-bold-shape", [], "abstained", None),
    ("dashes", "en", "One — two — three – x - y", "em-dash-density", [("—", 1, 5), ("—", 1, 11)], "scored", 0.0),
    ("three", "en", "first line\nKnowledge, tools, and people.", "rule-of-three", [("Knowledge, tools, and people", 2, 1)], "abstained", None),
    ("closing", "en", "The team met twice, improving things.", "participial-close", [("improving", 1, 21)], "abstained", None),
    ("not closing", "en", "We checked it twice, morning and night.", "participial-close", [], "abstained", None),
    ("adverb", "sr", "Radili su brzo, ne gledajući.", "verbal-adverb-close", [("gledajući", 1, 20)], "abstained", None),
    ("infinitive", "sr", "Ovo je teško reći.", "verbal-adverb-close", [], "abstained", None),
    ("formal", "sr", "Molim Vas da dođete.", "formal-address", [("Vas", 1, 7)], "scored", 0.0),
    ("formal start", "sr", "Vas molim.\nVi dođite. „Vi ste.", "formal-address", [], "scored", 1.0),
    ("parallel", "en", "This is not just a tool but a way.", "negative-parallelism", [("not just a tool but", 1, 9)], "abstained", None),
    ("weasel", "en", "Experts  say so, experts\nsay so.", "weasel-words", [("Experts  say", 1, 1), ("experts\nsay", 1, 18)], "scored", 0.0),
    ("apostrophe", "en", "It’s important to note this.", "editorializing", [("It’s important to note", 1, 1)], "abstained", None),
    ("except", "en", "the landscape and landscape mode", "inflated-vocabulary", [("landscape", 1, 5)], "abstained", None),
    ("stem", "sr", "Materija je kompleksna. Ključna reč je ključan.", "inflated-vocabulary", [("kompleksna", 1, 13), ("ključan", 1, 40)], "scored", 0.0),
    ("one transition", "en", "However, it costs more than we said.", "transition-density", [("However", 1, 1)], "abstained", None),
    ("two transitions", "en", "However, it costs. Moreover, it is.", "transition-density", [("However", 1, 1), ("Moreover", 1, 20)], "scored", 0.0),
    ("upper", "sr", "ŠTAVIŠE radi. Štaviše, radi.", "transition-density", [("ŠTAVIŠE", 1, 1), ("Štaviše", 1, 15)], "scored", 0.0),
    ("uniform", "en", "One two three four. " * 45, "sentence-uniformity", [], "scored", 0.0),
    ("few sentences", "en", "One two. Three four.", "sentence-uniformity", [], "abstained", None),
    ("no diacritics", "sr", "ovo je tekst bez znakova " * 12, "diacritics", [], "scored", 0.0),
    ("short", "sr", "ovo je tekst", "diacritics", [], "abstained", None),
    ("astral", "en", "🙂 **a🙂b**", "bold-ratio", [("a🙂b", 1, 6)], "scored", None),
]


@pytest.fixture(scope="module")
def done(spark):
    df = spark.createDataFrame([(n, x, t) for n, x, t, *_ in CASES], "name string, lang string, text string")
    return check.checked(df, language="lang").persist()


def test_cases(done):
    found, graded = {}, {(r.name, r.rule): r for r in check.rule_results(done, "name").collect()}
    for r in check.findings(done, "name").orderBy("name", "rule", "seq").collect():
        found.setdefault((r.name, r.rule), []).append((r.finding, r.line, r.column))
    for name, _, _, rule, want, outcome, score in CASES:
        assert found.get((name, rule), []) == want, name
        got = graded[name, rule]
        assert got.outcome == outcome, name
        assert score is None or got.score == score, name
        assert (got.outcome == "abstained") == (got.score is None)


def test_findings_slice_back(done):
    texts = {n: t for n, _, t, *_ in CASES}
    assert all(texts[r.name][r.offset : r.end] == r.finding for r in check.findings(done, "name").collect())


def test_words_and_sentences(spark):
    texts = ["šećer čaša đak", "- **bold** text", "don’t re-do 3 a1", "", "one\ntwo", "one.\n\ntwo", "- a\n- b\n- c", "3.5 is x", "# h\ntext"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", K.plain(F.col("t"))).select("i", K.count_words(F.col("t")).alias("w"), F.size(K.sentence_lengths(F.col("t"))).alias("s"), K.sentences("p").alias("x"), K.deviation("array(2, 4, 4, 4, 5, 5, 7, 9)").alias("sd")).orderBy("i").collect()
    assert [r.w for r in rows] == [3, 2, 3, 0, 2, 2, 3, 2, 2]
    assert [r.s for r in rows][4:7] == [1, 2, 3] and all(r.s == len(r.x) for r in rows) and rows[0].sd == 2
    assert all(texts[r.i][s.offset : s.offset + len(s.text)] == s.text for r in rows for s in r.x)


def test_reports(spark):
    df = spark.createDataFrame([(1, None), (2, "two words"), (3, "ovo je tekst bez znakova i da se vidi " * 9)], "doc_id long, text string")
    got = {r.doc_id: r for r in check.reports(check.checked(df)).collect()}
    assert got[1].word_count == 0 and got[1].score == 1.0 and got[1].language == "en"
    assert "diacritics" in got[3].hard_failures and got[3].status == 1 and got[3].language == "sr"
    plain = check.checked(df, rules=tuple(r for r in RULES if r.name != "bold-ratio"))
    assert {r.doc_id: r.score for r in check.reports(plain).collect()}[2] is None
    assert check.reports(check.checked(df.limit(0))).count() == 0


def test_registry_and_constants():
    assert (len(rules_for("sr")), len(rules_for("en"))) == (15, 13)
    assert (len(declared_constants(rules_for("en"))), len(declared_constants(rules_for("sr"))), len(declared_constants(calibration=True))) == (19, 20, 23)
    assert (gate_words(6.0), gate_words(3.0), gate_words(0)) == (167, 334, 0)
    with pytest.raises(ValueError):
        declared_constants([Rule("a", "hard", ("sr",), None, None, (("x", 1.0),)), Rule("b", "hard", ("sr",), None, None, (("x", 2.0),))])


def test_lexicons(spark):
    assert (SHIPPED["en"].identity(), SHIPPED["sr"].identity()) == ("0.3.0+0126033ab30f", "0.3.0+a1e590743b64")
    plain, turned = (Lexicon("en", "1", x, ENGLISH.exceptions).identity() for x in (ENGLISH.entries, dict(reversed(ENGLISH.entries.items()))))
    more = Lexicon("en", "1", ENGLISH.entries | {"x": (Entry("y"),)}, ENGLISH.exceptions)
    assert plain == turned != more.identity()
    content = {"version": "1", "language": "en", "phrases": {"weasel-words": [{"phrase": "a b", "matches": "A b."}, {"phrase": "c", "matches": "C."}]}}
    swapped = content | {"phrases": {"weasel-words": content["phrases"]["weasel-words"][::-1]}}
    form = '{"version":"1","language":"en","phrases":[["weasel-words",[{"matches":"A b.","alsoMatches":[],"except":[],"phrase":"a b"},{"matches":"C.","alsoMatches":[],"except":[],"phrase":"c"}]]],"patterns":[],"exceptions":[]}'
    assert parse_lexicon(content).identity() == f"1+{hashlib.sha256(form.encode()).hexdigest()[:12]}" != parse_lexicon(swapped).identity()
    own = parse_lexicon({"version": "2", "language": "en", "phrases": {"weasel-words": [{"phrase": "a b*", "except": ["a bc"]}]}, "patterns": {"weasel-words": [{"pattern": "x+"}]}})
    assert [e.kind for e in own.of("weasel-words")] == ["phrase", "pattern"]
    for bad in ({"language": "de"}, {"language": "en", "words": {}}, {"language": "en", "phrases": {"r": [{"pattern": "x"}]}}):
        with pytest.raises(ValueError):
            parse_lexicon(bad)
    with pytest.raises(ValueError):
        check.checked(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {"en": Lexicon("en"), "sr": SERBIAN})
    assert phrase_pattern("a") == r"(?<![\p{L}\p{N}_])a(?![\p{L}\p{N}_])"
    twice = Lexicon("en", "1", ENGLISH.entries | {"weasel-words": (Entry("a b"), Entry("a"))}, {})
    rows = check.rule_results(check.checked(spark.createDataFrame([(1, "a b the")], "doc_id long, text string"), {"en": twice, "sr": SERBIAN}))
    assert rows.where("rule = 'weasel-words'").first().n_findings == 2


def test_dense_texts_take_linear_time(spark):
    """40,000 matches and as many sentences of one text, with all their places."""
    import time

    n = 40_000
    df = spark.createDataFrame([("a — word. " * n,)], "t string").withColumn("p", K.plain(F.col("t")))
    began = time.time()
    row = df.select(F.expr(K.find("p", "—")).alias("f"), K.sentences("p").alias("s"), F.expr(K.find("p", r"([a-z]+)( — )(word)", True)).alias("g")).select(
        F.size("f").alias("n"), F.expr("exists(f, x -> (x.offset - 2) % 10 <> 0 or x.`end` <> x.offset + 1)").alias("wrong"), F.col("f")[n - 1]["offset"].alias("last"), F.size("s").alias("m"), F.col("s")[n - 1]["offset"].alias("start"), F.col("g")[n - 1].alias("hit"),
    ).first()
    took = time.time() - began
    assert (row.n, row.wrong, row.last, row.m, row.start) == (n, False, 10 * n - 8, n, 10 * n - 10) and (row.hit.text, row.hit.offset, row.hit.end) == (" — ", 10 * n - 9, 10 * n - 6)
    assert took < 20, took
    print(took)


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 128, 1000):
        got = spark.sql(f"select {K.running(f'transform(sequence(0, {n}), x -> x)')} as x").first().x
        assert got == [k * (k - 1) // 2 for k in range(n + 1)]
    starts = [0, 4, 9, 30]
    df = spark.range(40).withColumn("o", F.col("id").cast("int")).select("o", F.expr(f"array({', '.join(map(str, starts))})").alias("s")).select("o", F.expr(K.line_at("s", "o")).alias("line"))
    assert {r.o: r.line for r in df.collect()} == {o: sum(x <= o for x in starts) for o in range(40)}
    assert spark.sql(f"select {K.line_at('array(0)', '7')} as x").first().x == 1


def test_marks_in_a_text_play_no_part(spark):
    df = spark.createDataFrame([("a\ufdd0 — b\ufdd1 — \ufdd0",)], "t string").withColumn("p", K.plain(F.col("t")))
    assert [(x.text, x.offset, x.end) for x in df.select(F.expr(K.find("p", "—")).alias("f")).first().f] == [("—", 3, 4), ("—", 8, 9)]


def test_no_column_is_lost(spark):
    import pytest

    df = spark.createDataFrame([(1, "Some text here.", "b", 2)], "doc_id int, text string, basis string, sr_votes int")
    assert set(df.columns) | {"language", "word_count", "rules"} == set(check.checked(df).columns)
    with pytest.raises(ValueError):
        check.checked(df.withColumnRenamed("basis", "word_count"))


def test_exceptions_are_found_once_for_a_text(spark):
    """Hits and the spans that spare them are many: the spans are found once, and each hit's place among them by halving (before: a pattern's pass for each hit, minutes)."""
    n = 3000
    df = spark.createDataFrame([(1, "the of the landscape landscape mode ofthe " * n), (2, "landscape mode"), (3, "landscape")], "doc_id int, text string")
    lexicons = {"en": Lexicon("en", "x", {"inflated-vocabulary": (Entry("landscape", unless=("landscape mode", "landscape photo")), Entry("the", unless=("of the", "the of")))}), "sr": SERBIAN}
    rules = tuple(r for r in RULES if r.name == "inflated-vocabulary")
    began = time.time()
    got = {r.doc_id: r.f for r in check.checked(df, lexicons, rules).selectExpr("doc_id", "rules[0].findings.offset f").collect()}
    assert time.time() - began < 40
    assert got == {1: [11 + 42 * i for i in range(n)], 2: [], 3: [0]}


def test_quick_patterns_match_alike(spark):
    """What only saves time changes no match: first letters, one range before a class, strings searched for in ASCII."""
    texts = ["robuſt, Robust ROBUST xrobust", "\u212aey leverage, Delve", "xİto İn the of", "bread, fine butter and jam and more", "Not  just a but b; it’s not x, it's y", "a  b", "і ᴫ", ""]
    entries = (Entry("robust"), Entry("key"), Entry("it's"), Entry("'s"))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id int, text string, language string")
    rules = tuple(r for r in RULES if r.name == "weasel-words")
    for more in ((), (Entry("é*"),)):
        words = Lexicon("en", "x", {"weasel-words": entries + more})
        got = {r.doc_id: r.f for r in check.checked(df, {"en": words, "sr": SERBIAN}, rules, language="language").selectExpr("doc_id", "rules[0].findings.text f").collect()}
        assert got == {0: ["robuſt", "Robust", "ROBUST"], 1: ["\u212aey"], 2: [], 3: [], 4: ["it’s", "it's"], 5: [], 6: [], 7: []}
    for e in (e for lexicon in (ENGLISH, SERBIAN) for r in lexicon.entries for e in lexicon.of(r) if e.quick):
        plain = f"(?iu){e.source}".replace(r"\s", K.WS)
        rows = df.select(F.regexp_extract_all("text", F.lit(plain), F.lit(0)) == F.regexp_extract_all("text", F.lit(e.pattern), F.lit(0)), ~F.col("text").rlike(plain) | F.col("text").rlike(f"(?iu){e.sure}".replace(r"\s", K.WS))).collect()
        assert all(all(r) for r in rows)
    votes = {r.doc_id: (r.sr_votes, r.en_votes) for r in detect(df.drop("language")).collect()}
    assert votes[2] == (1, 3) and votes[7] == (0, 0)


def test_tasks_grow_with_the_input(spark, tmp_path, monkeypatch):
    """A file of one row group isn't a fixed number of tasks, whatever its size."""
    path = str(tmp_path / "t.parquet")
    spark.range(200_000).selectExpr("id doc_id", "uuid() text").coalesce(1).write.parquet(path)
    monkeypatch.setattr(registry, "SPREAD", 1 << 20)
    assert registry.spread(spark.read.parquet(path).select("doc_id", "text")).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
