"""Language detection by function words, and the rule for labelled files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseline.functions.shipped import DIACRITICS, STOPWORDS


def votes(text: Column, language: str) -> Column:
    """How many of a language's function words occur at all.

    Words are lowered one by one, once each: Spark's lower() is slow on texts
    that aren't ASCII. Only of İ the lower case isn't one letter, so that texts
    with it are lowered before they are cut.
    """
    letters = F.lit(r"\p{L}+")
    cut = F.when(F.contains(text, F.lit("İ")), F.regexp_extract_all(F.lower(text), letters, F.lit(0))).otherwise(F.transform(F.array_distinct(F.regexp_extract_all(text, letters, F.lit(0))), F.lower))
    known = F.array_intersect(cut, F.array(*map(F.lit, sorted({w for x in STOPWORDS.values() for w in x}))))
    return F.size(F.array_intersect(known, F.array(*map(F.lit, STOPWORDS[language]))))


def has_diacritics(text: Column) -> Column:
    return text.rlike(f"(?=[{min(DIACRITICS)}-{max(DIACRITICS)}])[{DIACRITICS}]")  # one range first


def has_cyrillic(text: Column) -> Column:
    return text.rlike(r"(?=[\x{400}-\x{10ffff}])\p{IsCyrillic}")  # one range first: Java looks a script up in a table


def winner(sr: Column, en: Column, text: Column) -> Column:
    """More function words win; a tie is Serbian with diacritics, else English."""
    return F.when(sr > en, "sr").when(sr < en, "en").when(has_diacritics(text), "sr").otherwise("en")


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """df with language and basis: more function words win; a tie is Serbian with diacritics, else English."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("sr_votes", votes(t, "sr")).withColumn("en_votes", votes(t, "en"))
    language = winner(F.col("sr_votes"), F.col("en_votes"), t)
    basis = F.when(F.col("sr_votes") != F.col("en_votes"), "vote").when(has_diacritics(t), "tie, diacritics").otherwise("tie, default")
    return df.withColumn("language", language).withColumn("basis", basis)


def detect_label_language(text: Column) -> Column:
    """Serbian if there is a Cyrillic letter or a diacritic."""
    return F.when(has_cyrillic(text) | has_diacritics(text), "sr").otherwise("en")
