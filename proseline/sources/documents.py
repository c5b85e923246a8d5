"""Reading documents: files, corpus folders, front matter, HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.functions.kernel import WS, trim, utf16

# The pattern of front matter, and the elements that aren't prose.
_FRONT = r"\A---\r?\n([\s\S]*?)\r?\n---\r?\n?"
_BLOCKS = "script|style|noscript|svg|form|nav|header|footer|aside"
# The named entities that are decoded, and what they stand for.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”"}


def strip_frontmatter(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the front matter cut from text, and provenance: generated only where it says so."""
    t = F.col(text)
    declared = F.regexp_extract(F.regexp_extract(t, _FRONT, 1), r"(?m)^provenance:\s*(\S+)", 1)
    return df.withColumn("provenance", F.when(declared == "generated", "generated").otherwise("accepted")).withColumn(text, F.regexp_replace(t, _FRONT, ""))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text, provenance) of the .md, .markdown and .txt files in a folder and one level below; blank ones go."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    path = F.col("_metadata.file_path")
    inside = F.regexp_replace(path, r"^[a-z]+:/*", "/")
    root = F.regexp_replace(F.lit(folder.rstrip("/")), r"^[a-z]+:/*", "/")
    rows = rows.select(F.url_decode(F.substr(inside, F.length(root) + 2)).alias("name"), F.col("value").alias("text"))
    rows = rows.where(F.col("name").rlike(r"(?i)^([^/]+/)?[^/]+\.(md|markdown|txt)$"))
    rows = strip_frontmatter(rows)
    return rows.where(F.length(trim(F.col("text"))) > 0)


def via(target: Column) -> Column:
    return F.when(target.rlike("(?i)^https?://"), "url").otherwise("file")


def _decode_numbers(text: Column, pattern: str, base: int) -> Column:
    """Numeric references decoded; those beyond Unicode stay as they are."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(digits: Column, raw: Column) -> Column:
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        code = F.conv(F.when(F.length(short) <= 7, short).otherwise("0"), base, 10).cast("int")
        good = (F.length(short) <= 7) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(63)), 8, "0")), "UTF-32")).otherwise(raw)

    pieces = F.split(text, pattern, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(whole)), F.zip_with(found, whole, one), lambda a, b: F.concat(a, b)), ""), F.element_at(pieces, -1))
    return F.when(text.rlike(pattern), joined).otherwise(text)


def decode_entities(df: DataFrame, text: str) -> DataFrame:
    """df with the entities in a column decoded: hexadecimal, decimal, then named ones, in one pass each."""
    df = df.withColumn(text, _decode_numbers(F.col(text), r"(?i)&#x([0-9a-f]+);", 16))
    df = df.withColumn(text, _decode_numbers(F.col(text), r"&#(\d+);", 10))
    named = F.create_map(*[x for k, v in ENTITIES.items() for x in (F.lit(k), F.lit(v))])
    pattern = r"(?i)&([a-z]+);"
    t = F.col(text)
    whole, names = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    pieces = F.split(t, pattern, -1)
    values = F.zip_with(names, whole, lambda n, w: F.coalesce(named[F.lower(n)], w))
    joined = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(whole)), values, lambda a, b: F.concat(a, b)), ""), F.element_at(pieces, -1))
    return df.withColumn(text, F.when(t.rlike(pattern), joined).otherwise(t))


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df with the readable text of HTML: the article, else main, else body, else all, without what isn't prose."""
    x = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"<!--[\s\S]*?-->", " ")
    x = F.regexp_replace(x, rf"(?iu)<({_BLOCKS})\b[\s\S]*?</\1>", " ")
    df = df.withColumn(out, x)
    subtree = lambda tag: rf"(?iu)<{tag}\b[^>]*>([\s\S]*?)</{tag}>"
    part = F.when(F.col(out).rlike(subtree("article")), F.regexp_extract(out, subtree("article"), 1))
    for tag in ("main", "body"):
        part = part.when(F.col(out).rlike(subtree(tag)), F.regexp_extract(out, subtree(tag), 1))
    df = df.withColumn(out, part.otherwise(F.col(out)))
    y = F.regexp_replace(out, r"(?iu)</(p|div|li|h[1-6]|blockquote|tr|section)>", "\n\n")
    y = F.regexp_replace(F.regexp_replace(y, r"(?iu)<br\s*/?>", "\n"), r"<[^>]+>", " ")
    df = decode_entities(df.withColumn(out, y), out)
    z = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    blank = WS.replace(r"\s", r"\x20\t\r\f")
    return df.withColumn(out, trim(F.regexp_replace(F.regexp_replace(z, rf"{blank}+(?=\n|\z)", ""), rf"(?<=\n){blank}+", "")))


#: Words, by white space, under which a fetched page is no article.
LEAST_WORDS = 120


def extraction_status(text: Column, status: Column | None = None, content_type: Column | None = None) -> Column:
    """Why a fetched page can't be used, null if it can: the response, its type, or too few words."""
    words = F.size(F.filter(F.split(trim(F.coalesce(text, F.lit(""))), f"{WS}+", -1), lambda w: w != ""))
    reason = F.when(words < LEAST_WORDS, "too short")
    if content_type is not None:
        reason = F.when(~F.coalesce(content_type.rlike(r"(?i)^\s*(text/(html|plain)|application/xhtml\+xml)"), F.lit(False)), "no text").otherwise(reason)
    return reason if status is None else F.when(~status.between(200, 299), F.concat(F.lit("status "), status.cast("string"))).otherwise(reason)


def submission_status(text: Column, most: int = 40_000, allowed: Column | None = None) -> Column:
    """Status of a submitted text: 429 for one beyond the rate, 400 for none, 413 for too long a one by UTF-16 units, else 200."""
    out = F.when(F.length(trim(F.coalesce(text, F.lit("")))) == 0, 400).when(utf16(text) > most, 413).otherwise(200)
    return out if allowed is None else F.when(~allowed, 429).otherwise(out)


def with_frontmatter(df: DataFrame, fields: dict[str, str], text: str = "text", out: str = "document") -> DataFrame:
    """df with a whole document: front matter that says `generated`, a line for each field (name: column) as JSON strings, then the text."""
    value = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).cast("string").alias("x"))), r"(?s)\A\{\"x\":(.*)\}\z", 1)
    lines = [F.lit("provenance: generated"), *(F.concat(F.lit(f"{name}: "), F.when(F.col(c).isNull(), F.lit("null")).otherwise(value(c))) for name, c in fields.items())]
    return df.withColumn(out, F.concat(F.lit("---\n"), F.array_join(F.array(*lines), "\n"), F.lit("\n---\n"), F.coalesce(F.col(text), F.lit(""))))


def write_corpus(df: DataFrame, folder: str, name: str = "name", document: str = "document") -> None:
    """A folder for each name with the document as text; a folder that is there already is an error."""
    df.select(F.col(name).alias("name"), F.col(document).alias("value")).write.partitionBy("name").option("lineSep", "\n").mode("errorifexists").text(folder)


def chosen_subjects(subjects: DataFrame, ids: list[str] | None = None, first: int | None = None, key: str = "id") -> DataFrame:
    """The subjects with some ids, or the first ones by id in code-unit order."""
    rows = subjects if ids is None else subjects.where(F.col(key).isin(ids))
    return rows.orderBy(key) if first is None else rows.orderBy(key).limit(first)
