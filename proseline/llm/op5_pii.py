"""Personal data with offset-preserving deobfuscation.

The base detectors read the text as it is. For the rest, a chain of
transducers rewrites the text and keeps, for every character that it puts
out, the span of source characters that it stands for:

1. homoglyphs: compatibility forms, look-alike letters, foreign digits and
   invisible characters become plain ASCII, or nothing;
2. spelled digits: runs of three or more digit words become digits; in a
   second pass also single ones in a row with digits, dots and other ones,
   where the row has the dots of an ip or the digits of a phone or card;
3. disguises: (at), [dot] and the like become signs; the bare words in what
   has an address's shape, and dots between digits. Before a plain domain, 'at'
   after one of the words in PROSE stays a word.

The same detectors run over what comes out, and each hit that a transducer
touched, or inside which it took something out, and that lies in no other span
of its kind, is mapped back and added; a longer one stands beside the base
span that it overlaps.

Defined results: null and empty texts have no spans. Spans count code points,
the end exclusive; they are sorted by kind as listed in KINDS, then by start.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import map_texts, slices, table

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match always starts at the start of a run of digits, so runs are never tried twice.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Leftmost, non-overlapping, found from each at-sign outwards: linear for any text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_SET:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        at = text.find("@", max(at + 1, free))


def detect(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(g := part.lstrip("0")) < 3 or len(g) == 3 and int(g) <= 255 for part in m.groups()):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# Letters of other scripts that look like Latin ones, in order.
LOOKALIKES = dict(zip("аеорсухіјѕԁһνοαρєАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhvoapeABEKMHOPCTXIJSABEZHIKMNOPTYX", strict=True))
# Characters without width that aren't format characters: the grapheme joiner, vowel separator, variation selectors.
INVISIBLE = frozenset("\u034f\u180b\u180c\u180d\u180e\u180f" + "".join(map(chr, range(0xFE00, 0xFE10))))
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "﹒": ".", "＋": "+", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "－": "-", " ": " ", " ": " ", " ": " ", "　": " "}


def plain(c: str) -> str:
    """What one character becomes: ASCII, nothing, or itself."""
    if c < "\x80":
        return c
    if c in INVISIBLE or unicodedata.category(c) == "Cf":
        return ""
    if c in SIGNS:
        return SIGNS[c]
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded < "\x80" else c


class Plain(dict):
    def __missing__(self, c):
        self[c] = out = plain(c)
        return out


PLAIN = Plain()
# The digits' names in the languages of the documents.
DIGIT_WORDS = {
    w: str(i % 10)
    for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for i, w in enumerate(words.split())
} | {"oh": "0", "zwo": "2"}
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:{_WORDS}|[0-9])(?:[\x20,-]{{1,2}}(?:{_WORDS}|[0-9]))+(?![^\W_])")
SPELLED_ONE = re.compile(r"(?i)[^\W\d_]+|[0-9]|[^\w]+")
FIRST = re.compile(r"(?i)zero|one|two|three|four|five|seven|eight|nine|null|eins|zwei|drei|vier|sechs|sieben|acht|neun|zéro|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve")
AT, DOT = r"(?:at|arroba|chez|ät)", r"(?:dot|punkt|point|punto)"
GAP = r"\s{1,3}"
BRACKET_AT = re.compile(rf"(?i)\s{{0,3}}[\[({{<]\s?(?:{AT}|@)\s?[\])}}>]\s{{0,3}}")
BRACKET_DOT = re.compile(rf"(?i)\s{{0,3}}[\[({{<]\s?(?:{DOT}|\.)\s?[\])}}>]\s{{0,3}}")
_LINK = rf"(?:{GAP}{DOT}{GAP}|\.)"
BARE = re.compile(rf"(?i)(?P<local>[A-Za-z0-9_%+-]++(?:{_LINK}[A-Za-z0-9_%+-]++)*+)(?P<at>{GAP}{AT}{GAP}|@)(?P<domain>[A-Za-z0-9-]++(?:{_LINK}[A-Za-z0-9-]++)++)")
#: Words that dots and at-signs of any kind join, as far as they go; and the at-signs in them.
CHAIN = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:(?:{_LINK}|{GAP}{AT}{GAP}|@)[A-Za-z0-9_%+-]++)++")
CHAIN_AT = re.compile(rf"(?i){GAP}{AT}{GAP}|@")
BARE_SIGN = re.compile(rf"(?i){GAP}({AT}|{DOT}){GAP}")
ANY_DOT = re.compile(rf"(?i){GAP}{DOT}{GAP}")
DIGIT_DOT = re.compile(rf"(?i)(?<=[0-9]){GAP}{DOT}{GAP}(?=[0-9])")
AT_DOMAIN = re.compile(rf"(?i)(?<![^\W_]){AT}{GAP}[A-Za-z0-9-]++\.[A-Za-z0-9-]")
# Words that stand before 'at' or 'chez' and a site's name in prose.
PROSE = frozenset(
    "look looks looked looking see seen visit visited find finds found read more us me it him her them you is are was were be been here there online site page pages website blog shop store "
    "available hosted published posted listed sold live based work works worked working buy order ordered register registered sign signed up start started download downloaded "
    "stay stayed meet met arrive arrived and or but not only also now then today out details information documentation docs "
    "travaille travaillent travailler achète acheter commande commander commandé est sont ici disponible aller va et ou".split()
)

_SEPARATOR = rf"(?:{GAP}{DOT}{GAP}|\s{{0,3}}[\[({{<]\s?(?:{DOT}|\.)\s?[\])}}>]\s{{0,3}}|[\s,().-]{{1,4}})"
DIGIT_ROW = re.compile(rf"(?i)(?<![^\W_])(?:{_WORDS}|[0-9]++)(?:{_SEPARATOR}(?:{_WORDS}|[0-9]++))+(?![^\W_])")
DIGIT_TOKEN = re.compile(rf"(?i)(?<![^\W_])(?:{_WORDS}|[0-9]++)(?![^\W_])")
ANY_SIGN = re.compile(rf"(?i){DOT}|\.")


class Traced:
    """A text and the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.touched = [False] * len(text)
        #: Whether something before the character is gone, so that it wasn't the neighbour of the one before it.
        self.joined = [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, given in order without overlap; what is put in stands for the whole span."""
        if not edits:
            return
        text, start, end, touched, joined, at, gone = [], [], [], [], [], 0, False
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            touched += self.touched[at:a]
            if at < a:
                joined.append(gone or self.joined[at])
                joined += self.joined[at + 1 : a]
                gone = False
            if a < b:
                gone = gone or self.joined[a] or not new
            if new:
                text.append(new)
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
                touched += [True] * len(new)
                joined += [gone] + [False] * (len(new) - 1)
                gone = False
            at = b
        self.text, self.start, self.end, self.touched, self.joined = "".join(text), start, end, touched, joined

    def changed(self, a: int, b: int) -> bool:
        """Whether a transducer made any of these characters, or made neighbours of them."""
        return any(self.touched[a:b]) or any(self.joined[a + 1 : b])


def homoglyphs(t: Traced) -> None:
    if not t.text.isascii():
        t.rewrite([(i, i + 1, new) for i, c in enumerate(t.text) if (new := PLAIN[c]) != c])


def spelled_digits(t: Traced) -> None:
    edits = []
    for run in SPELLED.finditer(t.text):
        parts = [(m.start(), m.end(), m[0].lower()) for m in SPELLED_ONE.finditer(t.text, run.start(), run.end())]
        words = [p for p in parts if p[2] in DIGIT_WORDS]
        if len(words) < 3:
            continue
        for k, (a, b, w) in enumerate(parts):
            if w in DIGIT_WORDS:
                edits.append((a, b, DIGIT_WORDS[w]))
            elif not w.isdigit() and 0 < k < len(parts) - 1:
                edits.append((a, b, ""))
    t.rewrite(edits)


def number_row(text: str, row: re.Match) -> list[re.Match]:
    """The digit words and numbers of a row that could be an ip, a phone or a card; else none."""
    parts = list(DIGIT_TOKEN.finditer(text, *row.span()))
    spelled = [not m[0].isdigit() for m in parts]
    digits = sum(1 if own else len(m[0]) for m, own in zip(parts, spelled, strict=True))
    return parts if any(spelled) and (digits >= 8 or digits >= 4 and len(ANY_SIGN.findall(row[0])) >= 3) else []


def rows_of_digits(t: Traced) -> bool:
    """Each digit word of such rows becomes a digit, next to one-digit neighbours without a gap. Whether any did."""
    edits = []
    for row in DIGIT_ROW.finditer(t.text):
        parts = number_row(t.text, row)
        for k, m in enumerate(parts):
            word = m[0].lower()
            if k and not (parts[k - 1][0].isdigit() and word.isdigit()):
                a, b = parts[k - 1].end(), m.start()
                if not t.text[a:b].strip(" \t\r\n,-"):
                    single = all(not x[0].isdigit() or len(x[0]) == 1 for x in (parts[k - 1], m))
                    edits.append((a, b, "" if single else " "))
            if not word.isdigit():
                edits.append((*m.span(), DIGIT_WORDS[word]))
    t.rewrite(edits)
    return bool(edits)


def disguises(t: Traced) -> None:
    for pattern, sign in ((BRACKET_AT, "@"), (BRACKET_DOT, ".")):
        t.rewrite([(*m.span(), sign) for m in pattern.finditer(t.text)])
    dots = ANY_DOT.search(t.text)
    if dots or AT_DOMAIN.search(t.text):
        edits = []
        for m in bare_addresses(t.text):
            if addressed(t, m):
                edits += [(*s.span(), "@" if re.fullmatch(rf"(?i){AT}", s[1]) else ".") for s in BARE_SIGN.finditer(t.text, *m.span())]
        t.rewrite(edits)
    if dots:
        t.rewrite([(*m.span(), ".") for m in DIGIT_DOT.finditer(t.text)])


def bare_addresses(text: str):
    """Matches of BARE from the left. Of a chain of words it is tried at the start and behind each at-sign: in between it would end at the same sign. Linear for any text."""
    for chain in CHAIN.finditer(text):
        at, end = chain.span()
        while at < end:
            m = BARE.match(text, at, end)
            if m:
                yield m
            sign = CHAIN_AT.search(text, m.end() if m else at, end)
            if not sign:
                break
            at = sign.end()


def addressed(t: Traced, m: re.Match) -> bool:
    """Whether a match of BARE is an address and no prose."""
    if ANY_DOT.search(m["domain"]):
        return True
    spoken = ANY_DOT.findall(m["local"])
    if m["at"] == "@":
        return any(x.strip().lower() == "dot" for x in spoken)
    if not any(len(x) > 1 and x.isalpha() and (x.islower() or x.isupper()) for x in m["domain"].split(".")[1:]):
        return False
    local = m["local"]
    sure = spoken or any(t.touched[m.start("domain") : m.end("domain")]) or m["at"].strip().lower() in ("arroba", "ät")
    return bool(sure) or not local.isdigit() and local.lower() not in PROSE


HINT = re.compile(r"(?i)[\[({<]\s?(?:" + AT + "|" + DOT + r"|@|\.)\s?[\])}>]")
#: Characters that a transducer may change; accented letters of prose aren't among them.
FOREIGN = re.compile("[^\x00-\x7f¡-¬®-ɏ‘-‟…]|ª|º")


def hints(text: str, low: str) -> bool:
    """Whether any transducer could lead to a new hit; cheap, and never false where one could."""
    if FOREIGN.search(text) or (("(" in text or "[" in text or "{" in text or "<" in text) and HINT.search(text)):
        return True
    if AT_DOMAIN.search(low):
        return True
    return (("dot" in low or "punkt" in low or "point" in low or "punto" in low) and bool(ANY_DOT.search(text))) or bool(FIRST.search(low) and any(len(DIGIT_NAME.findall(m[0])) > 2 for m in SPELLED.finditer(text))) or any(number_row(text, m) for m in DIGIT_ROW.finditer(text))


DIGIT_NAME = re.compile(r"[^\W\d_]+")


def find(text: str | None) -> list[dict]:
    """All spans of a text, base ones and added ones."""
    if not text:
        return []
    base = detect(text)
    out = [(*x, True) for x in base]
    if hints(text, text.lower()):
        added = []
        for rows in (False, True):
            t = Traced(text)
            homoglyphs(t)
            if rows and not rows_of_digits(t):
                break
            spelled_digits(t)
            disguises(t)
            added += [(kind, t.start[a], t.end[b - 1], False) for kind, a, b in detect(t.text) if t.changed(a, b)]
        for kind, start, end, _ in sorted(added, key=lambda x: x[1] - x[2]):  # longest first
            inside = any(k == kind and s <= start and end <= e for k, s, e, _ in out)
            if not inside and not any(k == kind and s < end and start < e for k, s, e, own in out if not own):
                out.append((kind, start, end, False))
    out.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    return [{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in out]


def find_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    return map_texts(df, [key, text], lambda: lambda texts: {"spans": pa.array([find(t) for t in texts], kind)}, f"{key} {dict(df.dtypes)[key]}, spans {SPANS}")


def masked(text: str | None) -> str | None:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    spans = sorted(find(text), key=lambda x: (x["start"], -x["end"]))
    if not spans:
        return text
    out, at, end = [], 0, -1
    for s in spans:
        if s["start"] >= end:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            end = at = s["end"]
        else:
            end = at = max(end, s["end"])
    return "".join(out) + text[at:]


def mask_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the personal data in text masked; all other columns, and their order, stay."""
    names, field = df.columns, df.columns.index(text)

    def run(batches):
        for part in slices(batches, field):
            columns = list(part.columns)
            columns[field] = pa.array([masked(t) for t in columns[field].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; n_<kind> counts all spans of the kind, n_spans those of all kinds, added ones too."""
    found = find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    base = F.sha2(_joined(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
