"""Text primitives as Column expressions: words, positions, matches with offsets, sentences.

Offsets count code points; utf16() converts where another unit is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript has it; Java's own class is narrower. Java tries the members of a class one by one, so most characters are ruled out by one range first.
WS = r"[[^!-~]&&[\s\x0b   -     　﻿]]"
#: The same characters as a string.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# The patterns of words and of the ends of sentences.
WORD = r"\p{L}++[\p{L}\p{N}'’-]*+"
#: Ends of a sentence: punctuation, a blank line, or the line before a Markdown block.
BOUNDARY = r"(?=[.!?\n…])(?:[.!?…]+|\n[ \t]*\n|\n(?=[ \t]*(?:#{1,6}[ \t]|[-*+][ \t]|>[ \t]|\d+[.)][ \t])))"
FINDING = "array<struct<text:string,offset:int,end:int>>"


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}++|(?<!{WS}){WS}++\z", "")


def normalise(text: Column) -> Column:
    """White space collapsed and trimmed, lower case."""
    return F.lower(trim(F.regexp_replace(text, rf"{WS}+", " ")))


def utf16(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


#: Noncharacters that stand around matches and between their groups; plain() takes them out of texts.
MARK, PART = "\ufdd0", "\ufdd1"


def plain(text: Column) -> Column:
    """The text without the noncharacters that find() and sentences() use, of the same length; null counts as empty."""
    marked = F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(PART))
    return F.when(marked, F.translate(text, MARK + PART, "\ufffd\ufffd")).otherwise(F.coalesce(text, F.lit("")))


#: What a case-insensitive pattern takes for the ASCII letters s, i and k.
ODD_CASE = "ſıİ\u212a"


def folded(text: Column, ascii_only: Column | bool = False) -> Column:
    """The text as a case-insensitive pattern sees its letters, for a plain search before the pattern's.

    Where only ASCII strings are searched for, other characters become one:
    Spark's lower() takes some 100 times as long on texts that aren't ASCII.
    """
    odd = text.rlike(f"(?=[^\\x00-\\x7f])[{ODD_CASE}]")
    return F.when(F.lit(ascii_only) & ~odd, F.lower(F.regexp_replace(text, r"[^\x00-\x7f]+", "\x7f"))).otherwise(F.lower(F.translate(text, "ſıİ", "sii")))


def quoted(text: str) -> str:
    """A string literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The next functions give SQL text: one parse of an expression in the JVM takes
# the place of hundreds of calls to it.
NONE_FOUND = f"cast(array() as {FINDING})"
#: Elements that a running sum appends to one array, 2 to the power of 6; sums of such chunks come first, so that the work is linear.
CHUNK = 64


def let(name: str, value: str, body: str) -> str:
    """SQL for body with a name for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(lengths: str) -> str:
    """SQL for the array of the sums of the elements before each one of an array of whole numbers."""
    chunks = f"sequence(0, greatest(0, shiftright(size(rl) - 1, 6)))"
    before = f"aggregate({chunks}, array(0), (ra, rj) -> concat(ra, array(ra[rj] + aggregate(slice(rl, {CHUNK} * rj + 1, {CHUNK}), 0, (rs, rx) -> rs + rx))))"
    inside = f"aggregate(slice(rl, {CHUNK} * rj + 1, {CHUNK}), named_struct('s', rp[rj], 'o', cast(array() as array<int>)), (rs, rx) -> named_struct('s', rs.s + rx, 'o', concat(rs.o, array(rs.s))), rs -> rs.o)"
    return let("rl", lengths, let("rp", before, f"flatten(transform({chunks}, rj -> {inside}))"))


def find(text: str, pattern: str, hit: bool = False, needs: str | None = None, where: str | None = None) -> str:
    """Non-overlapping matches of a plain() column from the left, as FINDING. Where the condition `needs` is false there is none, and no pattern runs.

    One pass of the pattern puts marks around its matches; the lengths of what
    lies between the marks give the places, so no UDF is needed and the work
    is linear. With hit, a match is made of three groups, of which the second
    is reported. `where` is a condition on a match, in which ps[fi - 1] is the
    text since the last match, and ps[fi - 2] that match from the second on.
    """
    marked = f"{MARK}$1{PART}$2{PART}$3{MARK}" if hit else f"{MARK}$0{MARK}"
    length = "length(fx) - CASE WHEN fk % 2 = 1 THEN 2 ELSE 0 END" if hit else "length(fx)"
    shown = f"split_part(ps[fi], '{PART}', 2)" if hit else "ps[fi]"
    lead = f" + length(split_part(ps[fi], '{PART}', 1))" if hit else ""
    places = "sequence(1, size(ps) - 2, 2)"
    if where:
        places = f"filter({places}, fi -> {where})"
    one = f"named_struct('text', {shown}, 'offset', st[fi]{lead}, 'end', st[fi]{lead} + length({shown}))"
    starts = running(f"transform(ps, (fx, fk) -> {length})")
    rows = let("ps", f"split(fm, '{MARK}', -1)", let("st", starts, f"transform({places}, fi -> {one})"))
    found = let("fm", f"regexp_replace({text}, {quoted(pattern)}, '{marked}')", f"CASE WHEN contains(fm, '{MARK}') THEN {rows} ELSE {NONE_FOUND} END")
    return found if needs is None else f"CASE WHEN {needs} THEN {found} ELSE {NONE_FOUND} END"


def without_contained(hits: str, *spans: str) -> str:
    """Hits that neither contain one of the spans nor lie in one. Each list of spans is in order and doesn't overlap, as find() gives it.

    The spans are found once, not for each hit; of a hit's candidates, the last
    span that starts before it and the next one, the place is found by halving.
    """
    inside = lambda a, b: f"({a}.offset >= {b}.offset AND {a}.`end` <= {b}.`end`)"
    middle = "wa.lo + shiftright(wa.hi - wa.lo, 1)"
    halve = f"CASE WHEN wa.lo >= wa.hi THEN wa WHEN ws[{middle}].offset < wh.offset THEN named_struct('lo', {middle} + 1, 'hi', wa.hi) ELSE named_struct('lo', wa.lo, 'hi', {middle}) END"
    before = f"aggregate(sequence(1, cast(ceil(log2(size(ws) + 1)) as int)), named_struct('lo', 0, 'hi', size(ws)), (wa, wk) -> {halve}, wa -> wa.lo)"
    near = f"exists(slice(ws, greatest({before}, 1), 2), wz -> {inside('wh', 'wz')} OR {inside('wz', 'wh')})"
    lists = f"filter(array({', '.join(spans)}), ws -> size(ws) > 0)"
    return let("wx", hits, f"CASE WHEN size(wx) = 0 THEN wx ELSE {let('wt', lists, f'filter(wx, wh -> NOT exists(wt, ws -> {near}))')} END")


def by_offset(hits: str) -> str:
    """Stable order by offset: of equal offsets, that of the input stays."""
    return f"transform(sort_array(transform({hits}, (h, i) -> named_struct('k', h.offset, 'i', i, 'h', h))), x -> x.h)"


def sentence_lengths(text: Column) -> Column:
    """Word counts of the sentences that have words."""
    return F.filter(F.transform(F.split(text, BOUNDARY, -1), count_words), lambda n: n > 0)


def sentences(text: str) -> Column:
    """array<struct<text, offset, words>> of a plain() column: punctuation stays with its sentence, pieces without words go."""
    end = "CASE WHEN si + 1 < size(ps) AND NOT startswith(ps[si + 1], '\n') THEN ps[si + 1] ELSE '' END"
    spaces = quoted(SPACES)
    one = "named_struct('text', sb[si], 'offset', st[2 * si] + length(sr[si]) - length(sl[si]), 'words', sw[si])"
    count = f"transform(sb, sx -> regexp_count(sx, {quoted(WORD)}))"
    rows = let("sw", count, let("st", running("transform(ps, sx -> length(sx))"), f"transform(filter(sequence(0, size(sr) - 1), si -> sw[si] > 0), si -> {one})"))
    rows = let("sr", f"transform(sequence(0, size(ps) - 1, 2), si -> concat(ps[si], {end}))", let("sl", f"transform(sr, sx -> trim(LEADING {spaces} FROM sx))", let("sb", f"transform(sl, sx -> trim(TRAILING {spaces} FROM sx))", rows)))
    return F.expr(let("ps", f"split(regexp_replace({text}, {quoted(BOUNDARY)}, '{MARK}$0{MARK}'), '{MARK}', -1)", rows))


def line_starts(text: str) -> str:
    """SQL for the offsets at which the lines of a column start."""
    return running(f"transform(split({text}, '\n', -1), lx -> length(lx) + 1)")


def line_at(starts: str, offset: str) -> str:
    """SQL for the 1-based line of an offset, by halving the sorted array of line starts."""
    halve = f"CASE WHEN {starts}[la.lo + shiftright(la.hi - la.lo, 1)] <= {offset} THEN named_struct('lo', la.lo + shiftright(la.hi - la.lo, 1), 'hi', la.hi) ELSE named_struct('lo', la.lo, 'hi', la.lo + shiftright(la.hi - la.lo, 1)) END"
    return f"aggregate(sequence(1, cast(ceil(log2(size({starts}) + 1)) as int) + 1), named_struct('lo', 0, 'hi', size({starts})), (la, lk) -> {halve}, la -> la.lo + 1)"


def deviation(numbers: str) -> Column:
    """Population standard deviation of an array column in one pass, 0 under two elements."""
    mean = "(a.m + (v - a.m) / (a.n + 1))"
    step = f"named_struct('n', a.n + 1, 'm', {mean}, 's', a.s + (v - a.m) * (v - {mean}))"
    return F.expr(f"aggregate({numbers}, named_struct('n', 0D, 'm', 0D, 's', 0D), (a, v) -> {step}, a -> CASE WHEN a.n < 2 THEN 0D ELSE sqrt(a.s / a.n) END)")


def per_thousand(n: Column, of: Column) -> Column:
    return F.when(of <= 0, F.lit(0.0)).otherwise(n * F.lit(1000.0) / F.greatest(of, F.lit(1)))


def band_score(density: Column, floor: float, ceiling: float) -> Column:
    """1 up to the floor, 0 from the ceiling on, linear between."""
    return F.when(density <= floor, F.lit(1.0)).when(density >= ceiling, F.lit(0.0)).otherwise((F.lit(ceiling) - density) / F.lit(ceiling - floor))
