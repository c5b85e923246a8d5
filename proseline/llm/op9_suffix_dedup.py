"""Suffix-array dedup: remove every byte that a repeated string of SPAN bytes covers.

1. Anchors: of the GRAM-byte strings of each SPAN-byte window, the one with
   the smallest hash. Equal windows have equal anchors at equal places, so a
   repeated window shows as a repeated anchor. An anchor's context is all
   bytes that its windows can reach; it is filed with hashes of the context
   and of three long parts, one of which any shared window must contain.
2. Anchors are shuffled by hash. Anchors with equal hashes and context hashes
   are a class. Two members of each class are fetched from their documents,
   and one of each class that shares a part with another class of the anchor.
   Fetched contexts that lie on one diagonal of two documents are one piece.
3. What is fetched is cut where its content says so, every SPARSE bytes or so,
   and the pieces, numbered in byte order, make a string of whole numbers.
   Its suffix array, built by Lyndon grouping (suffix_groups), puts suffixes
   that start alike side by side; a window is repeated if another window with
   the same bytes before its first cut has, from there on, enough in common
   by the array's neighbours.
4. Where the array finds all windows of a class's first member repeated, all
   members' contexts are marked; else the windows that it finds. The marks of
   a document are united and the rest of its bytes kept.

Anchors, contexts and marks are rows. A task that reads anchors streams them
and holds HELD rows at most: of an anchor with more classes these go on to a
shuffle by their parts. Common anchors, which alone would fill much of a task,
are dealt to many tasks by their contexts, and such classes row by row; each
task that has some of such a class files a head, and the heads are put
together. What is common is counted in one document of SHARE; that decides on
the dealing alone, never on the result. An array has ARRAY_BYTES, or the
contexts of one anchor that share a part.

Defined results: null texts count as empty. Texts shorter than SPAN bytes keep
all. The table's key is taken to be unique; rows that repeat a key and its
text are documents of their own. Rows without a key keep all their bytes, and
nothing is compared with them. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import hot_join, slices, stored, table
from proseline.llm.suffix_groups import suffix_array

SPAN, GRAM = 200, 32
WINDOW = SPAN - GRAM + 1
#: Parts of a context: any shared window holds one of them, by how far left of the anchor it starts.
STEP = 56
PART = SPAN - STEP
PARTS = tuple(range(0, SPAN - GRAM, STEP))
#: Bytes of a long text that are looked at at once, and mean length of the pieces of a context.
PIECE, SPARSE = 1 << 20, 32
#: Bytes of an array; a larger group of one anchor has an array of its own. Bytes from which a piece of a diagonal is cut.
ARRAY_BYTES, DIAGONAL = 1 << 19, 1 << 17
#: Rows that a task holds while it streams anchors.
HELD = 100_000
#: One document of so many says which anchors and classes are common: how often they must be there, and what part of a task's rows they must be; how many at most are dealt to many tasks.
SHARE, COMMON, OF_A_TASK, MOST_COMMON = 64, 32, 4, 1000
#: Windows that are compared at once.
WINDOWS_AT_ONCE = 400_000

_RANDOM = np.random.default_rng(20240917)
_TABLE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = [np.uint64(int(x) | 1) for x in _RANDOM.integers(0, 1 << 63, 12, dtype=np.uint64)]
_U = np.uint64


def gram_hashes(b: np.ndarray) -> list[np.ndarray]:
    """h[j][i] is a hash of b[i : i + 2**j]."""
    h = [_TABLE[b]]
    for j in range(7):
        low, size = h[-1], 1 << j
        if len(low) <= size:
            break
        high = low[size:]
        h.append(low[:-size] * _FACTOR[j] + (high ^ (high >> _U(29))))
    return h


def hash_at(h: list[np.ndarray], i: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes from each i on."""
    j = n.bit_length() - 1
    x = h[j][i] * _FACTOR[8] + h[j][i + n - (1 << j)] * _FACTOR[9]
    return x ^ (x >> _U(31))


def anchors_of(b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the anchors of all windows of b, and its hashes."""
    if len(b) < SPAN:
        return np.zeros(0, np.int64), []
    h = gram_hashes(b)
    x = h[5] ^ (h[5] >> _U(32))
    m = len(x)
    value = (((x * _FACTOR[7]) >> _U(24)) << _U(24)) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // WINDOW)
    padded = np.full(blocks * WINDOW, _U(0xFFFFFFFFFFFFFFFF))
    padded[:m] = value
    padded = padded.reshape(blocks, WINDOW)
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(padded, axis=1).ravel()
    least = np.minimum(after[: m - WINDOW + 1], before[WINDOW - 1 : m])
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (least & _U((1 << 24) - 1)).astype(np.int64), h


def filed(data: bytes):
    """(hash, place, parts' hashes, context's hash) arrays of a text's anchors, piece by piece."""
    last = -1
    for start in range(0, max(1, len(data) - SPAN + 1), PIECE):
        a, z = max(0, start - SPAN), min(len(data), start + PIECE + 2 * SPAN)
        b = np.frombuffer(data, np.uint8, z - a, a)
        core = b[start - a : min(len(b), start - a + PIECE + SPAN - 1)]
        places, h = anchors_of(core)
        if not len(places):
            continue
        if len(core) < len(b):
            places, h = places + (start - a), gram_hashes(b)
        places = places[places + a > last]
        if not len(places):
            continue
        last = int(places[-1]) + a
        parts = []
        for left in PARTS:
            ok = (places >= left) & (places - left + PART <= len(b))
            k = np.zeros(len(places), np.uint64)
            k[ok] = hash_at(h, places[ok] - left, PART) | _U(1)
            parts.append((k >> _U(32)).astype(np.uint32).view(np.int32))
        whole = places + a
        context = np.array([xxhash.xxh3_64_intdigest(data[max(0, p - WINDOW + 1) : p + SPAN], min(p, WINDOW)) for p in whole.tolist()], np.uint64)
        yield hash_at(h, places, GRAM).view(np.int64), whole, parts, context.view(np.int64)


def anchor_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    names = ["h", "id", "place", "p0", "p1", "p2", "c"]

    def run(batches):
        for part in slices(batches):
            held: list = []
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for h, place, (p0, p1, p2), c in filed(t.encode("utf-8", "surrogatepass")) if t else ():
                    held.append((h, np.full(len(h), i, np.int64), place, p0, p1, p2, c))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)

    return df.select(F.col(key).cast("long"), text).where(F.col(key).isNotNull()).mapInArrow(run, "h long, id long, place long, p0 int, p1 int, p2 int, c long")


def repeated(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether (h, x) occurs again."""
    order = np.lexsort((x, h))
    same = (h[order][1:] == h[order][:-1]) & (x[order][1:] == x[order][:-1])
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again


#: Kinds of rows that anchors become: a member of a class of several, the pair of such a class that is fetched, a context that shares a part with another, a class of an anchor with very many, what one task has of a common class.
MEMBER, PAIR, PARTIAL, LATE, HEAD = range(5)
_ANCHORS = ["kind", "h", "c", "id", "place", "n", "id2", "place2", "p0", "p1", "p2"]
_LONGS = {"h", "c", "id", "place", "n", "id2", "place2"}


class Common(NamedTuple):
    """Anchors that are dealt to many tasks; and common classes, whose h and c are both among these. More than the common ones does no harm."""

    anchors: list[int] = []
    class_h: list[int] = []
    class_c: list[int] = []

    def __bool__(self) -> bool:
        return bool(self.anchors)

    def deal(self) -> Column:
        """What rows are dealt to tasks by."""
        one = F.col("h").isin(self.class_h) & F.col("c").isin(self.class_c)
        return F.when(one, F.xxhash64("id", "place")).when(F.col("h").isin(self.anchors), F.xxhash64("h", "c")).otherwise(F.col("h"))

    def marks(self, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the anchor is common, and whether the class is."""
        return np.isin(h, self.anchors), np.isin(h, self.class_h) & np.isin(c, self.class_c)


def common_anchors(df: DataFrame, key: str, text: str) -> Common:
    """The commonest anchors and classes, as one document of SHARE shows them, that make 1 / OF_A_TASK of a task's rows. Three numbers for each of MOST_COMMON come to the driver."""
    few = df.where(F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(9)), F.lit(SHARE)) == 0)
    counts = stored(anchor_rows(few, key, text).groupBy("h", "c").count(), "suffix-common")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(COMMON, (counts.agg(F.sum("count")).first()[0] or 0) // (tasks * OF_A_TASK))
    most = lambda rows: rows.where(F.col("count") >= least).orderBy(F.desc("count"), *rows.columns[:-1]).limit(MOST_COMMON).collect()
    classes = most(counts)
    anchors = {r.h for r in most(counts.groupBy("h").agg(F.sum("count").alias("count")))} | {r.h for r in classes}
    return Common(sorted(anchors), sorted({r.h for r in classes}), sorted({r.c for r in classes}))


class Streamed:
    """Turns anchors sorted by (h, c) into rows of the five kinds, in numpy columns h, id, place, p0, p1, p2, c."""

    def __init__(self, dealt: Common = Common()):
        self.dealt = dealt
        self.rows: list[np.ndarray] | None = None  # rows of the last class, which may go on
        self.gone = 0  # rows of that class that are out already
        self.classes: list[np.ndarray] | None = None  # classes of the last anchor, which may go on
        self.late = None  # an anchor whose classes are out already

    @staticmethod
    def batch(kind: int, **columns) -> pa.RecordBatch:
        n = len(columns["h"])
        arrays = [pa.array(np.full(n, kind, np.int32))] + [pa.array(columns[k]) if k in columns else pa.nulls(n, pa.int64() if k in _LONGS else pa.int32()) for k in _ANCHORS[1:]]
        return pa.RecordBatch.from_arrays(arrays, names=_ANCHORS)

    def add(self, rows: list[np.ndarray]):
        rows = rows if self.rows is None else [np.concatenate(x) for x in zip(self.rows, rows, strict=True)]
        h, c = rows[0], rows[6]
        new = np.nonzero((h[1:] != h[:-1]) | (c[1:] != c[:-1]))[0] + 1
        if len(new):
            yield from self.whole_classes([x[: new[-1]] for x in rows])
            rows = [x[new[-1] :] for x in rows]
        if len(rows[0]) > HELD:  # a class of very many: two members stay
            yield self.batch(MEMBER, h=rows[0][2:], c=rows[6][2:], id=rows[1][2:], place=rows[2][2:])
            self.gone += len(rows[0]) - 2
            rows = [x[:2] for x in rows]
        self.rows = rows

    def end(self):
        if self.rows is not None:
            yield from self.whole_classes(self.rows)
            yield from self.whole_anchors(self.classes)

    def whole_classes(self, rows: list[np.ndarray]):
        """Members and pairs of classes that are whole; all classes go on to their anchors."""
        h, ids, place, p0, p1, p2, c = rows
        starts = np.concatenate([[0], np.nonzero((h[1:] != h[:-1]) | (c[1:] != c[:-1]))[0] + 1])
        held = np.diff(np.append(starts, len(h)))
        n = held.copy()
        n[0] += self.gone
        self.gone = 0
        spread, head = self.dealt.marks(h[starts], c[starts])
        several = np.repeat((held > 1) | head, held)
        if several.any():
            yield self.batch(MEMBER, h=h[several], c=c[several], id=ids[several], place=place[several])
        pair = (held > 1) & ~head
        if pair.any():
            one = starts[pair]
            yield self.batch(PAIR, h=h[one], c=c[one], id=ids[one], place=place[one], n=n[pair], id2=ids[one + 1], place2=place[one + 1])
        if head.any():
            one, last = starts[head], (starts + held - 1)[head]
            yield self.batch(HEAD, h=h[one], c=c[one], id=ids[one], place=place[one], n=n[head], id2=ids[last], place2=place[last], p0=p0[one], p1=p1[one], p2=p2[one])
        classes = [x[starts] for x in rows] + [n]
        if spread.any():  # other tasks have classes of these anchors too
            some = spread & ~head
            if some.any():
                yield self.batch(LATE, **dict(zip(("h", "id", "place", "p0", "p1", "p2", "c", "n"), [x[some] for x in classes], strict=True)))
            classes = [x[~spread] for x in classes]
            if not len(classes[0]):
                return
        classes = classes if self.classes is None else [np.concatenate(x) for x in zip(self.classes, classes, strict=True)]
        h = classes[0]
        cut = int(np.searchsorted(h, h[-1]))
        if cut:
            yield from self.whole_anchors([x[:cut] for x in classes])
            classes = [x[cut:] for x in classes]
        if len(classes[0]) > HELD or self.late == h[-1]:
            yield self.batch(LATE, **dict(zip(("h", "id", "place", "p0", "p1", "p2", "c", "n"), classes, strict=True)))
            self.late, classes = h[-1], None
        self.classes = classes

    def whole_anchors(self, classes: list[np.ndarray] | None):
        """The classes that share a part with another of their anchor, unless all of those are of several members."""
        if classes is None or not len(classes[0]):
            return
        if self.late is not None and self.late == classes[0][0]:
            first = classes[0] == self.late
            yield self.batch(LATE, **dict(zip(("h", "id", "place", "p0", "p1", "p2", "c", "n"), [x[first] for x in classes], strict=True)))
            classes = [x[~first] for x in classes]
        h, ids, place, p0, p1, p2, c, n = classes
        near = np.zeros(len(h), bool)
        for p in (p0, p1, p2):
            near |= repeated(h, p) & (p != 0)
        near &= np.isin(h, h[near & (n == 1)])
        if near.any():
            yield self.batch(PARTIAL, h=h[near], c=c[near], id=ids[near], place=place[near], n=n[near])


def shared_anchors(rows: DataFrame, dealt: Common = Common()) -> DataFrame:
    """Rows of the five kinds from all anchors."""

    def run(batches):
        stream = Streamed(dealt)
        for batch in batches:
            if batch.num_rows:
                yield from stream.add([x.to_numpy(zero_copy_only=False) for x in batch.columns])
        yield from stream.end()

    schema = "kind int, " + ", ".join(f"{k} {'long' if k in _LONGS else 'int'}" for k in _ANCHORS[1:])
    return rows.repartition(dealt.deal() if dealt else F.col("h")).sortWithinPartitions("h", "c", "id", "place").mapInArrow(run, schema)


def whole_heads(wanted: DataFrame) -> DataFrame:
    """wanted with the heads of each common class made one: a pair, where it has several members, and a class of its anchor."""
    heads = wanted.where(F.col("kind") == HEAD).groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct("id", "place", "p0", "p1", "p2")).alias("a"), F.max(F.struct("id2", "place2")).alias("z"))
    made = heads.select("h", "c", "a.id", "a.place", "n", "z.id2", "z.place2", "a.p0", "a.p1", "a.p2")
    kinds = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), *_ANCHORS[1:])
    return wanted.where(F.col("kind") != HEAD).union(kinds(made.where("n > 1"), PAIR)).union(kinds(made, LATE))


def asked_for(wanted: DataFrame) -> DataFrame:
    """(id, key, place, whole, diagonal, h, c, n): contexts to fetch, and the array that they are for; h, c and n where a class is to be checked."""
    none = F.lit(None).cast("long")
    pair = wanted.where((F.col("kind") == PAIR) & ((F.col("id") != F.col("id2")) | (F.col("place") != F.col("place2"))))
    apart = F.col("id") != F.col("id2")
    array = F.when(apart, F.xxhash64("id", "id2", F.col("place2") - F.col("place"))).otherwise(F.col("h"))
    ends = F.array(*(F.struct(F.col(i).alias("id"), array.alias("key"), F.col(p).alias("place"), F.lit(True).alias("whole"), apart.alias("diagonal"), h.alias("h"), c.alias("c"), n.alias("n")) for i, p, h, c, n in (("id", "place", F.col("h"), F.col("c"), F.col("n")), ("id2", "place2", none, none, none))))
    out = pair.select(F.explode(ends).alias("x")).select("x.*")
    plain = lambda rows, array: rows.select("id", array.alias("key"), "place", (F.col("n") > 1).alias("whole"), F.lit(False).alias("diagonal"), none.alias("h"), none.alias("c"), none.alias("n"))
    out = out.union(plain(wanted.where(F.col("kind") == PARTIAL), F.col("h")))
    late = wanted.where(F.col("kind") == LATE)
    if not late.isEmpty():
        parts = late.select("id", "place", "n", "h", F.posexplode(F.array("p0", "p1", "p2")).alias("j", "p")).where("p <> 0").withColumn("g", F.xxhash64("h", "j", "p"))
        again = parts.groupBy("g").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("least")).where("times > 1 and least = 1")
        out = out.union(plain(hot_join(parts, again, "g", "id", "times").where("times is not null"), F.col("g")))
    return out


def pieces_of(size: int, asked: list[dict]):
    """(key, start, end, whole, checks) of the pieces of a document of `size` bytes that hold the contexts asked for.

    Contexts of one diagonal that overlap are one piece, cut after DIAGONAL
    bytes; both documents of a diagonal have the same ones, so the cuts and
    the numbers that go into the keys are the same too.
    """
    asked.sort(key=lambda x: (x["key"], x["place"]))
    last, number, piece = None, 0, None
    for x in asked:
        a, z = max(0, x["place"] - WINDOW + 1), min(size, x["place"] + SPAN)
        check = [] if x["h"] is None else [x]
        if piece and x["diagonal"] and x["key"] == last and a <= piece[2] and piece[2] - piece[1] < DIAGONAL:
            piece[2] = max(piece[2], z)
            piece[4].extend(check)
            continue
        if piece:
            yield piece
        number = number + 1 if x["key"] == last else 0
        last = x["key"]
        key = (x["key"] + number * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) if x["diagonal"] else x["key"]
        piece = [key, a, z, x["whole"], check]
    if piece:
        yield piece


_CHECK = pa.struct([("place", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])


def contexts(df: DataFrame, asked: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, start, whole, context, checks): the pieces of the documents that are asked for."""
    lists = asked.groupBy("id").agg(F.collect_list(F.struct("key", "place", "whole", "diagonal", "h", "c", "n")).alias("asked"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).join(lists, "id")

    def run(batches):
        for part in slices(batches):
            out, size = [], 0
            for i, t, wanted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                for k, a, z, whole, checks in pieces_of(len(data), wanted):
                    out.append((k, i, a, whole, data[a:z], checks))
                    size += z - a + 32 * len(checks)
                    if size > 4 << 20:
                        yield batch_of(out)
                        out, size = [], 0
            if out:
                yield batch_of(out)

    def batch_of(out):
        k, i, start, whole, c, checks = zip(*out, strict=True)
        arrays = [pa.array(k, pa.int64()), pa.array(i, pa.int64()), pa.array(start, pa.int64()), pa.array(whole, pa.bool_()), pa.array(c, pa.binary()), pa.array([[{f.name: x[f.name] for f in _CHECK} for x in own] for own in checks], pa.list_(_CHECK))]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "id", "start", "whole", "context", "checks"])

    return rows.select("id", "t", "asked").mapInArrow(run, "key long, id long, start long, whole boolean, context binary, checks array<struct<place:long,h:long,c:long,n:long>>")


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def windows_of(parts: list[bytes], span: int, sparse: int, first_cut: int):
    """Cuts and windows of some parts, in small types.

    Cuts: (part, offset). Windows: (part, offset, number of the first cut at
    or after it that lies in it whole or -1, bytes from there on, hash of the
    bytes before).
    """
    data = b"".join(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    b = np.frombuffer(data, np.uint8)
    owner = np.repeat(np.arange(len(parts)), sizes)
    offset = np.arange(len(b)) - starts[owner]
    # cuts: where the four bytes from q on have a hash of one in `sparse`
    q = np.zeros(0, np.int64)
    if len(b) >= 4:
        x = b.astype(np.uint64)
        v = (x[:-3] | x[1:-2] << _U(8) | x[2:-1] << _U(16) | x[3:] << _U(24)) * _FACTOR[3]
        q = np.nonzero(((v >> _U(40)) % _U(sparse)) == 0)[0]
        q = q[q + 4 <= ends[owner[q]]]
    w = np.nonzero(offset + span <= sizes[owner])[0]
    nth = np.searchsorted(q, w)
    to = np.append(q, len(b) + span)[nth]
    cut = to + 4 <= w + span
    to = np.where(cut, to, w + span)
    # hashes of the bytes before the cut: sums of powers, shifted back
    longest = int(sizes.max(initial=0)) + 1
    power = np.multiply.accumulate(np.full(longest, _FACTOR[4]))
    inverse = np.multiply.accumulate(np.full(longest, _U(pow(int(_FACTOR[4]), -1, 1 << 64))))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[b] * power[offset])])
    head = (total[to] - total[w]) * inverse[offset[w]] + (to - w).astype(np.uint64) * _FACTOR[5]
    cuts = (owner[q].astype(np.int32), offset[q].astype(np.int32))
    return cuts, (owner[w].astype(np.int32), offset[w].astype(np.int32), np.where(cut, nth + first_cut, -1).astype(np.int64), (span - (to - w)).astype(np.int16), head)


def cut_order(parts: list[bytes], part: np.ndarray, offset: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of the suffix of each cut among all cuts, and how many bytes each rank's suffix shares with the one before."""
    n = len(part)
    rank, shared = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    if not n:
        return rank, shared
    # pieces from one cut through the next one's four bytes, numbered in byte order; 0 ends a part
    last = np.append(part[1:] != part[:-1], True).tolist()
    owners, begin = part.tolist(), offset.tolist()
    pieces = [parts[k][i:] if end else parts[k][i : j + 4] for k, i, j, end in zip(owners, begin, begin[1:] + [0], last, strict=True)]
    number = {p: k + 1 for k, p in enumerate(sorted(set(pieces)))}
    symbols, which = [], {}
    for k, (piece, end) in enumerate(zip(pieces, last, strict=True)):
        which[len(symbols)] = k
        symbols.append(number[piece])
        if end:
            symbols.append(0)
    order = [which[s] for s in suffix_array(symbols) if s in which]
    rank[order] = np.arange(n)
    before = b""
    for r, k in enumerate(order):
        text = parts[owners[k]][begin[k] : begin[k] + span]
        if r:
            shared[r] = common(before, text)
        before = text
    return rank, shared


def repeated_windows(parts: list[bytes], span: int = SPAN, sparse: int = SPARSE, ids: np.ndarray | None = None, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(part, offset) of the windows of `span` bytes that occur at another place too.

    ids and at say which document a part is of, and where it starts there:
    parts may overlap, and a window that two of them hold is one place.
    Windows are made for some parts and compared for some hashes at a time.
    """
    cuts, found, n = [], [], 0
    filled = np.cumsum([len(p) for p in parts]) // ARRAY_BYTES
    turns = [0, *(np.nonzero(filled[1:] != filled[:-1])[0] + 1).tolist(), len(parts)]
    for k, to in zip(turns, turns[1:], strict=False):
        c, w = windows_of(parts[k:to], span, sparse, n)
        cuts.append((c[0] + np.int32(k), c[1]))
        found.append((w[0] + np.int32(k), *w[1:]))
        n += len(c[0])
    part, offset, nth, need, head = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    if not len(part):
        return part.astype(np.int64), offset.astype(np.int64)
    rank, shared = cut_order(parts, *(np.concatenate(x) for x in zip(*cuts, strict=True)), span)
    levels = [shared]
    while (1 << len(levels)) <= len(shared):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    document = np.arange(len(parts)) if ids is None else np.unique(ids, return_inverse=True)[1]
    begins = np.zeros(len(parts), np.int64) if at is None else np.asarray(at, np.int64)
    twice = np.zeros(len(part), bool)
    passes = len(part) // WINDOWS_AT_ONCE + 1
    mine = (head >> _U(20)) % _U(passes) if passes > 1 else None
    for k in range(passes):
        some = np.nonzero(mine == _U(k))[0] if passes > 1 else np.arange(len(part))
        if len(some):
            place = (document[part[some]].astype(np.int64) << 40) + begins[part[some]] + offset[some]
            r = np.where(nth[some] >= 0, rank[np.maximum(nth[some], 0)] if len(rank) else 0, -1)
            twice[some] = in_several_places(head[some], need[some], r, place, levels)
    return part[twice].astype(np.int64), offset[twice].astype(np.int64)


def in_several_places(head: np.ndarray, need: np.ndarray, r: np.ndarray, place: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Which windows equal one at another place: equal heads, and suffixes whose neighbours in rank share enough all the way."""
    order = np.lexsort((r, head, need))
    h0, n0, r0 = head[order], need[order], r[order]
    same = (h0[1:] == h0[:-1]) & (n0[1:] == n0[:-1])
    spots = np.nonzero(same & (r0[1:] >= 0))[0]
    if len(spots):
        lo, hi = r0[spots] + 1, r0[spots + 1] + 1  # least of shared[lo:hi]; the same rank shares all
        size = hi - lo
        level = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        least = np.full(len(spots), 1 << 30, np.int64)
        for k in np.unique(level):
            m = (level == k) & (size > 0)
            least[m] = np.minimum(levels[k][lo[m]], levels[k][hi[m] - (1 << int(k))])
        same[spots] = least >= n0[spots + 1]
    firsts = np.nonzero(np.concatenate([[True], ~same]))[0]
    places = place[order]
    several = np.minimum.reduceat(places, firsts) != np.maximum.reduceat(places, firsts)
    out = np.zeros(len(head), bool)
    out[order] = np.repeat(several, np.diff(np.append(firsts, len(head))))
    return out


def runs_of(part: np.ndarray, offset: np.ndarray, span: int = SPAN):
    """Maximal byte ranges (part, start, end) that windows at these offsets cover, from sorted arrays."""
    if not len(part):
        return []
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (offset[1:] > offset[:-1] + span)])
    a = np.nonzero(new)[0]
    z = np.append(a[1:], len(part)) - 1
    return zip(part[a].tolist(), offset[a].tolist(), (offset[z] + span).tolist(), strict=True)


def marks(rows: DataFrame) -> DataFrame:
    """(id, a, z): byte ranges that repeated windows cover, of contexts that aren't whole classes'; (h, c, n): classes that are found repeated whole."""
    names = ["id", "a", "z", "h", "c", "n"]

    def out(tables):
        t = pa.concat_tables(tables)
        ids, start, whole, parts = t.column("id").to_numpy(), t.column("start").to_numpy(), t.column("whole").to_pylist(), t.column("context").to_pylist()
        part, offset = repeated_windows(parts, ids=ids, at=start)
        found = [(ids[k], start[k] + a, start[k] + z) for k, a, z in runs_of(part, offset) if not whole[k]]
        checks = t.column("checks").combine_chunks()
        own = np.repeat(np.arange(len(parts)), np.diff(checks.offsets.to_numpy()))
        place, h, c, n = (checks.flatten().field(k).to_numpy() for k in range(4))
        # a class is repeated whole if all windows of its context are
        size = np.array([len(p) for p in parts], np.int64)[own]
        first = np.maximum(0, place - WINDOW + 1) - start[own]
        last = np.minimum(place + SPAN - start[own], size) - SPAN
        at = part.astype(np.int64) << 40 | offset
        inside = np.searchsorted(at, own << 40 | last, "right") - np.searchsorted(at, own << 40 | first)
        good = inside == last - first + 1
        if found:
            i, a, z = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(a, pa.int64()), pa.array(z, pa.int64()), *(pa.nulls(len(i), pa.int64()) for _ in range(3))], names=names)
        if good.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(int(good.sum()), pa.int64()) for _ in range(3)), pa.array(h[good]), pa.array(c[good]), pa.array(n[good])], names=names)

    def run(batches):
        held: list[pa.Table] = []
        size, last = 0, None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
            bounds = batch.column(4).buffers()[1]
            ends = np.frombuffer(bounds, np.int32)[batch.column(4).offset :] if len(keys) else None
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if size >= ARRAY_BYTES and keys[x] != last:
                    yield from out(held)
                    held, size = [], 0
                held.append(pa.Table.from_batches([batch.slice(x, y - x)]))
                size += int(ends[y] - ends[x])
                last = keys[x]
        if held:
            yield from out(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, ", ".join(f"{k} long" for k in names))


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def repeated_ranges(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ranges array<struct<a, z>>) of the documents that repeated strings cover in part."""
    dealt = common_anchors(df, key, text)
    wanted = stored(shared_anchors(anchor_rows(df, key, text), dealt), "suffix-anchors")
    wanted = whole_heads(wanted) if dealt else wanted
    found = stored(marks(contexts(df, asked_for(wanted), key, text)), "suffix-marks")
    twice = wanted.where((F.col("kind") == PAIR) & (F.col("id") == F.col("id2")) & (F.col("place") == F.col("place2")))  # rows that repeat a key and its text
    classes = found.where("h is not null").select("h", "c", "n").union(twice.select("h", "c", "n")).select(F.struct("h", "c").alias("class"), "n").dropDuplicates(["class"])
    members = hot_join(wanted.where(F.col("kind") == MEMBER).select("id", "place", F.struct("h", "c").alias("class")), classes, "class", "id", "n").where("n is not null")
    whole = members.select("id", F.greatest(F.lit(0).cast("long"), F.col("place") - (WINDOW - 1)).alias("a"), (F.col("place") + SPAN).alias("z"))
    return found.where("h is null").select("id", "a", "z").union(whole).groupBy("id").agg(F.collect_list(F.struct("a", "z")).alias("ranges"))


def cleaned(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary's SHA-256) of every row."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    rows = rows.join(repeated_ranges(df, key, text), "id", "left").select("id", "t", "ranges")

    def run(batches):
        for part in slices(batches):
            sizes, removed, spans, shas = [], [], [], []
            for t, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                data = (t or "").encode("utf-8", "surrogatepass")
                at, kept = 0, hashlib.sha256()
                gone = united([(r["a"], min(r["z"], len(data))) for r in ranges or ()])
                for a, z in gone:
                    kept.update(data[at:a])
                    at = z
                kept.update(data[at:])
                sizes.append(len(data))
                removed.append(sum(z - a for a, z in gone))
                spans.append(len(gone))
                shas.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(shas, pa.string())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes removed from all documents."""
    return cleaned(table(spark, sf_dir, "documents"))
