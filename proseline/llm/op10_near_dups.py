"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

1. Every text becomes its set of hashed word shingles and a signature of
   SYMBOLS minima, SYMBOL_BITS bits each. Texts with equal sets are one class.
2. Two classes at the Jaccard threshold differ in more than `errors` symbols
   with a probability under MISS. The signature is cut into so few chunks
   that, by the pigeonhole principle, one chunk of such a pair has one error
   at most; each chunk is therefore filed once for each symbol masked out.
   Every pair within `errors` symbols shares a filed key.
3. Classes that share a key are compared by signature and size inside sorted
   runs; what comes out is a spanning set of edges, never all pairs.
4. Each group that these edges connect gets its full sets, and the links are
   those with enough common shingles. The components of the confirmed links
   are the result.

A large group, of a key in step 3 or of texts in step 4, is cut into blocks,
each compared together with a few leaders of the group; then whatever isn't in
the group's largest component is compared with all of the group, block by
block. So a member goes to one block, but for those outside, and no link
between components is missed.

Defined results: null texts and texts without a word have no shingle and link
with nothing; texts with fewer words than a shingle are one shingle. Equal
texts always link. A row without a key counts as a copy of rows with its text
and has their component; alone it links with nothing, has no component and is
kept. Texts under one key are one document: a link of any is a link of the
key. Column names of the input other than the key and the text play no part.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proseline.llm.common import connected_components, hot_join, map_texts, slices, stored, table

SYMBOLS, SYMBOL_BITS = 64, 16
#: Chance that a pair right at the threshold has more symbol errors than the search allows.
MISS = 1e-5
#: Members of a group that one task compares at once; larger groups are compared block by block. Leaders of such a group.
BLOCK, LEADERS = 3000, 32
#: Classes that share a key and that one task compares at once by their signatures.
KEY_BLOCK = 20_000
REMEMBERED = 300_000

_LOWER = bytes(range(256)).lower()
_RANDOM = np.random.default_rng(20240607)
_A = (_RANDOM.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64) | 1).astype(np.uint32)
_B = _RANDOM.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Distinct hashes of a text's runs of `width` words, sorted."""

    def __init__(self, width: int):
        self.width, self.words = width, Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
        if len(self.words) > REMEMBERED:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.width + 1
        total = np.zeros(n, np.uint64)
        for k in range(self.width):
            total += finish(h[k : k + n] * _MIX[k % len(_MIX)] + np.uint64(k))
        return np.unique(finish(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        h = x[at : at + 1024, None] * _A + _B
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(least, h.min(axis=0), out=least)
    return (least & np.uint32((1 << SYMBOL_BITS) - 1)).astype(np.uint16)


def allowed_errors(threshold: float) -> int:
    """The fewest errors that a pair at the threshold exceeds with a chance under MISS."""
    p, tail = 1 - threshold, 1.0
    for k in range(SYMBOLS):
        tail -= math.comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k)
        if tail < MISS:
            return k
    return SYMBOLS - 1


def chunks(errors: int) -> list[tuple[int, int]]:
    """Chunks of the signature, so many that one has one error at most if all together have `errors`."""
    n = errors // 2 + 1
    cuts = [SYMBOLS * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def filed_keys(signatures: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """Keys of each signature: for each chunk, one for each symbol left out."""
    s = finish(signatures.astype(np.uint64) + (np.arange(SYMBOLS, dtype=np.uint64) << np.uint64(20)))
    keys, places = np.empty((len(s), SYMBOLS), np.uint64), np.arange(SYMBOLS, dtype=np.uint64) * _MIX[1]
    for a, b in parts:
        whole = s[:, a:b].sum(axis=1, dtype=np.uint64)
        for k in range(a, b):
            keys[:, k] = finish(whole - s[:, k] + places[k])
    return keys.view(np.int64)


def features(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    def make():
        shingles = Shingles(width)

        def work(texts):
            sets = [shingles(t) for t in texts]
            return {
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "signature": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            }

        return work

    return map_texts(df, [key, text], make, f"{key} long, n_shingles long, digest binary, signature binary")


def shared_keys(classes: DataFrame, errors: int) -> DataFrame:
    """(k, id) of every filed key that more than one class has."""
    parts = chunks(errors)

    def file(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(filed_keys(sigs, parts).ravel()), pa.array(ids)], names=["k", "id"])

    def runs(batches):
        held_k, held_id = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(k, i):
            same = k[1:] == k[:-1]
            keep = np.zeros(len(k), bool)
            keep[1:] |= same
            keep[:-1] |= same
            return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(i[keep])], names=["k", "id"])

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            i = np.concatenate([held_id, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last run may go on
            if len(k) - cut > 4096:  # a long run: two of its rows stay, so that what follows isn't alone
                yield out(k, i)
                held_k, held_id = k[-2:], i[-2:]
                continue
            if cut:
                yield out(k[:cut], i[:cut])
            held_k, held_id = k[cut:], i[cut:]
        if len(held_k):
            yield out(held_k, held_id)

    filed = classes.select("id", "signature").mapInArrow(file, "k long, id long")
    return filed.repartition("k").sortWithinPartitions("k").mapInArrow(runs, "k long, id long")


def within(sigs: np.ndarray, sizes: np.ndarray, i: int, errors: int, share: float) -> np.ndarray:
    """Which rows may link with row i: few signature errors, and sizes that allow the share."""
    near = np.minimum(sizes, sizes[i]) >= share * np.maximum(sizes, sizes[i]) - 1e-9
    spots = np.nonzero(near)[0]
    near[spots] = np.count_nonzero(sigs[spots] != sigs[i], axis=1) <= errors
    return near


def spanning(n: int, linked) -> np.ndarray:
    """Labels of the components of n rows; linked(i) gives the rows that row i links with.

    Rows of the component that row 0 has after its own turn need no turn
    unless a later row joins another one; only rows outside the largest
    component are asked, against all rows, which covers every pair across.
    """
    labels = np.arange(n)
    done = np.zeros(n, bool)

    def ask(i):
        done[i] = True
        found = np.unique(labels[linked(i)])
        if len(found) > 1:
            labels[np.isin(labels, found)] = found[0]

    ask(0)
    for _ in range(8):  # a few more leaders first: the rows furthest from what is joined already
        rest = np.nonzero(~done & (labels != labels[0]))[0]
        if not len(rest):
            break
        ask(rest[0])
    largest = np.bincount(labels, minlength=n).argmax()
    for i in range(n):
        if not done[i] and labels[i] != labels[largest]:
            ask(i)
    return labels


def sorted_runs(batches, column: int = 0):
    """Rows of each run of equal values, as lists of columns, from batches sorted by that column."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = batch.column(column).to_numpy(zero_copy_only=False)
        if not len(values):
            continue
        cuts = [0, *(np.nonzero(values[1:] != values[:-1])[0] + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and values[a] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def edge_batches(pairs):
    """Arrow batches (a, b) of an iterator of arrays (a, b)."""
    a, b, n = [], [], 0
    for x, y in pairs:
        a.append(x)
        b.append(y)
        n += len(x)
        if n > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            a, b, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def signature_links(units: DataFrame, classes: DataFrame, errors: int, share: float) -> DataFrame:
    """Spanning edges (a, b) of the pairs inside each unit of units(u, id) that are within `errors` symbols."""

    def run(batches):
        def pairs():
            for rows in sorted_runs(batches):
                ids = rows.column("id").to_numpy()
                sizes = rows.column("n_shingles").to_numpy()
                sigs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                if len(ids) == 2:
                    if within(sigs, sizes, 0, errors, share)[1]:
                        yield ids[:1], ids[1:]
                    continue
                labels = spanning(len(ids), lambda i: within(sigs, sizes, i, errors, share))  # noqa: B023
                other = np.nonzero(labels != np.arange(len(ids)))[0]
                if len(other):
                    yield ids[labels[other]], ids[other]

        yield from edge_batches(pairs())

    rows = units.join(classes, "id").select("u", "id", "n_shingles", "signature")
    return rows.repartition("u").sortWithinPartitions("u").mapInArrow(run, "a long, b long")


def coarse_edges(keys: DataFrame, classes: DataFrame, errors: int, share: float) -> DataFrame:
    """Spanning edges of the pairs that share a key and are within `errors` symbols. Groups of a key above KEY_BLOCK are cut into blocks."""
    link = lambda units: signature_links(units, classes, errors, share)
    sizes = keys.groupBy(F.col("k").alias("g")).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > KEY_BLOCK)
    if sizes.isEmpty():
        return link(keys.select(F.col("k").alias("u"), "id"))
    rows = in_blocks(hot_join(keys.select(F.col("k").alias("g"), "id"), sizes, "g", "id", "members"), KEY_BLOCK)
    return link(rows.where("blocks is null").select(F.col("g").alias("u"), "id")).union(large_group_links(stored(rows.where("blocks is not null"), "near-large-keys"), link))


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows(g, id, members) with the number of blocks of the group, and the block of the row."""
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / F.lit(size)).cast("int"))
    return rows.select("g", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("block"))


def confirm(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the pairs with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    df = np.bincount(codes)
    starts = np.concatenate([[0], np.cumsum(df)])
    posting = owner[np.argsort(codes, kind="stable")].astype(np.int32)
    at = np.concatenate([[0], np.cumsum(sizes)])

    def linked(i):
        own = codes[at[i] : at[i + 1]]
        own = own[df[own] > 1]
        common = np.zeros(len(sets), np.int64)
        for k in range(0, len(own), 4096):
            part = own[k : k + 4096]
            common += np.bincount(np.concatenate([posting[starts[c] : starts[c + 1]] for c in part.tolist()]) if len(part) else np.zeros(0, np.int64), minlength=len(sets))
        common[i] = sizes[i]
        return 100 * common >= percent * (sizes + sizes[i] - common)

    labels = spanning(len(sets), linked)
    other = np.nonzero(labels != np.arange(len(sets)))[0]
    return ids[labels[other]], ids[other]


def confirmed(units: DataFrame, percent: int) -> DataFrame:
    """Spanning edges (a, b) of the links inside each unit of units(u, id, shingles)."""

    def run(batches):
        def pairs():
            for rows in sorted_runs(batches):
                if rows.num_rows > 1:
                    yield confirm(rows.column("id").to_numpy(), [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()], percent)

        yield from edge_batches(pairs())

    return units.select("u", "id", "shingles").repartition("u").sortWithinPartitions("u").mapInArrow(run, "a long, b long")


def large_group_links(ids: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges that connect what the links inside each group connect; ids(g, id, blocks, block), link(units(u, id)) gives edges of each unit."""
    # leaders: the first of each block by a hash, of these the first ones of the group
    first = ids.groupBy("g", "block").agg(F.min(F.struct(F.xxhash64("id", F.lit(5)).alias("h"), "id")).alias("x"), F.first("blocks").alias("blocks"))
    leaders = first.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("x"))).where(F.col("place") <= LEADERS)
    led = leaders.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("`to` <> block")
    near = stored(link(ids.select(F.xxhash64("g", "block").alias("u"), "id").union(led.select(F.xxhash64("g", "to"), "x.id"))), "near-blocks")
    # what isn't in a group's largest component is compared with all of the group
    found = connected_components(near, "near-led")
    labels = hot_join(ids, found, "id", "g").select("g", "id", "blocks", "block", F.coalesce("component_id", "id").alias("label"))
    labels = stored(labels, "near-labels")
    sizes = labels.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("members"))
    rest = stored(hot_join(labels, main, "g", "id", "members").where("label <> main").select("g", "id", "blocks", "block"), "near-rest")
    outside = rest.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("rests"))
    counts = outside.join(main, "g").select("g", "rests", "members")
    here = hot_join(ids, counts, "g", "id", "members").where("rests is not null").withColumn("rest", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    there = hot_join(rest, counts, "g", "id", "members").withColumn("rest", F.pmod(F.xxhash64("id", F.lit(11)), F.col("rests").cast("long")).cast("int"))
    there = there.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("`to` <> block")
    return near.union(link(here.select(F.xxhash64("g", "block", "rest").alias("u"), "id").union(there.select(F.xxhash64("g", "to", "rest"), "id"))))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of every row; links are Jaccard similarities of percent / 100 or more."""
    share = percent / 100
    errors = allowed_errors(share)
    rows = stored(features(df.select(F.col(key).cast("long").alias(key), text), key, text, width), "near-features")
    classes = rows.where(F.col("digest").isNotNull() & F.col(key).isNotNull()).groupBy("digest").agg(F.min(key).alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = stored(classes, "near-classes")
    keys = stored(shared_keys(classes, errors), "near-keys")
    coarse = connected_components(coarse_edges(keys, classes.select("id", "n_shingles", "signature"), errors, share), "near-coarse").select("id", F.col("component_id").alias("g"))
    groups = stored(coarse, "near-groups")
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("members"))
    members = in_blocks(hot_join(groups.select("g", "id"), sizes, "g", "id", "members"), BLOCK)
    # a sorted join at every size: a group's ids may be many, so they are never broadcast
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).join(members.hint("merge"), "id").select("id", "t", "g", "blocks", "block")

    def sets_of(batches):
        shingles = Shingles(width)
        for part in slices(batches):
            sets = pa.array([shingles(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), sets, *part.columns[2:]], names=["id", "shingles", "g", "blocks", "block"])

    full = texts.mapInArrow(sets_of, "id long, shingles binary, g long, blocks int, block int").dropDuplicates(["id", "shingles"])
    links = confirmed(full.where("blocks = 1").select(F.xxhash64("g").alias("u"), "id", "shingles"), percent)
    if not sizes.where(F.col("members") > BLOCK).isEmpty():
        sets = stored(full.where("blocks > 1"), "near-sets")
        links = links.union(large_group_links(sets.select("g", "id", "blocks", "block").distinct(), lambda units: confirmed(units.join(sets.select("id", "shingles"), "id"), percent)))
    found = connected_components(links, "near-links")
    of_class = classes.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    return hot_join(rows.select(key, "n_shingles", "digest"), of_class, "digest", key).select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents: three-word shingles, similarity 0.85."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
