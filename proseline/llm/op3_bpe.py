"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1 is a minimal perfect hash over the byte strings of the vocabulary: a
pre-token that is in it costs one hash, one displacement and one comparison.
Tier 2 takes the misses: their bytes form a doubly linked list, a heap holds
the mergeable neighbours by (rank, place), and the lowest pair is joined until
none is left; which ids join to which is a table made from the vocabulary. A
worker keeps the results of recent pre-tokens in a table of bounded size. Ids go
from it into Arrow as packed 32-bit numbers; digests are taken over names and
bytes that Arrow gathers by id, so that no id of a text is a Python object.

Null text counts as empty: no tokens. Texts of any length are encoded whole.
Repeated rows give repeated results. Invalid ids raise KeyError on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import slices, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: one base64 byte string and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def mixed(x: int) -> int:
    """Mix 64 bits, so that successive displacements give unrelated slots."""
    x &= 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 32


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys, n slots, one displacement per bucket.

    Buckets go from the fullest to the emptiest; a bucket's displacement is
    the first that sends its keys to free slots. Buckets with one key take
    the slots that are left and store them as negative numbers.
    """

    def __init__(self, keys: Iterable[bytes]):
        keys = list(keys)
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        self.shift = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * n
        for bucket, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                continue
            d = 1
            while True:
                spots = {self.spread(h, d) for h, _ in members}
                if len(spots) == len(members) and all(self.slots[s] is None for s in spots):
                    break
                d += 1
            self.shift[bucket] = d
            for h, key in members:
                self.slots[self.spread(h, d)] = key
        free = iter([i for i, s in enumerate(self.slots) if s is None])
        for bucket, members in groups.items():
            if len(members) == 1:
                spot = next(free)
                self.shift[bucket] = -spot - 1
                self.slots[spot] = members[0][1]

    def spread(self, h: int, d: int) -> int:
        return mixed(h + d * 0x9E3779B97F4A7C15) % self.n

    def find(self, key: bytes) -> int:
        """The slot of key, or -1 if it isn't one of the keys."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        spot = -d - 1 if d < 0 else mixed(h + d * 0x9E3779B97F4A7C15) % self.n
        return spot if self.slots[spot] == key else -1


class Codec:
    """Encodes texts to ids and ids to bytes, as the ranks and the splitting pattern say."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.hash = PerfectHash(ranks)
        self.rank_of_slot = [ranks.get(key, -1) for key in self.hash.slots]
        self.bytes_of_id = {rank: key for key, rank in ranks.items()}
        #: Ids of neighbours, packed in one number, to the id of what they join to.
        self.joined = {ranks[key[:i]] << 20 | ranks[key[i:]]: rank for key, rank in ranks.items() for i in range(1, len(key)) if key[:i] in ranks and key[i:] in ranks}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memory", "arrays")}

    def rank(self, piece: bytes) -> int:
        slot = self.hash.find(piece)
        return -1 if slot < 0 else self.rank_of_slot[slot]

    def merge(self, piece: bytes) -> list[int]:
        """Tier 2: join the lowest-ranked neighbours, leftmost first, through a heap over linked bytes.

        A part is known by its first byte's index; ids, after and before hold
        its id and its neighbours. A heap entry is rank and index in one
        number, out of date unless the pair that starts there has that rank.
        """
        n, joined = len(piece), self.joined
        ids = list(map(self.byte_id.__getitem__, piece))
        pair = [joined.get(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]  # noqa: B905
        pair.append(-1)
        bits = n.bit_length()  # of an index, so that entries of short pieces stay small numbers
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        if not heap:
            return ids
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, get, low = heapq.heappop, heapq.heappush, joined.get, (1 << bits) - 1
        while heap:
            entry = pop(heap)
            i, r = entry & low, entry >> bits
            if pair[i] != r:
                continue
            j = after[i]
            after[i] = k = after[j]
            ids[i], pair[j], ids[j] = r, -1, -1
            if k < n:
                before[k] = i
                pair[i] = new = get(r << 20 | ids[k], -1)
                if new >= 0:
                    push(heap, new << bits | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                pair[h] = new = get(ids[h] << 20 | r, -1)
                if new >= 0:
                    push(heap, new << bits | h)
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: bytes) -> list[int]:
        r = self.rank(piece)
        return [r] if r >= 0 else self.merge(piece)

    def packed(self, text: str | None) -> bytes:
        """The ids as 32-bit numbers in a row."""
        if not text:
            return b""
        memory = self.__dict__.setdefault("memory", Memory(self))
        split = self.__dict__.get("split")
        if split is None:
            split = self.split = regex.compile(self.pattern)
        out = b"".join(map(memory.__getitem__, split.findall(text)))
        if len(memory) > REMEMBERED:
            memory.clear()
        return out

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of_id.__getitem__, ids))


    def gathered(self) -> tuple[pa.LargeBinaryArray, pa.LargeBinaryArray]:
        """By id: its decimal name and a comma, and its bytes; null for numbers that are no id."""
        if "arrays" not in self.__dict__:
            every = range(max(self.bytes_of_id) + 1)
            self.arrays = tuple(pa.array(x, pa.large_binary()) for x in ([b"%d," % i if i in self.bytes_of_id else None for i in every], list(map(self.bytes_of_id.get, every))))
        return self.arrays


class Memory(dict):
    """Packed ids of pre-tokens seen before; a missing one is encoded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.codec.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of a rank file; by default that of the public multilingual vocabulary."""
    import public_tokenizers

    return Codec(load_ranks(path or public_tokenizers.path(VOCABULARY)), pattern or public_tokenizers.PATTERN)


def id_column(coder: Codec, texts: pa.Array) -> pa.ListArray:
    """The ids of a column of texts."""
    packed = [coder.packed(t) for t in texts.to_pylist()]
    offsets = np.zeros(len(packed) + 1, dtype=np.int64)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets).cast(pa.int32()), values)


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", coder: Codec | None = None) -> DataFrame:
    """(key, token_ids array<int>) of every row. The codec's tables have the vocabulary's size and go to each worker once."""
    shared = df.sparkSession.sparkContext.broadcast(coder or codec())

    def run(batches):
        own = shared.value
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), id_column(own, part.column(1))], names=[key, "token_ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, token_ids array<int>")


def id_lists(column: pa.Array) -> Iterable[list[int]]:
    """The lists of an id column, none for null."""
    for row in column:
        yield row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else []


def decode_documents(df: DataFrame, key: str = "doc_id", ids: str = "token_ids", coder: Codec | None = None) -> DataFrame:
    """(key, decoded binary) of every row of ids; null ids decode to no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(coder or codec())

    def run(batches):
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.decode(x) for x in id_lists(part.column(1))], pa.binary())], names=[key, "decoded"])

    return df.select(key, ids).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, decoded binary")


def gather(values: pa.LargeBinaryArray, ids: pa.Array, ends: list[int]) -> list[memoryview]:
    """The values of the ids between one end and the next, concatenated."""
    if not len(ids):
        return [memoryview(b"")] * (len(ends) - 1)
    found = values.take(ids)
    if found.null_count:
        raise KeyError("ids outside the vocabulary")
    _, offsets, data = found.buffers()
    at = np.frombuffer(offsets, np.int64)[ends].tolist()
    return [memoryview(data)[a:b] for a, b in zip(at, at[1:])]  # noqa: B905


def digests(coder: Codec, column: pa.ListArray) -> tuple[list[int], list[str], list[str]]:
    """Count, SHA-256 of the comma-joined ids and SHA-256 of their bytes, per row of ids."""
    names, tokens = coder.gathered()
    counts = [c or 0 for c in column.value_lengths().to_pylist()]
    ids = column.flatten()  # without what null rows hide
    if ids.null_count or len(ids) and not 0 <= pc.min(ids).as_py() <= pc.max(ids).as_py() < len(names):
        raise KeyError("ids outside the vocabulary")
    ends = np.cumsum([0, *counts]).tolist()
    joined = [hashlib.sha256(x[:-1]).hexdigest() for x in gather(names, ids, ends)]
    return counts, joined, [hashlib.sha256(x).hexdigest() for x in gather(tokens, ids, ends)]


def digest_documents(df: DataFrame, key: str = "doc_id", ids: str = "token_ids", coder: Codec | None = None) -> DataFrame:
    """Count, SHA-256 of the comma-joined ids and SHA-256 of the bytes that they decode to, per row of ids."""
    shared = df.sparkSession.sparkContext.broadcast(coder or codec())

    def run(batches):
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, shas, decoded = digests(own, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, ids).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids again, and give the digests of both."""
    coder = codec()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return digest_documents(encode_documents(docs, coder=coder), coder=coder)


def with_tokens(docs: DataFrame, text: str = "text", coder: Codec | None = None) -> DataFrame:
    """docs with token_ids array<int> and n_tokens long; columns of these names give way."""
    docs = docs.select([c for c in docs.columns if c.lower() not in ("token_ids", "n_tokens")])
    names, field = docs.columns, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(coder or codec())

    def run(batches):
        own = shared.value
        for part in slices(batches, field):
            ids = id_column(own, part.column(field))
            yield pa.RecordBatch.from_arrays([*part.columns, ids, ids.value_lengths().cast(pa.int64())], names=[*names, "token_ids", "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, token_ids array<int>, n_tokens long")
