"""WARC archives: writing, reading, and revisit resolution.

Archives are written by Spark's own file writer, record by record as text
with the record separator as its line end, gzipped, a bounded number of
records per file, and few of those with a large payload: they go to any store
that Spark writes to, are committed whole, and survive lost executors. A file
is read as a whole and unpacked record by record.

Resolution shuffles headers alone by payload digest, takes the smallest
page_id of each as the original, joins the others to it, and writes new
archives in which those are revisit records with fresh headers.

Defined results: null html is an empty payload. Payloads under `least` bytes
are never revisits. A null page_id sorts last. Rows that repeat page_id and
payload are one response and revisits that refer to its page_id. A null url
becomes urn:page:<page_id>; white space and control characters in one are
escaped. Empty tables give no records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import hot_join, remove, shared_path, stored, table

#: Bytes under which equal payloads stay responses.
LEAST_BYTES = 100
#: Records of a file; bytes from which a payload is large, and records of a file of large ones. No file gets near the 2 GB of a row.
FILE_RECORDS, LARGE_BYTES, FILE_LARGE_RECORDS = 1000, 1 << 20, 8
#: Bytes that are unpacked at once.
CHUNK = 1 << 20
#: Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HEADS = "record_id string, page_id long, uri string, date string, record_type string, refers_to_record string, payload_bytes long, payload_digest string"


def urn(seed: Column) -> Column:
    h = F.md5(seed.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-" if a > 1 else ""), F.substring(h, a, n))], F.lit(">"))


def line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n"))


def record(df: DataFrame) -> Column:
    """The whole record, but for its end, from the columns of HEADS, payload, and the refers_to_ columns."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes")), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    to = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("refers_to_record")), line("WARC-Refers-To-Target-URI", F.col("refers_to_uri")), line("WARC-Refers-To-Date", F.col("refers_to_date")))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("uri")),
        F.when(revisit, to).otherwise(F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), line("X-Page-Id", F.col("page_id")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), line("Content-Length", F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("payload"))), F.lit("\r\n"), block,
    )


def write_records(df: DataFrame, path: str, largest: int, level: str = "DEFAULT_COMPRESSION") -> None:
    """Archives of the records in df; `largest` is the size of the largest payload. Large ones are written by a job of their own, if there are any."""

    def write(rows: DataFrame, most: int, folder: str) -> None:
        rows.select(record(df).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", level).option("maxRecordsPerFile", most).text(f"{path}/{folder}")

    if largest < LARGE_BYTES:
        write(df, FILE_RECORDS, "records")
    else:
        write(df.where(F.col("payload_bytes") < LARGE_BYTES), FILE_RECORDS, "records")
        write(df.where(F.col("payload_bytes") >= LARGE_BYTES), FILE_LARGE_RECORDS, "large")


def write_pages(pages: DataFrame, path: str, level: str = "BEST_SPEED") -> None:
    """A response record for every row of pages(page_id, url, html); packed quickly, as it is to be written again."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")).withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    none = F.lit(None).cast("string")
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f-\xa0  ]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = rows.select(
        "page_id", "payload", "payload_digest", uri.alias("uri"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.lit(DATE).alias("date"), F.lit("response").alias("record_type"),
        urn(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("payload_digest"), F.monotonically_increasing_id().cast("string"))).alias("record_id"),
        none.alias("refers_to_record"), none.alias("refers_to_uri"), none.alias("refers_to_date"),
    )
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    write_records(rows, path, largest, level)


def unzipped(data: bytes) -> Iterator[bytes]:
    """Content of a file, piece by piece: plain, or gzip of one or many members."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + CHUNK] for at in range(0, len(data), CHUNK))
        return
    while data:
        member = zlib.decompressobj(31)
        piece = member.decompress(data, CHUNK)
        while piece or not member.eof:
            yield piece
            if member.eof:
                break
            rest = member.unconsumed_tail
            piece = member.decompress(rest, CHUNK)
            if not piece and not rest:
                raise ValueError("archive ends inside a gzip member")
        data = member.unused_data


def parsed(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, names in lower case, and block of each record; holds one record and one piece."""
    pieces = iter(pieces)
    data, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del data[:at]
        at = 0
        data.extend(piece)
        return True

    while True:
        while (end := data.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if bytes(data[at:]).strip():
                    raise ValueError("archive ends inside a record")
                return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, at = int(fields["content-length"]), end + 4
        while len(data) - at < size + 4:
            if not more():
                raise ValueError("archive ends inside a record")
        yield fields, bytes(data[at : at + size])
        at += size + 4


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the archives in path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.col("path").alias("file"), "content")


def records(files: DataFrame, payload: bool) -> DataFrame:
    """HEADS of every record of files(file, content), its place in its file, and the payload if asked for.

    Bytes and digest of a response are those of its payload as read; those of
    a revisit, which has none, are what its headers say. A third column of
    files lists the originals of records by place: these records come without
    their payload, and with their original.
    """
    named = len(files.columns) > 2

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file, rows, size = batch.column(0)[i].as_py(), [], 0
                originals = {x["place"]: x["original"] for x in batch.column(2)[i].as_py() or ()} if named else {}
                for place, (fields, raw) in enumerate(parsed(unzipped(batch.column(1)[i].as_py()))):
                    head, _, body = raw.partition(b"\r\n\r\n")
                    if fields["warc-type"] == "revisit":
                        n = int(next(x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    else:
                        n, digest = len(body), hashlib.sha256(body).hexdigest()
                    page, original = fields.get("x-page-id"), originals.get(place)
                    row = (fields["warc-record-id"], int(page) if page else None, fields.get("warc-target-uri"), fields.get("warc-date"), fields["warc-type"], fields.get("warc-refers-to"), n, digest, file, place)
                    rows.append((*row, original, b"" if original else body) if payload else row)
                    size += len(raw) if payload else 500
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    string, long = pa.string(), pa.int64()
    kinds = {"record_id": string, "page_id": long, "uri": string, "date": string, "record_type": string, "refers_to_record": string, "payload_bytes": long, "payload_digest": string, "file": string, "place": long}
    kinds |= {"original": pa.struct([("record_id", string), ("uri", string), ("date", string)]), "payload": pa.binary()} if payload else {}

    def batch_of(rows):
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
        return pa.RecordBatch.from_arrays([x.cast(string) if pa.types.is_binary(x.type) else x for x in arrays], names=list(kinds))

    return files.mapInArrow(run, HEADS + ", file string, place long" + (", original struct<record_id:string,uri:string,date:string>, payload string" if payload else ""))


def resolve(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The records that become revisits: (record_id, file, place, original) of those whose payload an earlier page has too."""
    full = heads.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least))
    original = full.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "uri", "date")).alias("original")).where("n > 1")
    found = hot_join(full.select("record_id", "payload_digest", "file", "place"), original, "payload_digest", "record_id", "n").where("record_id <> original.record_id")
    return found.select("record_id", "file", "place", "original")


def dedupe_archives(spark: SparkSession, source: str, target: str, least: int = LEAST_BYTES) -> None:
    """Write the records of the archives in source to new ones in target, repeated payloads as revisits.

    Originals are joined to packed files, of each of which they are a list of
    bounded length, so no payload is shuffled.
    """
    heads = stored(records(archive_files(spark, source), False), "warc-heads")
    original = F.struct(*(F.col(f"original.{c}").alias(c) for c in ("record_id", "uri", "date")))
    lists = resolve(heads, least).groupBy("file").agg(F.collect_list(F.struct("place", original.alias("original"))).alias("originals"))
    rows = records(archive_files(spark, source).join(lists.hint("merge"), "file", "left").select("file", "content", "originals"), True)
    turned = F.col("original").isNotNull()
    rows = rows.select(
        urn(F.concat(F.col("record_id"), F.lit("|deduplicated"))).alias("record_id"), "page_id", "uri", "date", "payload_bytes", "payload_digest", "payload",
        F.when(turned, F.lit("revisit")).otherwise(F.col("record_type")).alias("record_type"),
        F.when(turned, urn(F.concat(F.col("original.record_id"), F.lit("|deduplicated")))).otherwise(F.col("refers_to_record")).alias("refers_to_record"), F.col("original.uri").alias("refers_to_uri"), F.col("original.date").alias("refers_to_date"),
    )
    largest = heads.agg(F.max("payload_bytes")).first()[0] or 0
    write_records(rows, target, largest)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, resolve revisits, and read the new archives back."""
    first, second = shared_path(spark, "warc"), shared_path(spark, "warc-deduplicated")
    write_pages(table(spark, sf_dir, "pages"), first)
    dedupe_archives(spark, first, second)
    remove(spark, first)
    heads = stored(records(archive_files(spark, second), False), "warc-read")
    remove(spark, second)
    responses = heads.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = hot_join(heads.where("record_type = 'revisit'"), responses, "refers_to_record", "record_id").select(*columns)
    return heads.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).union(revisits)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
m AS (SELECT page_id, n, h, row_number() OVER w AS place, first_value(page_id) OVER w AS first_id FROM d WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND place > 1 THEN first_id END AS refers_to
FROM m
"""
