import glob
import gzip
import hashlib
import os

import duckdb
import pytest

from proseline.llm import op2_warc as op
from proseline.llm.common import shared_path

SF = "/root/testdata/sf0.01"
LONG = "<p>é🙂 " + "x" * 200 + "\r\n\r\nWARC/1.1\r\n"


def test_round_trip(spark, tmp_path):
    pages = [(5, "http://a/\r\nX: y", LONG), (3, None, LONG), (9, "http://c", LONG), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (9, "http://c", LONG), (None, "u", LONG), (7, "u", "y" * 500_000)]
    spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, op.op2_warc(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, _, html in pages:
        b = (html or "").encode()
        again = len(b) >= 100 and html == LONG and i != 3
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)


def test_files_are_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", LONG), (2, "http://b", LONG)], "page_id long, url string, html string")
    path, out = f"{tmp_path}/a", f"{tmp_path}/b"
    op.write_pages(df, path)
    op.dedupe_archives(spark, path, out)
    found = [r for f in glob.glob(f"{out}/*/part-*") for r in op.parsed(op.unzipped(open(f, "rb").read()))]
    assert sorted(f["warc-type"] for f, _ in found) == ["response", "revisit"]
    by = {f["warc-type"]: (f, bytes(b)) for f, b in found}
    assert by["revisit"][0]["warc-refers-to"] == by["response"][0]["warc-record-id"]
    assert by["response"][1].endswith(LONG.encode()) and not by["revisit"][1].endswith(LONG.encode())
    assert b"".join(op.unzipped(gzip.compress(b"a") + gzip.compress(b"") + gzip.compress(b"b" * 5_000_000))) == b"a" + b"b" * 5_000_000


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_records_across_pieces(monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK", chunk)
    blocks = [b"", b"a\r\n\r\nb", b"x" * 500, b"\r\n\r\n"]
    data = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(x), x) for x in blocks)
    for raw in (data, gzip.compress(data), gzip.compress(data[:60]) + gzip.compress(data[60:])):
        assert [x for _, x in op.parsed(op.unzipped(raw))] == blocks
    for raw in (data[:-30], gzip.compress(data)[:-20]):
        with pytest.raises(ValueError):
            list(op.parsed(op.unzipped(raw)))


def test_large_pages_have_files_of_their_own(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(op, "LARGE_BYTES", 300)
    pages = [(i, f"http://{i}", "z" * (100 + i * 30 % 500)) for i in range(40)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in op.op2_warc(spark, str(tmp_path)).collect()}
    first = {}
    for i, _, html in pages:
        first.setdefault(html, i)
    assert got == {i: (len(html), "response" if first[html] == i else "revisit") for i, _, html in pages}


def test_empty(spark):
    path = shared_path(spark, "t")
    op.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert op.records(op.archive_files(spark, path), True).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_as_the_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want = sorted(map(tuple, db.sql(op.ORACLE).fetchall()), key=str)
    assert sorted(map(tuple, op.op2_warc(spark, SF).collect()), key=str) == want
