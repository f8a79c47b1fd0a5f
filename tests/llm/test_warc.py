import gzip
import hashlib
import zlib

from pyspark.sql import functions as F

from prosegauge.llm import warc

PAGES = "page_id long, url string, html string"


def stored_and_read(spark, tmp_path, rows, **options):
    path = f"file://{tmp_path}/archives"
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit("clash")).withColumn("first_id", F.lit(9))
    warc.write_archives(pages, path, **options)
    found = warc.resolve_revisits(warc.read_archives(spark, path))
    return path, {(r.page_id, r.payload_digest): r for r in found.collect()}


def test_equal_payloads_are_stored_once(spark, tmp_path):
    long, other = "ä" * 60, "WARC/1.1\r\n\r\n" * 20
    rows = [(3, "http://a/\r\nx", long), (1, None, long), (2, "u", other), (None, "u", long), (5, "u", "short"), (6, "u", "short"), (7, "u", None)]
    path, found = stored_and_read(spark, tmp_path, rows, archive_bytes=200)
    digest = {t: hashlib.sha256((t or "").encode()).hexdigest() for t in (long, other, "short", None)}
    assert len(found) == 7
    for page, text in ((3, long), (None, long)):
        row = found[page, digest[text]]
        assert (row.record_type, row.refers_to, row.payload_bytes) == ("revisit", 1, 120)
    for page, text in ((1, long), (2, other), (5, "short"), (6, "short"), (7, None)):
        row = found[page, digest[text]]
        assert (row.record_type, row.refers_to) == ("response", None)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "archives").glob("*.gz"))
    assert whole.count(long.encode()) == 1
    assert found[3, digest[long]].url == "http://a/%0D%0Ax"


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    same = [(1, "u", "x" * 200)] * 3 + [(2, "u", "x" * 200)] * 2
    warc.write_archives(spark.createDataFrame(same, PAGES), path)
    kinds = [(r.page_id, r.record_type, r.refers_to) for r in warc.resolve_revisits(warc.read_archives(spark, path)).collect()]
    assert sorted(kinds, key=str) == [(1, "response", None)] * 3 + [(2, "revisit", 1)] * 2
    warc.write_archives(spark.createDataFrame([], PAGES), f"{path}-none")
    assert warc.read_archives(spark, f"{path}-none").count() == 0


def members(content):
    """What each gzip member of an archive holds, one by one."""
    while content:
        one = zlib.decompressobj(zlib.MAX_WBITS | 16)
        yield one.decompress(content) + one.flush()
        content = one.unused_data


def test_every_record_is_a_member_of_its_own(spark, tmp_path):
    big = "<p>word</p>" * 1_600_000  # 17.6 MB, whose size ends in another byte
    rows = [(i, f"http://a/{i}", f"page {i} " * 40) for i in range(30)] + [(30, None, "x" * 300), (31, "http://big/", big)]
    path, found = stored_and_read(spark, tmp_path, rows, archive_bytes=5_000_000)
    archives = sorted((tmp_path / "archives").glob("*.warc.gz"))
    assert archives and not list((tmp_path / "archives").glob("part-*.txt"))
    seen = []
    for archive in archives:
        parts = list(members(archive.read_bytes()))
        assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)
        assert b"WARC-Type: warcinfo" in parts[0]
        assert sum(p.count(b"WARC-Record-ID: ") for p in parts) == len(parts)
        assert all(b"\r\nWARC-Target-URI: " in p for p in parts[1:])
        seen += parts[1:]
    assert len(seen) == 32 == len(found)
    assert {r.page_id: r.url for r in found.values()} == {i: u for i, u, _ in rows}
    assert {r.page_id: r.payload_bytes for r in found.values()} == {i: len(t) for i, _, t in rows}
