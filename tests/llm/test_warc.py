import gzip
import hashlib
import io
import random

import pytest

from cumulus.llm import warc
from cumulus.llm.queries import op8_warc


def brute(rows):
    """Rows of the result, for pages without repeated rows."""
    first = {}
    for i, _, page in rows:
        data = (page or "").encode()
        if len(data) >= 100:
            key = (i is None, i or 0)
            first[data] = min(first.get(data, key), key)
    out = []
    for i, _, page in rows:
        data = (page or "").encode()
        revisit = len(data) >= 100 and first[data] != (i is None, i or 0)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
                    first[data][1] if revisit else None))
    return out


def key(r):
    return tuple((x is None, str(x)) for x in r)


def rows_of(out):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()), key=key)


PAGES = [(5, "http://a/1", "x" * 100), (3, "http://a/2", "x" * 100), (9, None, "x" * 100), (1, "http://a/\r\n é", "y" * 99),
         (2, "u", "y" * 99), (4, "", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 50), (8, "u", "é日" * 200_000),
         (None, "u", "x" * 100), (10, "u", "z" * 120)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")


def test_odd_pages(spark):
    assert rows_of(warc.round_trip(frame(spark, PAGES))) == sorted(brute(PAGES), key=key)


def test_rows_that_repeat_the_smallest_id_are_responses(spark):
    out = warc.round_trip(frame(spark, [(1, "u", "x" * 200)] * 4 + [(2, "u", "x" * 200)] * 2)).collect()
    assert sorted(r.record_type for r in out) == ["response"] * 4 + ["revisit"] * 2
    assert {r.refers_to for r in out if r.record_type == "revisit"} == {1}
    assert {r.payload_bytes for r in out} == {200}


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("split", [100, 777, 10_000, 1 << 20])
def test_ranges_own_every_record_once(spark, split, tmp_path):
    manifest = warc.write(frame(spark, PAGES).coalesce(1), str(tmp_path / "w"))
    out = warc.read(manifest, split_bytes=split).collect()
    assert len(out) == len(PAGES) and len({(r.file, r.offset) for r in out}) == len(PAGES)
    by = {r.page_id: r for r in out}
    assert bytes(by[8].payload).decode() == "é日" * 200_000
    assert by[5].payload is None and by[5].record_type == "revisit" and by[3].record_type == "response"
    assert by[5].refers_to_id == by[3].record_id and by[1].target_uri == "http://a/%0D%0A%20é"
    assert sum(r.records for r in manifest.collect()) == len(PAGES)


def test_plain_gzip_reads_the_archives(spark, tmp_path):
    files = [r.file for r in warc.write(frame(spark, PAGES), str(tmp_path / "w")).collect()]
    text = b"".join(gzip.open(f.removeprefix("file:")).read() for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES)


def test_false_magic_and_foreign_members_are_passed_over():
    record = warc.record("response", "<id>", "u", b"payload", "0", "t", [])
    data = b"\x1f\x8b\x08junk" + gzip.compress(b"no archive") + gzip.compress(record) + gzip.compress(b"other") + gzip.compress(record)
    found = list(warc.records_in(io.BytesIO(data), 0, len(data)))
    assert len(found) == 2 and all(b.endswith(b"payload") for _, _, b in found)
    cut = data[:-5]
    assert len(list(warc.records_in(io.BytesIO(cut), 0, len(cut)))) == 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert rows_of(op8_warc(spark, sf)) == sorted(brute(pages), key=key)


def test_first_record_with_a_long_url():
    draw = random.Random(3)
    for url in ("data:" + "".join(chr(draw.randint(33, 126)) for _ in range(1_500_000)), "http://a/" + "x" * 600_000):
        members = [gzip.compress(warc.record("response", f"<urn:uuid:{k}>", u, b"page", "00", "2024-01-01T00:00:00Z", []))
                   for k, u in enumerate([url, "http://a/2"])]
        found = list(warc.records_in(io.BytesIO(b"".join(members)), 0, len(members[0]) + len(members[1])))
        assert [(offset, fields["warc-target-uri"]) for offset, fields, _ in found] == [(0, url), (len(members[0]), "http://a/2")]


def test_every_range_is_a_task(spark, tmp_path):
    """The rows that name the ranges are small, but adaptive planning must not read them in one task."""
    from pyspark.sql import functions as F
    pages = spark.createDataFrame([(k, f"http://h{k}.example/", f"<p>{k} " + "x" * 2000) for k in range(60)],
                                  "page_id long, url string, html string")
    manifest = warc.write(pages, str(tmp_path / "warc"))
    size = manifest.agg(F.sum("bytes")).first()[0]
    split = max(1, size // 20)
    ranges = manifest.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0]
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and ranges >= 15
    records = warc.read(manifest, split_bytes=split)
    assert records.rdd.getNumPartitions() == ranges
    assert records.where("record_type = 'response'").count() == 60
