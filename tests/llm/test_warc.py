import base64
import gzip
import hashlib
import io
from collections import defaultdict

import pytest
from pyspark.sql.datasource import EqualTo, In

from geoseries.llm import warc
from geoseries.session import scratch_path

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (5, "u\r\nv", "é" * 100_000)]
PAGES += [(6, "http://d/", "only \r\n\r\nWARC/1.1\r\n\r\n inside"), (7, "http://e/", "twice"), (7, "http://e/", "twice"), (None, "http://f/", "twice")]
PAGES += [(i, f"http://h/{i}", "hot") for i in range(100, 400)]


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, pages, least):
    uri = scratch_path(spark, "warc")
    warc.archive_pages(pages(PAGES), uri, min_revisit=least)
    groups = defaultdict(list)
    for i, _, h in PAGES:
        groups[(h or "").encode()].append(i)
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        first = min(x for x in groups[body] if x is not None)
        again = i != first and len(body) >= least
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((i, len(body), digest, "revisit" if again else "response", first if again else None))
    got = [tuple(r) for r in warc.page_records(spark, uri).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    held = warc.read_payloads(spark, uri).filter("record_type = 'response'").collect()
    assert all(hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest[5:]) for r in held)
    assert {bytes(r.payload) for r in held} == set(groups)
    assert warc.read_headers(spark, uri).filter("target_uri like 'http://h/%' and record_type in ('revisit')").count() == (0 if least else 299)


def test_empty_table(spark, pages):
    uri = scratch_path(spark, "warc")
    warc.archive_pages(pages([]), uri)
    assert warc.page_records(spark, uri).collect() == []


@pytest.mark.parametrize("compressed", [False, True])
def test_skipped_blocks_are_not_read(compressed):
    bodies = [b"a" * 300_000, b"b", b"", b"c" * 70_000]
    parts = [warc.record({"WARC-Type": "response", "WARC-Target-URI": f"u{i}"}, b) for i, b in enumerate(bodies)]
    data = b"".join(map(gzip.compress, parts)) if compressed else b"".join(parts)
    source = io.BytesIO(data)
    stream, seen = warc.RecordStream(source, compressed), []
    for i, (fields, length) in enumerate(stream):
        assert length == len(bodies[i]) and fields["warc-target-uri"] == f"u{i}"
        if i % 2:
            seen.append(stream.block(length))
        else:
            stream.skip(length)
    assert seen == bodies[1::2]
    with pytest.raises(ValueError):
        broken = warc.RecordStream(io.BytesIO(parts[0][:1000]), False)
        for _, length in broken:
            broken.block(length)


def test_filters_are_pushed():
    from pyspark.sql.types import StringType, StructType

    reader = warc.WarcReader({"path": "/nowhere"}, StructType().add("record_type", StringType()))
    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("a",)), EqualTo(("payload_bytes",), 3)]))
    assert rest == [EqualTo(("payload_bytes",), 3)] and len(reader.filters) == 2
    assert warc._matches(reader.filters, {"warc-type": "response", "warc-target-uri": "a"})
    assert not warc._matches(reader.filters, {"warc-type": "response"})
