import io
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bidscope.llm import warc


def expected(rows):
    first = {}
    for i, html in rows:
        payload = (html or "").encode()
        if i is not None:
            first[payload] = min(i, first.get(payload, i))
    out = []
    for i, html in rows:
        payload = (html or "").encode()
        low = first.get(payload)
        kind = "response" if low is None or low == i else "revisit"
        out.append((i, len(payload), warc.digest_of(payload), kind, low if kind == "revisit" else None))
    return out


def test_pages_come_back(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["", None, "<p>é</p>", "x" * 200_000, "a\r\n\r\nb", *[str(rng.random()) * rng.randint(1, 40) for _ in range(20)]]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(0, "<p>é</p>"), (None, "only here"), (None, "x" * 200_000), (5, None), (5, None)]
    pages = spark.createDataFrame([(i, f"http://h/{i} ü\n?q" if k % 3 else None, h, k) for k, (i, h) in enumerate(rows)], "page_id bigint, url string, html string, digest int")
    got = warc.archive_pages(pages.repartition(4)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows), key=str)
    assert warc.archive_pages(pages.filter("false")).count() == 0


def test_archives_roll_and_payloads_are_whole(spark, tmp_path):
    rows = [(i, f"http://h/{i}", bytes([i % 256]) * 1000 + bytes(range(256)), i) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, payload binary, first bigint").coalesce(1)
    archives = warc.write_archives(pages, f"file://{tmp_path}", archive_bytes=2_000)
    listed = archives.collect()
    assert len(listed) > 3 and sum(r["records"] for r in listed) == 40
    back = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(archives, f"file://{tmp_path}").collect()}
    assert back == {r[0]: r[2] for r in rows}
    with zipfile.ZipFile(tmp_path / listed[0]["archive"]) as z:  # other tools read them too
        assert z.testzip() is None and {x.compress_type for x in z.infolist()} == {zipfile.ZIP_STORED}
        assert set(z.namelist()) == {warc.DATA, warc.INDEX}


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 a comment" * 30])
def test_plain_zip_directories(comment):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("one.txt", b"first")
        z.writestr("zwei/ü.txt", b"second" * 100)
        z.comment = comment
    file = pa.BufferReader(buffer.getvalue())
    members = {m.name: m for m in warc.members_of(file)}
    assert set(members) == {"one.txt", "zwei/ü.txt"}
    m = members["zwei/ü.txt"]
    assert warc.read_range(file, warc.data_start(file, m), m.size) == b"second" * 100
    with pytest.raises(ValueError):
        warc.members_of(pa.BufferReader(b"not an archive" * 4))


def test_damage_is_noticed():
    raw, _ = warc.record_of(1, "u", b"payload", 1)
    assert warc.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload\r", b"pailoed\r"))


def test_smallest_page_of_a_payload(spark):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("html"))
    rows = {r["page_id"]: r["first"] for r in warc.with_first(pages).collect()}
    assert rows == {i: 0 if i % 3 == 0 else i for i in range(50)}
