import hashlib
import random
import re
import struct
from pathlib import Path

import pytest
import zstandard
from plans import shuffled, watch_writes

from tidemark.llm import warc
from tidemark.sources.tables import shared_dir

PAGES = "page_id bigint, url string, html string, digest string, bytes int, payload string"


def page(i, html, url="http://example.com/x"):
    return (i, url, html, "clash", 1, "clash")


def words(rng, n):
    return "".join(f"<p>{rng.choice(['alpha', 'beta', 'gamma', 'déjà'])} {rng.randrange(9999)}</p>" for _ in range(n))


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(5)
    same, small = words(rng, 80), "small"
    out = [page(i, words(rng, rng.randrange(1, 200)), f"http://example.com/{i}\r\nX: y é") for i in range(400)]
    out += [page(i, same) for i in (1000, 1003, 1001)] + [page(i, small) for i in (1010, 1011)]
    out += [page(2000, None), page(2001, ""), page(2002, "x" * 3_000_000), page(2003, "x" * 3_000_000, None)]
    out += [page(None, same), page(1003, same), page(None, "no id"), page(2010, "a\r\n\r\nContent-Length: 3\r\n\r\nb" * 50)]
    out += [page(3000, "y" * 999), page(3001, "y" * 999), page(3002, "z" * 1000), page(3003, "z" * 1000)]
    return out


def brute(pages):
    responses = {}
    for i, _, html, *_ in pages:
        raw = (html or "").encode()
        if len(raw) >= 1000 and i is not None:
            responses[raw] = max(i, responses.get(raw, i))
    out = []
    for i, _, html, *_ in pages:
        raw = (html or "").encode()
        again = raw in responses and i != responses[raw]
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", responses[raw] if again else None))
    return sorted(out, key=str)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives_round_trip(spark, pages):
    root = shared_dir(spark)
    manifest = warc.write_archives(spark.createDataFrame(pages, PAGES).repartition(3), root)
    read = warc.read_archives(manifest, root).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in read), key=str) == brute(pages)
    for row in read:
        if row.record_type == "response":
            assert hashlib.sha1(row.payload).hexdigest() == row.payload_digest


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_pages_never_shuffle(spark, pages, monkeypatch, limit):
    """Whatever the limit, and with no join broadcast by its size."""
    docs, root = spark.createDataFrame(pages, PAGES).repartition(3), shared_dir(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        seen = watch_writes(monkeypatch)
        manifest = warc.write_archives(docs.select("page_id", "url", "html"), root, limit=limit)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    read = warc.read_archives(manifest, root).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in read), key=str) == brute(pages)
    lines = shuffled(seen[1:])  # the first plan has the fixture's own repartition
    assert lines and not [line for line in lines if re.search(r"\b(payload|html)#", line)]


def test_each_record_is_a_frame_after_the_dictionary(spark, pages):
    root = shared_dir(spark)
    manifest = warc.write_archives(spark.createDataFrame(pages, PAGES).repartition(2), root).collect()
    for row in manifest:
        raw = Path(root, row.file).read_bytes()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D and len(raw) == row.n_bytes
        held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
        rest, records = raw[8 + size :], []
        while rest:
            frame = zstandard.ZstdDecompressor(dict_data=held).decompressobj()
            records.append(frame.decompress(rest))
            rest = frame.unused_data
        assert len(records) == row.n_records + 1 and b"WARC-Type: warcinfo" in records[0]
        assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
        assert all(r.count(b"WARC-Payload-Digest: sha1:") >= 1 for r in records[1:])


def test_files_roll_over(spark, pages, monkeypatch):
    root = shared_dir(spark)
    written = warc.write_archives(spark.createDataFrame(pages[:50], PAGES).coalesce(1), root)
    assert written.count() == 1
    assert warc.read_archives(written, root, payloads=False).filter("payload is not null").count() == 0


def test_few_pages_and_none(spark):
    for pages in ([page(1, "one")], []):
        root = shared_dir(spark)
        manifest = warc.write_archives(spark.createDataFrame(pages, PAGES), root)
        assert sorted((tuple(r[c] for c in COLUMNS) for r in warc.read_archives(manifest, root).collect()), key=str) == brute(pages)


def test_a_damaged_record_is_noticed():
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest())
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r", b"pailoat\r"))
    with pytest.raises(ValueError):
        warc.parse(good[:-3])
