"""Web pages as dictionary-compressed WARC archives, written and read back.

Each file is ``.warc.zst``: a leading skippable frame embeds a Zstandard dictionary, then
every record is a frame of its own, compressed with it. The dictionary is trained on a bounded
sample of the records to be archived (``SAMPLE_RECORDS`` pages by the hash of their id, of each
the first ``SAMPLE_BYTES`` bytes); where they are too few to train one, files have none.

Of pages with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, the one with the largest
page_id is a ``response``, the others are ``revisit`` records that carry its digest, the HTTP
header and a reference, but no payload. Equal payloads are found by SHA-1 and length, counted
in map tasks first. Pages never shuffle, at any size: a revisit needs no payload, so revisits are
written from slim rows, and a bit per row (``places.py``) tells the tasks that read the pages which to
leave out.

Files are named per attempt, and only files of the committed manifest are read. A NULL html is
an empty payload, a NULL url is an empty target, a NULL page_id comes before all others and is
read back as NULL. Rows that repeat the id of a response are responses like it.
An empty table gives no files and no rows.
"""

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem, map_arrow, open_read, slices
from tidemark.llm.places import BROADCAST_BYTES, meet
from tidemark.sources.tables import materialise, scratch

MIN_REVISIT_BYTES = 1000
SAMPLE_RECORDS = 768
SAMPLE_BYTES = 8192
DICTIONARY_BYTES = 64 << 10
#: A file is closed once it has passed this size.
FILE_BYTES = 1 << 30
LEVEL = 3
#: Bytes that the reader hands to the decompressor at a time.
READ_BYTES = 4096
BLOCK_BYTES = 8 << 20

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

MANIFEST = "file string, n_records bigint, n_bytes bigint"
RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, payload binary"
)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page-id:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page-id:").removesuffix(">")
    return None if number == "none" else int(number)


def record(
    page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = EPOCH, length: int | None = None
) -> bytes:
    """A response, or a revisit, which keeps the HTTP header and leaves out the payload: of that its
    ``length`` will do."""
    size = len(payload) if length is None else length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join((url or "").split())
    extra = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {_record_id(refers_to)}\r\n" if revisit else ""
    head = (
        f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: {_record_id(page_id)}\r\n"
        f"WARC-Date: {date}\r\nWARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{extra}"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame) -> bytes:
    """A Zstandard dictionary of at most ``DICTIONARY_BYTES``, from the sample; empty if that is
    too small. At most ``SAMPLE_RECORDS * SAMPLE_BYTES`` bytes reach the driver."""
    place = F.xxhash64("page_id")
    # The ids are picked first, so that no task sends payloads that don't make the sample.
    last = pages.select(place.alias("place")).orderBy("place").limit(SAMPLE_RECORDS).agg(F.max("place")).first()[0]
    starts = pages.filter(place <= F.lit(last)).select(
        "page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")
    )
    sample = starts.orderBy(place, "page_id", "url", "payload").limit(SAMPLE_RECORDS)
    records = [
        record(r.page_id, r.url, bytes(r.payload), hashlib.sha1(r.payload).hexdigest())
        for r in sample.toLocalIterator()
    ]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few records, or too much alike
        return b""


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    picked = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    )
    return picked.select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes"),
        F.monotonically_increasing_id().alias("place"),
    )


def _revisits(placed: DataFrame) -> DataFrame:
    """The slim rows of all revisits, with the id of their response, saved."""
    known = placed.filter(F.col("bytes") >= MIN_REVISIT_BYTES).select("page_id", "url", "digest", "bytes", "place")
    groups = known.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to"))
    # Saved, so that the join is planned on its true size: broadcast only when it is small.
    repeated = materialise(groups.filter("n > 1 and refers_to is not null").drop("n"))
    return materialise(known.join(repeated, ["digest", "bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))))


def write_archives(pages: DataFrame, root: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Writes one record per page (page_id, url, html) under ``root``; returns the manifest. ``limit``
    bounds, in bytes, the bits that are broadcast at a time to tell revisits."""
    with scratch(pages.sparkSession):
        return _write_archives(materialise(_payloads(pages)), root, limit)


def _write_archives(placed: DataFrame, root: str, limit: int) -> DataFrame:
    revisits = _revisits(placed)
    dictionary = train_dictionary(placed)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(root)
        compressor = _compressor(dictionary)
        out, name, count, total = None, "", 0, 0
        for batch in batches:
            for piece in slices(batch, "payload"):
                for row in piece.to_pylist():
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                        out, count, total = fs.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                        total += out.write(_dictionary_frame(dictionary) + compressor.compress(_info(name)))
                    frame = record(
                        row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["revisit"], length=row["bytes"]
                    )
                    total += out.write(compressor.compress(frame))
                    count += 1
                    if total >= FILE_BYTES:
                        out.close()
                        yield _written(name, count, total)
                        out = None
        if out is not None:
            out.close()
            yield _written(name, count, total)

    def archived(rows: DataFrame, revisit: bool) -> DataFrame:
        payload = F.lit(b"") if revisit else F.col("payload")
        refers_to = F.col("refers_to") if revisit else F.lit(None).cast("bigint")
        columns = [payload.alias("payload"), refers_to.alias("refers_to"), F.lit(revisit).alias("revisit")]
        return map_arrow(rows.select("page_id", "url", "digest", "bytes", *columns), write, MANIFEST)

    responses = meet(placed, revisits.select("place"), lambda met: archived(met.filter("not hit"), False), limit)
    return materialise(responses.unionByName(archived(revisits, True)), keep=True)


def _written(name: str, count: int, total: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": [name], "n_records": [count], "n_bytes": [total]})


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if held:
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=held, write_checksum=True)
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)


def _dictionary_frame(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def _info(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\n"
        f"WARC-Date: {EPOCH}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\n"
        f"Content-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def frames(file: pa.NativeFile) -> Iterator[bytes]:
    """The decompressed records of an archive, read block by block."""
    size, at, dictionary = file.size(), 0, None
    if size >= 8:
        magic, length = struct.unpack("<II", file.read_at(8, 0))
        if magic == SKIPPABLE:
            content = file.read_at(length, 8)
            if content[:4] == zstandard.FRAME_HEADER:
                content = zstandard.ZstdDecompressor().decompress(content)
            dictionary, at = zstandard.ZstdCompressionDict(content), 8 + length
    opener = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    block, place, out, frame = b"", 0, [], None
    while True:
        if place == len(block):
            block, place = file.read_at(min(BLOCK_BYTES, size - at), at), 0
            at += len(block)
            if not block:
                break
        frame = frame or opener.decompressobj()
        some = block[place : place + READ_BYTES]
        out.append(frame.decompress(some))
        place += len(some) - len(frame.unused_data)
        if frame.eof:
            yield b"".join(out)
            out, frame = [], None
    if frame is not None:
        raise ValueError("the archive ends within a record")


def parse(content: bytes) -> dict | None:
    """Fields of a response or revisit, its payload checked against length and digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record: {version[:40]}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is not that of its header")
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page_id(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def read_archives(manifest: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """Every response and revisit of the archives; ``payload`` is NULL for revisits, and for all
    records where ``payloads`` is off. A task reads one file."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in RECORDS.split(", ")]
    schema = pa.schema(list(zip(names, kinds)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(root)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with open_read(fs, f"{path}/{name}") as file:
                    for content in frames(file):
                        if row := parse(content):
                            if not payloads:
                                row["payload"] = None
                            rows.append(row)
                            held += len(row["payload"] or b"") + 200
                            if held >= BLOCK_BYTES:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(manifest.repartition(max(1, manifest.count())), read, RECORDS)
