"""Writing and reading dictionary-compressed WARC archives.

An archive is a file of Zstandard frames: a leading skippable frame with the dictionary, then a
frame per record. The dictionary is trained on a bounded sample of the records to be archived.
Spark's text writer stores the frames, so that its commit protocol and any file system it knows
apply; between frames it puts an empty skippable frame, which readers pass over.

Defined results: null html is an empty payload; null and repeated page_ids are archived as they
are, null counts as smallest; of repeated rows with the largest page_id one is the response; a null
url leaves the target out; an empty table gives archives without records; extra columns are
ignored; payloads of any length are stored whole.
"""

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblens.llm.common import numbered, table
from joblens.session import scratch_dir

LEAST_REVISIT = 1000
SAMPLE_ROWS = 400
DICTIONARY_BYTES = 32 * 1024
LEVEL = 3
FILE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame; all of its bytes are ASCII.
BETWEEN = struct.pack("<II", 0x184D2A50, 0).decode("ascii")


def http_head(payload_bytes: int) -> bytes:
    lines = (
        "HTTP/1.1 200 OK",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {payload_bytes}",
    )
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record_id(page_id: str | None, digest: str, uid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{uid}')}>"


def one_line(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in value)


def record(row: dict, payload: bytes) -> bytes:
    """One WARC record. row: uid, page_id, url, digest, size, first (of its group) or null."""
    first = row["first"]
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", record_id(row["page_id"], row["digest"], row["uid"])),
        ("WARC-Date", DATE),
    ]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", one_line(row["url"])))
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if row["page_id"] is not None:
        fields.append(("X-Page-ID", row["page_id"]))
    block = http_head(row["size"])
    if first is None:
        block += payload
    else:
        fields.append(("WARC-Profile", PROFILE))
        fields.append(("WARC-Refers-To", record_id(first["page_id"], row["digest"], first["uid"])))
        if first["page_id"] is not None:
            fields.append(("X-Refers-To-Page-ID", first["page_id"]))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def pages_to_archive(pages: DataFrame, files: int | None = None) -> DataFrame:
    """(uid, page_id, url, payload, digest, size, first): first names the response that a
    revisit refers to. With files, rows are dealt out by uid before the join, which needs no other
    shuffle of the payloads then."""
    html = F.encode(F.coalesce(F.col("row.html"), F.lit("")), "utf-8")
    rows = numbered(pages).select(
        "uid",
        F.col("row.page_id").alias("page_id"),
        F.col("row.url").cast("string").alias("url"),
        html.alias("payload"),
        F.sha1(html).alias("digest"),
        F.octet_length(html).cast("long").alias("size"),
    )
    long_rows = rows.where(F.col("size") >= LEAST_REVISIT).select(
        "uid", "page_id", F.sha2("payload", 256).alias("same")
    )
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "uid")
    groups = (
        long_rows.groupBy("same")
        .agg(F.max(order).alias("best"), F.count("*").alias("n"))
        .where("n > 1")
    )
    first = F.struct(F.col("best.page_id").cast("string").alias("page_id"), F.col("best.uid").alias("uid"))
    revisits = (
        long_rows.join(groups, "same")
        .where(F.col("uid") != F.col("best.uid"))
        .select("uid", first.alias("first"))
    )
    named = rows.withColumn("page_id", F.col("page_id").cast("string"))
    if files:
        named = named.repartition(files, "uid")
    return named.join(revisits, "uid", "left")


def train(pages: DataFrame) -> bytes:
    """The dictionary, made in one task from a sample of about SAMPLE_ROWS records."""
    rows = pages_to_archive(pages).drop("first").withColumn("first", F.lit(None).cast("int"))
    count = pages.count()
    draw = F.pmod(F.xxhash64("uid", F.lit("dictionary")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw * count < SAMPLE_ROWS).limit(2 * SAMPLE_ROWS).coalesce(1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [record(row, row["payload"]) for batch in batches for row in batch.to_pylist()]
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few records to train on: their own text
            made = b"".join(samples)[:DICTIONARY_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["made"])

    found = sample.mapInArrow(make, "made binary").collect()
    return bytes(found[0].made) if found else b""


def write(pages: DataFrame, path: str) -> None:
    """Archives of about FILE_BYTES of payload under path, named *.warc.zst.txt by Spark."""
    dictionary = train(pages)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        tool = zstandard.ZstdCompressor(LEVEL, dict_data=shared, write_checksum=True)
        started = False
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                if not started:
                    started = True
                    out.append(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                out += [
                    tool.compress(record(row, row["payload"]))
                    for row in batch.slice(at, 64).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    files = max(1, total // FILE_BYTES)
    archived = pages_to_archive(pages, files).mapInArrow(frames, "frame binary")
    archived.select(F.col("frame").cast("string")).write.option("lineSep", BETWEEN).text(path)


class Archive:
    """The records of one archive, read as a stream."""

    def __init__(self, content: bytes):
        magic, size = struct.unpack_from("<II", content)
        if magic != DICTIONARY_MAGIC:
            raise ValueError("no dictionary frame")
        dictionary = content[8 : 8 + size]
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        tool = zstandard.ZstdDecompressor(dict_data=shared)
        self.stream = tool.stream_reader(content[8 + size :], read_across_frames=True)
        self.held = b""

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            more = self.stream.read(1 << 16)
            if not more:
                return None
            self.held += more
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, size: int) -> bytes:
        parts, missing = [self.held[:size]], size - len(self.held)
        self.held = self.held[size:]
        while missing > 0:
            more = self.stream.read(missing)
            if not more:
                raise ValueError("archive ends within a record")
            parts.append(more)
            missing -= len(more)
        return b"".join(parts)

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while (head := self.until(b"\r\n\r\n")) is not None:
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            block = self.take(int(fields["Content-Length"]))
            self.take(4)
            yield fields, block


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload); payload is
    null for revisits. page_id and refers_to are text, as in the archive."""
    kinds = pa.schema(
        [
            ("page_id", pa.string()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("refers_to", pa.string()),
            ("payload", pa.binary()),
        ]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                out = []
                for fields, block in Archive(content):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                    response = fields["WARC-Type"] == "response"
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    if response and (
                        len(payload) != size or hashlib.sha1(payload).hexdigest() != digest
                    ):
                        raise ValueError("a payload differs from its digest")
                    out.append(
                        {
                            "page_id": fields.get("X-Page-ID"),
                            "url": fields.get("WARC-Target-URI"),
                            "record_type": fields["WARC-Type"],
                            "payload_bytes": size,
                            "payload_digest": digest,
                            "refers_to": fields.get("X-Refers-To-Page-ID"),
                            "payload": payload if response and with_payload else None,
                        }
                    )
                    if len(out) == 64:
                        yield pa.RecordBatch.from_pylist(out, kinds)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(
        rows,
        "page_id string, url string, record_type string, payload_bytes long, "
        "payload_digest string, refers_to string, payload binary",
    )


def op7_dictionary_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_dir(spark, "warc")
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    return read(spark, path, with_payload=False).select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )

