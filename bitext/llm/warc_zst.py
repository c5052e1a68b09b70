"""WARC archives of Zstandard frames: written by Spark, read back and validated.

Layout of an archive (``.warc.zst``): a skippable frame with the dictionary, then one
Zstandard frame per record.  Further skippable frames may stand anywhere and mean
nothing.

Reading: Spark lists and opens the files (``binaryFile``, so any file system will do),
a task takes the dictionary out of the leading skippable frame (plain or itself
compressed), walks from frame to frame by their block headers, decodes one frame per
record and validates it: version line, header lines, the headers every record must have,
Content-Length against the block, the closing empty lines, that the frame ends there, and
for HTTP responses the Content-Length of the message and the SHA-1 of the payload.  A
record that fails raises ``ValueError`` with file and offset: an archive is read whole or
not at all.

Writing: ``write_pages`` makes an HTTP response record per page.  Of pages with equal
payloads of at least ``REVISIT_BYTES`` the one with the largest id is the response, the
others are revisit records that refer to it and carry no payload.  Equal payloads meet as
digests (map-side combined); a digest that more than one row in ``HOT_SHARE`` has is
broadcast (so there are fewer than ``HOT_SHARE`` of them), the other digests are joined,
and rows that are settled are spread by their id.  A task closes an archive
beyond ``ARCHIVE_BYTES``.  An archive is a value of Spark's text writer, a file of its own,
so its commit protocol applies and a lost task's files vanish; the line end that this
writer adds is the content of a last skippable frame.

Edge cases: a null payload counts as empty; pages without id are responses, never referred
to, and revisit like others; rows with the winner's id and payload are all responses; null
URLs have no target header; other characters than visible ASCII in URLs are percent-encoded;
an empty table gives no records; further columns are not read, whatever their names."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.llm.common import parts, stored, text_of
from bitext.session import ensure_checkpoint_dir

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
HOT_SHARE = 1024
DICT_BYTES = 48 << 10
SAMPLE_PAGES = 1000   # pages that the dictionary is trained on, about
SAMPLE_BYTES = 8192   # of each
LEVEL = 3

# Frame magics, the record version and the profile of a revisit by digest.
DICTIONARY_FRAME = 0x184D2A5D
PLAIN_SKIPPABLE = 0x184D2A50
ZSTD_FRAME = 0xFD2FB528
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")

_VISIBLE = "".join(map(chr, range(33, 127)))


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends."""
    flags = data[at + 4]
    place = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        head = int.from_bytes(data[place : place + 3], "little")
        if place + 3 > len(data) or head >> 1 & 3 == 3:
            raise ValueError("a block header is cut off or not valid")
        place += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)  # one byte stands for a run of it
        if head & 1:
            break
    place += 4 if flags & 4 else 0
    if place > len(data):
        raise ValueError("a frame is cut off")
    return place


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded content) of the record frames."""
    reader, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"offset {at}: bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        try:
            if magic & 0xFFFFFFF0 == PLAIN_SKIPPABLE:
                end = at + 8 + size
                if end > len(data):
                    raise ValueError("a skippable frame is cut off")
                if at == 0 and magic == DICTIONARY_FRAME:
                    kept = data[8:end]
                    if kept[:4] == struct.pack("<I", ZSTD_FRAME):
                        kept = reader.decompressobj().decompress(kept)
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(kept, zstandard.DICT_TYPE_FULLDICT))
            elif magic == ZSTD_FRAME:
                end = frame_end(data, at)
                decoder = reader.decompressobj()
                content = decoder.decompress(data[at:end])
                if not decoder.eof or decoder.unused_data:
                    raise ValueError("a frame is not whole")
                yield at, content
            else:
                raise ValueError("no frame starts here")
        except (ValueError, zstandard.ZstdError) as e:
            raise ValueError(f"offset {at}: {e}") from e
        at = end


def header_lines(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last is not None:
            out[last] += " " + line.strip().decode("utf-8")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header line: {line[:60]!r}")
        last = name.decode("ascii").lower()
        if last in out and last in NEEDED:
            raise ValueError(f"header {last} comes twice")
        out[last] = value.strip().decode("utf-8")
    return out


def _length(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise ValueError(f"not a length: {text!r}")
    return int(text)


def sha1_hex(digest: str) -> str:
    """A ``sha1:`` header value, base 32 or hexadecimal, as lower-case hex."""
    kind, _, value = digest.partition(":")
    if kind.lower() != "sha1":
        raise ValueError(f"digest of an unknown kind: {digest!r}")
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def record(content: bytes) -> dict:
    """The validated record that a frame holds."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in VERSIONS:
        raise ValueError("not a WARC record")
    headers = header_lines(lines)
    missing = [n for n in NEEDED if not headers.get(n)]
    if missing:
        raise ValueError(f"headers missing: {', '.join(missing)}")
    size = _length(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block is not {size} bytes and two line ends")
    block = rest[:size]
    kind = headers["warc-type"]
    out = {
        "record_type": kind,
        "record_id": headers["warc-record-id"],
        "target_uri": headers.get("warc-target-uri"),
        "date": headers["warc-date"],
        "refers_to": headers.get("warc-refers-to"),
        "headers": list(headers.items()),
        "payload_bytes": None,
        "payload_digest": sha1_hex(headers["warc-payload-digest"]) if "warc-payload-digest" in headers else None,
        "payload": None,
    }
    if headers.get("content-type", "").replace(" ", "").startswith("application/http;msgtype=response"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        status, *lines = head.split(b"\r\n")
        if not gap or not status.startswith(b"HTTP/"):
            raise ValueError("the block is not an HTTP response")
        said = header_lines(lines).get("content-length")
        out["payload_bytes"] = _length(said) if said is not None else None
        if kind == "revisit":
            if payload:
                raise ValueError("a revisit record has a payload")
        else:
            if said is not None and len(payload) != out["payload_bytes"]:
                raise ValueError(f"the payload has {len(payload)} bytes, its header says {said}")
            found = hashlib.sha1(payload).hexdigest()
            if out["payload_digest"] not in (None, found):
                raise ValueError("the payload's digest is another one than its header says")
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": found}
    else:
        out |= {"payload": block, "payload_bytes": len(block)}
    return out


_RECORD = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
     ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()),
     ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("payload", pa.binary())]
)
_RECORD_SQL = (
    "archive string, offset long, record_type string, record_id string, target_uri string, date string, refers_to string, "
    "headers map<string,string>, payload_bytes long, payload_digest string, payload binary"
)


def read_warc(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the archives in a folder (or of one archive)."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, rows, size = b.column(0)[i].as_py(), [], 0
                at = 0
                try:
                    for at, content in frames(b.column(1)[i].as_buffer().to_pybytes()):
                        rows.append({"archive": name, "offset": at} | record(content))
                        size += len(content)
                        if size > batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows, size = [], 0
                except ValueError as e:
                    raise ValueError(f"{name}, record at {at}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _RECORD_SQL)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(column: str):
    """The page id in a record id made by ``record_id``."""
    return F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, winner: int | None, date: str) -> bytes:
    """The record of a page; ``winner`` is the page that it revisits, if any."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if winner is not None else http + payload
    headers = [
        ("WARC-Type", "response" if winner is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        headers.insert(2, ("WARC-Target-URI", quote(url, safe=_VISIBLE, errors="replace")))
    if winner is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(winner))]
    head = "".join(f"{n}: {v}\r\n" for n, v in headers).encode()
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes | None:
    """A dictionary, or none where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if samples else None
    except zstandard.ZstdError:
        return None


class _Archive:
    def __init__(self, dictionary: bytes | None):
        kind = zstandard.DICT_TYPE_FULLDICT
        kept = zstandard.ZstdCompressionDict(dictionary, kind) if dictionary else None
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_checksum=True)
        self.head = skippable(DICTIONARY_FRAME, zstandard.compress(dictionary)) if dictionary else b""
        self.data = bytearray(self.head)

    def add(self, content: bytes) -> None:
        self.data += self.packer.compress(content)

    def close(self) -> pa.RecordBatch:
        #: the next byte, a line end that Spark writes, is this frame's content
        whole = bytes(self.data) + skippable(PLAIN_SKIPPABLE, b"\n")[:-1]
        self.data = bytearray(self.head)
        return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["archive"])

    def __len__(self) -> int:
        return len(self.data) - len(self.head)


def with_winner(pages: DataFrame) -> DataFrame:
    """Adds ``winner`` to (page_id, payload, ...): the page that this one revisits."""
    keyed = pages.withColumn("key", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha2("payload", 256)))
    found = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("winner"))
    found = stored(found.filter("key is not null and n > 1 and winner is not null"), "winners")
    total = pages.count()
    hot = found.filter(F.col("n") * HOT_SHARE > total).select("key", F.col("winner").alias("hot_winner"))
    rest = found.filter(F.col("n") * HOT_SHARE <= total).select(F.col("key").alias("spread"), F.col("winner").alias("rest_winner"))
    # a hot digest is settled by a broadcast; its rows and short ones go anywhere in the join
    settled = keyed.join(F.broadcast(hot), "key", "left")
    anywhere = F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string"))
    open_key = F.when(F.col("key").isNotNull() & F.col("hot_winner").isNull(), F.col("key")).otherwise(anywhere)
    joined = settled.withColumn("spread", open_key).join(rest, "spread", "left")
    winner = F.coalesce("hot_winner", "rest_winner")
    return joined.withColumn("winner", F.when(~F.col("page_id").eqNullSafe(winner), winner)).drop(
        "key", "spread", "hot_winner", "rest_winner"
    )


def write_pages(
    pages: DataFrame, date: str, path: str | None = None,
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> str:
    """Write the archives of (id, URL, payload text) rows; returns their folder."""
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        text_of(payload_col).cast("binary").alias("payload"),
    )
    share = 1 + SAMPLE_PAGES * (1 << 20) // max(1, pages.count())
    some = rows.filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < share).limit(2 * SAMPLE_PAGES)
    cut = F.substring("payload", 1, SAMPLE_BYTES).alias("payload")
    dictionary = train(
        [page_record(r.page_id, r.url, bytes(r.payload), "0" * 40, None, date) for r in some.select("page_id", F.substring("url", 1, 500).alias("url"), cut).collect()]
    )
    shared = spark.sparkContext.broadcast(dictionary)
    ready = with_winner(rows).select("page_id", "url", "payload", F.sha1("payload").alias("digest"), "winner")

    def run(batches):
        archive = _Archive(shared.value)
        for b in parts(batches, 200):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                archive.add(page_record(*row, date))
                if len(archive) > ARCHIVE_BYTES:
                    yield archive.close()
        if len(archive):
            yield archive.close()

    archives = ready.mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return path
