import base64
import hashlib
import os
import random
import struct
import tempfile

import pytest
import zstandard

from bitext.llm import warc_zst as wz

DATE = "2024-01-01T00:00:00Z"


def _record(payload=b"hello", kind="resource", version=b"WARC/1.0", length=None, extra=()):
    head = [("WARC-Type", kind), ("WARC-Record-ID", "<urn:x:1>"), ("WARC-Date", DATE), *extra]
    head.append(("Content-Length", str(len(payload) if length is None else length)))
    return version + b"\r\n" + "".join(f"{n}: {v}\r\n" for n, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def _dictionary():
    rnd = random.Random(1)
    return zstandard.train_dictionary(
        4000, [_record(" ".join(rnd.choice(["alpha", "beta", "gamma"]) + str(rnd.randrange(99)) for _ in range(60)).encode()) for _ in range(400)]
    )


def _archive(records, dictionary=None, compressed=True, between=b"", sized=True):
    packer = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=sized)
    out = b""
    if dictionary is not None:
        raw = dictionary.as_bytes()
        out = wz.skippable(wz.DICTIONARY_FRAME, zstandard.compress(raw) if compressed else raw)
    return out + b"".join(packer.compress(r) + between for r in records)


def _folder(*archives):
    folder = tempfile.mkdtemp(prefix="bitext-test-", dir="/tmp")
    for i, a in enumerate(archives):
        with open(os.path.join(folder, f"{i}.warc.zst"), "wb") as f:
            f.write(a)
    return folder


@pytest.mark.parametrize("compressed", [True, False])
def test_reads_archives_of_other_writers(spark, compressed):
    rnd = random.Random(2)
    payloads = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 500, 300_000)] + [b"a" * 700_000]
    recs = [_record(p) for p in payloads]
    gap = wz.skippable(0x184D2A53, b"anything")
    folder = _folder(_archive(recs, _dictionary(), compressed, gap), _archive(recs, None), _archive(recs, None, sized=False), b"")
    rows = wz.read_warc(spark, folder, batch_bytes=1000).collect()
    assert sorted(bytes(r.payload) for r in rows) == sorted(payloads * 3)
    assert {r.record_type for r in rows} == {"resource"} and all(r.payload_bytes == len(r.payload) for r in rows)


HTTP = ("Content-Type", "application/http; msgtype=response")


@pytest.mark.parametrize(
    "bad, says",
    [
        (_record(length=4), "two line ends"),
        (_record(length="5x"), "not a length"),
        (_record(version=b"WARC/9"), "not a WARC record"),
        (_record().replace(b"WARC-Date: " + DATE.encode() + b"\r\n", b""), "headers missing: warc-date"),
        (_record() + b"x", "two line ends"),
        (_record(extra=[("WARC-Date", DATE)]), "comes twice"),
        (_record(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nab", "response", extra=[HTTP]), "2 bytes, its header says 3"),
        (_record(b"no http", "response", extra=[HTTP]), "not an HTTP response"),
        (_record(b"HTTP/1.1 200 OK\r\n\r\nab", "revisit", extra=[HTTP]), "has a payload"),
        (_record(b"HTTP/1.1 200 OK\r\n\r\nab", "response", extra=[HTTP, ("WARC-Payload-Digest", "sha1:" + "0" * 40)]), "digest is another"),
    ],
)
def test_records_are_validated(bad, says):
    with pytest.raises(ValueError, match=says):
        wz.record(bad)


def test_frames_are_validated():
    good = _archive([_record(b"x" * 1000), _record(b"y" * 300_000)], _dictionary())
    assert len(list(wz.frames(good))) == 2
    for cut in (good[:-1], good[:20], good + b"abc", good + b"12345678", good[: len(good) - 40]):
        with pytest.raises(ValueError, match="offset"):
            list(wz.frames(cut))
    start = len(wz.skippable(wz.DICTIONARY_FRAME, zstandard.compress(_dictionary().as_bytes())))
    with pytest.raises(ValueError):  # without its dictionary
        list(wz.frames(good[start:]))
    broken = bytearray(good)
    broken[start + 60] ^= 255
    with pytest.raises(ValueError):
        [wz.record(c) for _, c in wz.frames(bytes(broken))]


def test_a_damaged_archive_stops_the_read(spark):
    folder = _folder(_archive([_record(), _record(length=3)]))
    with pytest.raises(Exception, match="0.warc.zst"):
        wz.read_warc(spark, folder).count()


def _pages():
    big = "<p>é & \r\n\r\nWARC/1.0 " * 100
    rows = [(i, f"http://a.b/{i}?x=ü y\r\n", f"<html>{i}</html>" * (i % 40)) for i in range(200)]
    rows += [(300 + i, "u", big) for i in range(100)]  # one payload on a third of all rows
    rows += [(500, "v", "x" * 999), (501, "v", "x" * 999), (502, "v", "x" * 1000), (503, None, "x" * 1000)]
    rows += [(None, "n", big), (None, None, None), (600, "w", None), (601, "w", ""), (399, "u", big), (399, "u", big)]
    return rows


@pytest.mark.parametrize("hot", [1024, 2, 1])
def test_round_trip(spark, monkeypatch, hot):
    monkeypatch.setattr(wz, "HOT_SHARE", hot)
    monkeypatch.setattr(wz, "ARCHIVE_BYTES", 2000)  # many archives a task
    rows = _pages()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, winner int, key string").repartition(3)
    folder = wz.write_pages(df, DATE)
    assert len([f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("part")]) > 3
    read = wz.read_warc(spark, folder)
    got = [
        (r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers, None if r.payload is None else bytes(r.payload))
        for r in read.select("*", wz.page_of("record_id").alias("page"), wz.page_of("refers_to").alias("refers")).collect()
    ]
    best = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 1000:
            best[t] = max(best.get(t, i), i)
    want = []
    for i, _, t in rows:
        b = (t or "").encode()
        to = best.get(t) if len(b) >= 1000 else None
        revisit = to is not None and to != i
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None, None if revisit else b))
    assert sorted(got, key=str) == sorted(want, key=str)
    urls = {r.record_id: r.target_uri for r in read.collect()}
    assert urls["<urn:page:7>"] == "http://a.b/7?x=%C3%BC%20y%0D%0A" and urls["<urn:page:503>"] is None


def test_archives_are_plain_zstandard(spark):
    """Any reader of such files can use them: dictionary first, a frame per record, the
    written line end inside a skippable frame."""
    df = spark.createDataFrame([(i, "u", f"<html><body>page number {i}</body></html>" * 30) for i in range(400)], "page_id long, url string, html string")
    folder = wz.write_pages(df.coalesce(1), DATE)
    where = folder.removeprefix("file:")
    data = open(next(os.path.join(where, f) for f in os.listdir(where) if f.startswith("part")), "rb").read()
    assert struct.unpack_from("<I", data)[0] == wz.DICTIONARY_FRAME
    assert len(list(wz.frames(data))) == 400 and data.endswith(wz.skippable(wz.PLAIN_SKIPPABLE, b"\n"))


def test_empty_table_and_digests(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert wz.read_warc(spark, wz.write_pages(none, DATE)).count() == 0
    raw = hashlib.sha1(b"x").digest()
    assert wz.sha1_hex("sha1:" + base64.b32encode(raw).decode()) == wz.sha1_hex("SHA1:" + raw.hex().upper()) == raw.hex()
    with pytest.raises(ValueError):
        wz.sha1_hex("md5:abc")
