"""Ogg media columns: write texts into Ogg files, and read Ogg bytes page by page.

Layout (RFC 3533): pages with a 27-byte header, a lacing table, and a checksum over the
page (polynomial 0x04C11DB7, most significant bit first, start 0, checksum field zero).
``write_ogg`` multiplexes two logical streams: samples (8-bit, RATE a second, packets of
PACKET bytes behind a header packet) and a tags stream that states the unpadded length. ``read_ogg`` verifies
checksums, rebuilds packets from lacing values over page borders, separates the streams by
serial number and dates every packet that ends a page from its granule position.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.llm.common import bodies, table

RATE, PACKET, UNIT = 8000, 960, 192
SAMPLES, TAGS = 1, 2
CONTINUED, BEGINS, ENDS = 1, 2, 4
NO_GRANULE = (1 << 64) - 1
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
HEAD = struct.Struct("<4sBBQIIIB")


def page_crc(page: bytes) -> int:
    """The checksum from zlib's, which takes bits in the other order and inverts at both ends."""
    crc = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(MIRROR), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing))
    crc = page_crc(head + lacing + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> Iterator[bytes]:
    """Pages of one logical stream; a packet comes with the granule position at its end.

    The first packet stands alone on the first page. A page holds up to 255 lacing values, so
    long packets run over into pages that are marked as continued.
    """
    lacing, body, granule, number, kind = bytearray(), bytearray(), NO_GRANULE, 0, BEGINS
    for k, (packet, end) in enumerate(packets):
        view, at = memoryview(packet), 0
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        for v in values:
            if len(lacing) == 255:
                yield page(kind, granule, serial, number, bytes(lacing), bytes(body))
                number += 1
                kind = CONTINUED if at else 0
                lacing, body, granule = bytearray(), bytearray(), NO_GRANULE
            lacing.append(v)
            body += view[at : at + v]
            at += v
        granule = end
        if k == 0 and len(packets) > 1:
            yield page(kind, granule, serial, number, bytes(lacing), bytes(body))
            number, kind = number + 1, 0
            lacing, body, granule = bytearray(), bytearray(), NO_GRANULE
    yield page(kind | ENDS, granule, serial, number, bytes(lacing), bytes(body))


def write_ogg(body: bytes) -> bytes:
    """The bytes, padded by spaces to a positive multiple of UNIT, as samples; beside it the tags."""
    payload = body + b" " * (-len(body) % UNIT if body else UNIT)
    packets = [(b"PCM     " + struct.pack(">HHIIBBH", 0, 0, 1, RATE, 1, 0, PACKET), 0)]
    packets += [(payload[at : at + PACKET], min(at + PACKET, len(payload))) for at in range(0, len(payload), PACKET)]
    samples = pages_of(packets, SAMPLES)
    tags = pages_of([(b"tags\x00\x00\x00\x01", 0), (struct.pack("<Q", len(body)), len(payload))], TAGS)
    out = [next(samples), next(tags)]  # first pages come first
    for one in samples:
        out.append(one)
        out.append(next(tags, b""))
    return b"".join(out)


def read_ogg(data: bytes) -> dict:
    """Streams by serial number and what is wrong.

    A stream has packets, their (packet number, seconds) where a page dates them, and page
    counts. A page with a wrong checksum is left out; a packet that misses a part goes with it.
    """
    streams: dict[int, dict] = {}
    bad, at = 0, 0
    while (at := data.find(b"OggS", at)) >= 0 and at + HEAD.size <= len(data):
        _, version, kind, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        lacing = data[at + HEAD.size : at + HEAD.size + n]
        start = at + HEAD.size + n
        end = start + sum(lacing)
        whole = data[at:end]
        if version or len(lacing) < n or end > len(data) or page_crc(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            bad, at = bad + 1, at + 4  # look for the next capture pattern
            continue
        s = streams.setdefault(serial, {"packets": [], "dated": [], "pages": 0, "next": number, "part": None, "lost": 0, "ended": False})
        if number != s["next"]:
            s["lost"] += 1
            s["part"] = None
        part = s["part"] if kind & CONTINUED else None
        skip = bool(kind & CONTINUED) and part is None  # the packet's start is lost
        part = part if part is not None else bytearray()
        for v in lacing:
            part += data[start : start + v]
            start += v
            if v < 255:
                if not skip:
                    s["packets"].append(bytes(part))
                part, skip = bytearray(), False
        s["part"] = part if n and lacing[-1] == 255 and not skip else None
        if granule != NO_GRANULE:
            s["dated"].append((len(s["packets"]) - 1, granule / RATE))
        s["pages"] += 1
        s["next"] = number + 1
        s["ended"] |= bool(kind & ENDS)
        at = end
    return {"streams": streams, "bad_pages": bad}


def ogg_column(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text (null: empty) as an Ogg file. Equal texts give equal files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((write_ogg(x.as_py()) for x in b.column(1)), pa.binary())], ["doc_id", "media"])

    return bodies(docs).mapInArrow(run, "doc_id long, media binary")


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int, bad_pages int, packets int, seconds double"


def media_features(media: DataFrame) -> DataFrame:
    """Of (doc_id, media): what reading the bytes back gives, one row for each.

    Bytes that are no Ogg, or null, give no pages: an empty payload, n_bytes null. The feature
    states streams, pages, packets and duration, and the mean and range of the samples.
    """

    def row(data: bytes | None) -> tuple:
        data = data or b""
        found = read_ogg(data)
        samples, tags = found["streams"].get(SAMPLES), found["streams"].get(TAGS)
        packets = samples["packets"][1:] if samples else []
        payload = b"".join(packets)
        n = struct.unpack("<Q", tags["packets"][1])[0] if tags and len(tags["packets"]) > 1 else None
        seconds = samples["dated"][-1][1] if samples and samples["dated"] else 0.0
        pages = sum(s["pages"] for s in found["streams"].values())
        units = np.frombuffer(payload or b"\0", np.uint8)
        feature = f"streams={len(found['streams'])};pages={pages};packets={len(packets)};seconds={seconds:.4f};mean={units.mean():.4f};low={units.min()};high={units.max()}"
        return (
            n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(),
            feature, pages, found["bad_pages"], len(packets), seconds,
        )

    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    types = [kinds[f.split()[1]] for f in FIELDS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(x.as_py()) for x in b.column(1)]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id long, {FIELDS}")


def packet_rows(media: DataFrame) -> DataFrame:
    """Of (doc_id, media): doc_id, serial, packet, bytes, seconds (null between dated packets)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, x in zip(b.column(0), b.column(1)):
                for serial, s in read_ogg(x.as_py() or b"")["streams"].items():
                    n, dated = len(s["packets"]), dict(s["dated"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc.as_py()] * n, pa.int64()), pa.array([serial] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(s["packets"], pa.binary()), pa.array([dated.get(k) for k in range(n)], pa.float64())],
                        ["doc_id", "serial", "packet", "bytes", "seconds"],
                    )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, serial long, packet int, bytes binary, seconds double")


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(ogg_column(table(spark, sf_dir, "documents")))
