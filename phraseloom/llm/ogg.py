"""Media columns: texts stored losslessly as 8-bit samples in Ogg files, and read back.

A file multiplexes two logical streams: `samples`, whose packets hold up to 4080 samples and
whose granule positions count samples, and `index`, one packet for each samples packet with
the number of samples before it, so that the reader has to take the streams apart by serial
number. Nulls count as empty texts; an empty text stores 64 zero samples. Texts of any length
are taken row by row: memory is a few times the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs

RATE = 8000
SAMPLES, INDEX = 0x53414D50, 0x494E4458
PACKET = 4080
REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))
HEADER = struct.Struct("<4sBBqIII B")


def page_crc(page: bytes) -> int:
    """The checksum of an Ogg page: polynomial 0x04C11DB7, high bit first, register 0.

    zlib has the same polynomial low bit first, so bytes and result are mirrored.
    """
    register = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(REVERSED), "big")


class _Writer:
    """Pages of one logical stream; a page is closed at 255 lacing values."""

    def __init__(self, serial: int, out: list[tuple[int, bytes]]) -> None:
        self.serial, self.out, self.sequence = serial, out, 0
        self.lacing, self.body, self.granule, self.cont = bytearray(), [], -1, False

    def packet(self, data: bytes, granule: int) -> None:
        lacing = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        while lacing:
            room = 255 - len(self.lacing)
            now, lacing = lacing[:room], lacing[room:]
            size = sum(now)
            self.body.append(data[at : at + size])
            at += size
            self.lacing += now
            if not lacing:
                self.granule = granule
            if len(self.lacing) == 255:
                self.flush(begun=bool(lacing))

    def flush(self, last: bool = False, begun: bool = False) -> None:
        if not self.lacing and not last:
            return
        kind = (1 if self.cont else 0) | (2 if self.sequence == 0 else 0) | (4 if last else 0)
        head = HEADER.pack(b"OggS", 0, kind, self.granule, self.serial, self.sequence, 0, len(self.lacing))
        page = bytearray(head + bytes(self.lacing) + b"".join(self.body))
        page[22:26] = page_crc(bytes(page)).to_bytes(4, "little")
        self.out.append((self.sequence, bytes(page)))
        self.sequence += 1
        self.lacing, self.body, self.granule, self.cont = bytearray(), [], -1, begun


def encode(payload: bytes) -> bytes:
    """An Ogg file of the payload's bytes as samples, with an index stream beside it."""
    pages: list[tuple[int, bytes]] = []
    samples, index = _Writer(SAMPLES, pages), _Writer(INDEX, pages)
    samples.packet(b"PCM8" + struct.pack("<IQ", RATE, len(payload)), 0)
    samples.flush()
    index.packet(b"INDX" + struct.pack("<I", PACKET), 0)
    index.flush()
    for at in range(0, len(payload), PACKET):
        part = payload[at : at + PACKET]
        samples.packet(part, at + len(part))
        index.packet(struct.pack("<Q", at), at + len(part))
    samples.flush(last=True)
    index.flush(last=True)
    return b"".join(page for _, page in pages)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


class OggError(ValueError):
    """The bytes are no sound Ogg file."""


def decode(media: bytes) -> dict[int, Stream]:
    """Packets and their granule positions of each logical stream, by serial number.

    Raises OggError at a wrong checksum, a missing page, a cut page or an open packet. A
    granule is -1 for packets that do not end their page's last packet.
    """
    streams: dict[int, Stream] = {}
    partial: dict[int, list[bytes]] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise OggError("a page header is cut")
        capture, version, kind, granule, serial, sequence, crc, count = HEADER.unpack_from(media, at)
        if capture != b"OggS" or version:
            raise OggError(f"no page starts at byte {at}")
        lacing = media[at + 27 : at + 27 + count]
        body = at + 27 + count
        end = body + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise OggError("a page is cut")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"the checksum of the page at byte {at} is wrong")
        if (kind & 2 != 0) != (serial not in streams):
            raise OggError("a stream starts twice or not at all")
        stream = streams.setdefault(serial, Stream())
        if stream.ended or sequence != stream.pages:
            raise OggError("a page is missing")
        if bool(kind & 1) != bool(partial.get(serial)):
            raise OggError("a continued packet has no start or end")
        stream.pages += 1
        stream.ended = bool(kind & 4)
        first = len(stream.packets)
        size = 0
        for value in lacing:
            size += value
            if value < 255:
                whole = b"".join([*partial.pop(serial, []), media[body : body + size]])
                stream.packets.append(whole)
                stream.granules.append(-1)
                body, size = body + size, 0
        if size or (lacing and lacing[-1] == 255):
            partial.setdefault(serial, []).append(media[body : body + size])
        if len(stream.packets) > first:
            stream.granules[-1] = granule
        at = end
    if any(partial.values()) or not all(s.ended for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


def read_samples(media: bytes) -> tuple[bytes, list[float]]:
    """The samples of a file, and each packet's end in seconds by its granule position.

    Packets whose position their page does not state get it from the next stated one, less
    the samples between.
    """
    streams = decode(media)
    stream, index = streams[SAMPLES], streams[INDEX]
    head = stream.packets[0]
    if head[:4] != b"PCM8" or index.packets[0][:4] != b"INDX":
        raise OggError("a stream header is wrong")
    rate, total = struct.unpack("<IQ", head[4:16])
    parts = stream.packets[1:]
    samples = b"".join(parts)
    starts = [struct.unpack("<Q", x)[0] for x in index.packets[1:]]
    if len(samples) != total or starts != list(range(0, total, PACKET)):
        raise OggError("samples are missing")
    ends = list(stream.granules[1:])
    for k in range(len(ends) - 1, -1, -1):
        if ends[k] < 0:
            ends[k] = ends[k + 1] - len(parts[k + 1])
    if ends and ends[-1] != total:
        raise OggError("the last granule position is not the number of samples")
    return samples, [x / rate for x in ends]


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def features(samples: bytes, ends: list[float]) -> str:
    """Length in seconds, packets, and mean, RMS, peak and zero crossings about the centre 128."""
    x = np.frombuffer(samples, np.uint8)
    n = len(x)
    total = int(x.sum(dtype=np.int64))
    square = int(np.dot(x.astype(np.float32), x.astype(np.float32))) if n < 256 else int((x.astype(np.uint32) ** 2).sum(dtype=np.int64))
    high = x >= 128
    cross = int(np.count_nonzero(high[1:] != high[:-1]))
    mean = total / n - 128
    rms = max(0.0, square / n - 256 * (total / n) + 16384) ** 0.5
    return f"s={ends[-1] if ends else 0.0:.6f};packets={len(ends)};mean={mean:.4f};rms={rms:.4f};peak={int(x.max())};cross={cross}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(text: str | None) -> tuple:
    data = (text or "").encode()
    media = encode(padded(data))
    samples, ends = read_samples(media)
    return (len(data), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples, ends))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches, "text", 8 << 20):
        rows = [digest(x) for x in batch.column("text").to_pylist()]
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def ogg_digests(docs: DataFrame) -> DataFrame:
    """doc_id and the figures of each text's Ogg file; one row for each row of docs."""
    return docs.select("doc_id", "text").mapInArrow(_digests, SCHEMA)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches, "text", 8 << 20):
        media = [encode(padded((x or "").encode())) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])


def ogg_files(docs: DataFrame) -> DataFrame:
    """doc_id and media, the Ogg file of each text."""
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(_files, "doc_id long, media binary")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            try:
                found = [(key, serial, s.pages, len(s.packets), sum(map(len, s.packets)), max(s.granules, default=-1), None) for serial, s in sorted(decode(media or b"").items())]
                rows += found or [(key, None, 0, 0, 0, None, "no page")]
            except OggError as e:
                rows.append((key, None, 0, 0, 0, None, str(e)))
        names = ["doc_id", "serial", "pages", "packets", "bytes", "granule", "error"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def ogg_streams(files: DataFrame) -> DataFrame:
    """The logical streams of each Ogg file in `media`; a broken file has one row with error set."""
    return files.select("doc_id", "media").mapInArrow(_streams, "doc_id long, serial long, pages long, packets long, bytes long, granule long, error string")
