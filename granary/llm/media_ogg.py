"""Media columns: Ogg files, written and read whole.

``encode_ogg`` stores 8-bit samples as packets of one logical stream beside a second stream of comments, pages
of both interleaved. ``read_ogg`` verifies each page's checksum and sequence number, reassembles packets from
the lacing values, separates the logical streams and derives each packet's time from the granule positions.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import mapped, slices, table

RATE = 8000  # samples a second
PACKET = 4000  # samples in a packet
SEGMENTS = 48  # lacing values in a page at most; packets run on over pages

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 04c11db7, most significant bit first, from 0; zlib's is its mirror image."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII B", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def stream_pages(packets: list[bytes], granules: list[int], serial: int) -> Iterator[bytes]:
    """The first packet on a page of its own (the stream's beginning), then pages of SEGMENTS lacing values."""
    segments: list[tuple[bytes, int]] = []  # a segment and the granule position if it ends its packet, else -1
    for packet, granule in zip(packets[1:], granules[1:]):
        cut = [packet[i : i + 255] for i in range(0, len(packet), 255)]
        if not cut or len(cut[-1]) == 255:
            cut.append(b"")
        segments += [(s, -1) for s in cut[:-1]] + [(cut[-1], granule)]
    first = packets[0]
    yield page(2 | (0 if segments else 4), granules[0], serial, 0, bytes([255] * (len(first) // 255) + [len(first) % 255]), first)
    for number, at in enumerate(range(0, len(segments), SEGMENTS), 1):
        part = segments[at : at + SEGMENTS]
        continued = at > 0 and segments[at - 1][1] == -1
        granule = next((g for _, g in reversed(part) if g != -1), -1)
        yield page(continued | (4 if at + SEGMENTS >= len(segments) else 0), granule, serial, number, bytes(len(s) for s, _ in part), b"".join(s for s, _ in part))


def encode_ogg(payload: bytes, comment: bytes = b"") -> bytes:
    """payload as 8-bit samples, with a comment stream; equal input gives equal bytes."""
    serial = zlib.crc32(payload)
    packets = [b"pcm8" + struct.pack("<IQ", RATE, len(payload))] + [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    granules = [0] + [min(i + PACKET, len(payload)) for i in range(0, len(payload), PACKET)]
    sound = stream_pages(packets, granules, serial)
    words = stream_pages([b"note" + struct.pack("<I", 1), comment], [0, 0], serial ^ 0xFFFFFFFF)
    out = [next(sound), next(words)]  # all beginnings come first
    for both in itertools.zip_longest(sound, words, fillvalue=b""):
        out += both
    return b"".join(out)


def read_ogg(media: bytes) -> dict[int, dict]:
    """Logical streams by serial number: packets, the end time of each in samples (None if not known), pages.

    Raises ValueError on a bad capture pattern, checksum, sequence number, or a packet cut short.
    """
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27 or media[at : at + 4] != b"OggS" or media[at + 4]:
            raise ValueError(f"no page at byte {at}")
        _, _, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError(f"page at byte {at} is cut short")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of page at byte {at}")
        s = streams.setdefault(serial, {"packets": [], "ends": [], "pages": 0, "part": [], "closed": False})
        if number != s["pages"] or bool(flags & 2) != (number == 0) or s["closed"] or bool(flags & 1) != bool(s["part"]):
            raise ValueError(f"page at byte {at} is out of order")
        s["pages"] += 1
        done = 0
        for size in lacing:
            s["part"].append(media[body : body + size])
            body += size
            if size < 255:
                s["packets"].append(b"".join(s["part"]))
                s["ends"].append(None)
                s["part"] = []
                done += 1
        if done:
            s["ends"][-1] = granule
        s["closed"] = bool(flags & 4)
        at = end
    for serial, s in streams.items():
        if s["part"] or not s["closed"]:
            raise ValueError(f"stream {serial} has no end")
        if s["packets"] and s["packets"][0][:4] == b"pcm8":  # a packet lasts as many samples as it has bytes: times between granule positions
            later = None
            for k in range(len(s["ends"]) - 1, 0, -1):
                if s["ends"][k] is None and later is not None:
                    s["ends"][k] = later - len(s["packets"][k + 1])
                later = s["ends"][k]
    return streams


def payload_of(text: bytes) -> bytes:
    """text, and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def features(streams: dict[int, dict]) -> tuple[bytes, str]:
    """The samples of the sound stream, and a line that describes them."""
    sound = next(s for s in streams.values() if s["packets"][0][:4] == b"pcm8")
    rate, size = struct.unpack("<IQ", sound["packets"][0][4:])
    samples = b"".join(sound["packets"][1:])
    if len(samples) != size or sound["ends"][-1] != size:
        raise ValueError("samples and granule position disagree")
    level = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
    pages = sum(s["pages"] for s in streams.values())
    packets = sum(len(s["packets"]) for s in streams.values())
    return samples, f"streams={len(streams)};pages={pages};packets={packets};seconds={size / rate:.6f};level={np.abs(level).mean():.6f};crossings={crossings}"


def add_media(texts: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text stored as an Ogg file. A null text counts as empty."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, 4 << 20):
                raw = [t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()]
                media = [encode_ogg(payload_of(t), str(len(t)).encode()) for t in raw]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=[id_column, "n_bytes", "media"])

    kind = texts.schema[id_column].dataType.simpleString()
    return texts.select(id_column, text_column).transform(mapped, write, f"{id_column} {kind}, n_bytes long, media binary")


def media_features(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Reads the media column back. A file that fails its checks gives null payload columns and the error."""
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column("media"):
                raw = stored.as_py() or b""
                row = [None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), None, None]
                try:
                    samples, feature = features(read_ogg(raw))
                    row[:3], row[5] = [len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:])], feature
                except (ValueError, StopIteration, IndexError, struct.error) as e:
                    row[6] = f"{type(e).__name__}: {e}"
                rows.append(row)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            made = [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(batch.column(1), pa.int64()), *made], names=names)

    kind = media.schema[id_column].dataType.simpleString()
    return media.select(id_column, "n_bytes", "media").transform(mapped, 
        read, f"{id_column} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(add_media(table(spark, sf_dir, "documents")))
