"""Ogg files: round trips and damage."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from granary.llm import media_ogg


def test_ogg_round_trip_and_damage():
    rng = random.Random(3)
    for size in (1, 63, 64, 255, 256, 4000, 12_240, 12_241, 100_000):
        payload = media_ogg.payload_of(bytes(rng.randrange(256) for _ in range(size)))
        media = media_ogg.encode_ogg(payload, b"note")
        streams = media_ogg.read_ogg(media)
        assert media_ogg.features(streams)[0] == payload and len(streams) == 2
        sound = next(s for s in streams.values() if s["packets"][0][:4] == b"pcm8")
        assert sound["ends"][1:] == [min(k + media_ogg.PACKET, len(payload)) for k in range(0, len(payload), media_ogg.PACKET)]
        for at in (5, 22, len(media) // 2, len(media) - 1):
            bad = bytearray(media)
            bad[at] ^= 1
            with pytest.raises(ValueError):
                media_ogg.read_ogg(bytes(bad))
        with pytest.raises(ValueError):
            media_ogg.read_ogg(media[:-10])


def test_ogg_checksum_by_definition():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert media_ogg.page_checksum(data) == slow(data)


def test_media_awkward(awkward_docs, awkward):
    out = media_ogg.media_features(media_ogg.add_media(awkward_docs)).collect()
    assert len(out) == len(awkward) and all(r.error is None for r in out)
    by_text = {}
    for r in awkward:
        payload = media_ogg.payload_of((r[1] or "").encode())
        by_text.setdefault((len((r[1] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])), 0)
    assert {(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out} == set(by_text)
    broken = media_ogg.media_features(media_ogg.add_media(awkward_docs).withColumn("media", F.lit(b"junk"))).first()
    assert broken.payload_bytes is None and "ValueError" in broken.error
