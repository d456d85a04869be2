"""FLAC streams: round trips, a published example, faults, and the query's digests by brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm import flac as L

SCHEMA = "doc_id long, text string"


def shapes():
    rng = random.Random(4)
    wave = bytes(int(100 + 60 * np.sin(i / 9.0)) for i in range(3000))
    rough = bytes(rng.randrange(256) for _ in range(960))
    words = " ".join(rng.choice(["the", "heron", "stands", "é", "in", "ß", "water"]) for _ in range(900)).encode()
    spikes = bytearray(b"a" * 2000)
    for i in range(0, 2000, 97):
        spikes[i] = 255  # long runs of zeros in the Rice codes
    return [b" " * 192, wave, rough, words, bytes(spikes), b"\x00\xff" * 700, b"a", b"ab", b"abcdefgh", bytes(range(256)) * 3, b"x" * 577]


def test_round_trip_and_kinds():
    found = set()
    data = shapes()
    streams = L.encode(data)
    for p, s, d in zip(data, streams, L.decode(streams)):
        assert d.error is None and d.payload == p
        assert d.first == list(range(0, len(p), L.BLOCK))
        found |= {L.KINDS[k] for k in d.kind}
        for first, pcm, at, size in zip(d.first, d.pcm, d.offset, d.size):
            assert p[first : first + len(pcm)] == pcm and s[at] == 0xFF and at + size <= len(s)
    assert found == set(L.KINDS)


def test_small_steps_give_the_same(monkeypatch):
    data = shapes()
    whole = L.encode(data)
    monkeypatch.setattr(L, "LANES", 3)
    assert L.encode(data) == whole and [d.payload for d in L.decode(whole)] == data


def test_the_published_example():
    """24 samples of 8 bits: a linear predictor of order 3, four Rice partitions. Its MD5 is verified."""
    stream = bytes.fromhex("664c6143800000221000100000001f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32fff868020017e944004f6f313d1047d227cb6d090831452bdc2822228057a3")
    d = L.decode([stream])[0]
    assert d.error is None and [x - 128 for x in d.payload] == [0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0]


def test_without_seek_points_frames_follow_each_other():
    data = shapes()
    plain = []
    for s in L.encode(data):
        size = int.from_bytes(s[43:46], "big")
        plain.append(s[:4] + b"\x80" + s[5:42] + s[46 + size :])
    assert [d.payload for d in L.decode(plain)] == data


def bits(*fields):
    """Fields (value, bits) as bytes, filled up with zeros."""
    text = "".join(format(v & ((1 << n) - 1), f"0{n}b") for v, n in fields)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def slow_crc(data, poly, width):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (width - 1) else c << 1) & ((1 << width) - 1)
    return c


def test_escapes_and_five_bit_parameters_by_hand():
    """A frame put together field by field: order 1, two partitions, the first raw, the second of a 5-bit parameter."""
    x = [5, 9, -3, 40, 41, 40, 44, 30, 29, 31, 35, 20, 25, 25, 26, 20]
    e = [b - a for a, b in zip(x, x[1:])]
    head = bytes([0xFF, 0xF8, 0x64, 0x02, 0x00, 15])
    head += bytes([slow_crc(head, 0x07, 8)])
    fields = [(9 << 1, 8), (x[0], 8), (1, 2), (1, 4), (31, 5), (7, 5)] + [(v, 7) for v in e[:7]] + [(2, 5)]
    for v in e[7:]:
        u = 2 * v if v >= 0 else -2 * v - 1
        fields += [(1, (u >> 2) + 1), (u, 2)]
    frame = head + bits(*fields)
    frame += slow_crc(frame, 0x8005, 16).to_bytes(2, "big")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 16).to_bytes(8, "big") + hashlib.md5(bytes(v & 0xFF for v in x)).digest()
    stream = b"fLaC\x80\x00\x00\x22" + info + frame
    d = L.decode([stream])[0]
    assert d.error is None and [v - 128 for v in d.payload] == x


def test_faults_are_told_and_blocks_before_them_stay():
    p = shapes()[3]
    s = L.encode([p])[0]
    d = L.decode([s])[0]
    third = d.offset[2] + 40
    harmed = s[:third] + bytes([s[third] ^ 1]) + s[third + 1 :]
    got = L.decode([harmed, s[:-5], b"", None, b"RIFFxxxx", s[:30], s])
    assert got[0].error and got[0].payload == p[: 2 * L.BLOCK]
    assert got[1].error and p.startswith(got[1].payload)
    assert all(g.error and not g.pcm for g in got[2:6]) and got[6].payload == p
    rng = random.Random(1)
    for _ in range(60):
        at = rng.randrange(42, len(s))
        g = L.decode([s[:at] + bytes([s[at] ^ 1 << rng.randrange(8)]) + s[at + 1 :]])[0]
        assert g.error or g.payload == p  # a seek point may be harmed and the stream still read in order


def rows():
    rng = random.Random(6)
    texts = [None, "", " ", "a", "é" * 96, "x" * 192, "x" * 193, "Ein Text.\n" * 200, "long " * 120_000, "same", "same"]
    texts += [" ".join(rng.choice(["ab", "cé", "ddd"]) for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    return [(i if i != 5 else None, t) for i, t in enumerate(texts)]


def test_digests(spark):
    data = rows()
    got = L.media_digests(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    want = []
    for i, t in data:
        raw = (t or "").encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert {r.error for r in got} == {None} and len({(r.media_sha256, r.feature, r.media_bytes) for r in got if r.doc_id in (9, 10)}) == 1
    media = {r.doc_id: r.media for r in L.to_media(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest() and r.media_bytes == len(media[r.doc_id]) for r in got)


def test_blocks_join_up(spark):
    data = [(i, t) for i, t in rows() if i is not None]
    blocks = L.pcm_blocks(L.to_media(spark.createDataFrame(data, SCHEMA).repartition(2)))
    seen = {}
    for b in blocks.orderBy("doc_id", "block").collect():
        assert b.error is None and b.first_sample == len(seen.get(b.doc_id, b"")) and b.n_samples == len(b.pcm)
        seen[b.doc_id] = seen.get(b.doc_id, b"") + b.pcm
    assert seen == {i: L.padded((t or "").encode()) for i, t in data}


def test_odd_tables(spark):
    assert L.media_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    assert L.media_digests(spark.createDataFrame([(None, None)] * 2, SCHEMA)).select("payload_bytes").collect() == [(192,), (192,)]
    clash = spark.createDataFrame([(1, "a"), (1, "b")], SCHEMA).withColumn("error", F.lit("x")).withColumn("n_bytes", F.lit(7))
    assert sorted(r.n_bytes for r in L.media_digests(clash).collect()) == [1, 1]
    assert L.to_media(clash).columns == ["doc_id", "error", "n_bytes", "media"]
    with pytest.raises(ValueError):
        L.to_media(clash.withColumn("media", F.lit(1)))
    bad = spark.createDataFrame([(1, b"no"), (2, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.block, r.pcm, bool(r.error)) for r in L.pcm_blocks(bad).orderBy("doc_id").collect()] == [(1, 0, None, True), (2, 0, None, True)]
