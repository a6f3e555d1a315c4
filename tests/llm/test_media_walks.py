"""Walks over the structure of media: as before on any bytes, and in time that grows with the bytes."""

import random
import struct
import time
import zlib

import pytest

from verbatlas.llm.media import Blob, flac_length, gif_length, ogg_length, png_length, riff_length, sniff


def gif(b, at):
    if at + 13 > len(b):
        return 0
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 <= len(b):
            p += 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0)
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def riff(b, at, form, needed):
    if at + 12 > len(b) or b[at + 8 : at + 12] != form:
        return 0
    end, p, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, []
    while p + 8 <= end <= len(b):
        n = struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            break
        seen.append(b[p : p + 4])
        p += 8 + n + (n & 1)
    return end - at if end <= len(b) and all(any(s.startswith(x) for s in seen) for x in needed) else 0


def ogg(b, at):
    p = at
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS":
        n = b[p + 26]
        if p + 27 + n > len(b):
            return 0
        last, p = b[p + 5] & 4, p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if last:
            return p - at if p <= len(b) else 0
    return 0


def flac(b, at):
    p = at + 4
    while p + 4 <= len(b):
        last, n = b[p] & 0x80, int.from_bytes(b[p + 1 : p + 4], "big")
        if p == at + 4 and (b[p] & 0x7F or n != 34):
            return 0
        p += 4 + n
        if last:
            return len(b) - at if p <= len(b) else 0
    return 0


def test_walks_that_share_equal_walks_apart():
    rng, valid = random.Random(1), 0
    for _ in range(3000):
        gifs = b"".join(rng.choice([b"GIF89a", b"\x21\xf9", b"\x2c", bytes([rng.randrange(4)]), b"\x3b", b"\0", b"\x80", bytes(rng.randrange(12))]) for _ in range(rng.randrange(40)))
        blob = Blob(gifs)
        for at in rng.sample(range(len(gifs) + 1), len(gifs) + 1):
            assert gif_length(blob, at) == gif(gifs, at)
            valid += gif(gifs, at) > 0
        body = b"".join(rng.choice([b"RIFF", b"WAVE", b"fmt ", b"data", b"VP8L", struct.pack("<I", rng.randrange(40)), b"\0" * rng.randrange(5)]) for _ in range(rng.randrange(30)))
        blob = Blob(body)
        for at in range(len(body)):
            assert riff_length(blob, at, b"WAVE", (b"fmt ", b"data")) == riff(body, at, b"WAVE", (b"fmt ", b"data"))
            assert riff_length(blob, at, body[at + 8 : at + 12], (b"VP8",)) == riff(body, at, body[at + 8 : at + 12], (b"VP8",))
        pages = b"".join(b"OggS\0" + bytes([rng.choice([0, 0, 4])]) + bytes(20) + bytes([2, rng.randrange(3), 1]) + bytes(rng.randrange(1, 4)) for _ in range(rng.randrange(6)))
        blocks = b"".join(rng.choice([b"fLaC\0\0\0\x22" + bytes(34), b"\x84\0\0\x03abc", b"\x04\0\0\x01a"]) for _ in range(rng.randrange(6)))
        for b in (pages, blocks):
            blob = Blob(b)
            for at in range(len(b)):
                assert ogg_length(blob, at) == ogg(b, at)
                assert flac_length(blob, at) == flac(b, at)
                valid += ogg(b, at) > 0 or flac(b, at) > 0
    assert valid > 5000


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def test_png():
    whole = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x" * 9) + chunk(b"IEND", b"")
    assert png_length(Blob(b"ab" + whole + b"cd"), 2) == len(whole) and png_length(Blob(whole[:-1]), 0) == 0
    assert png_length(Blob(whole.replace(b"IDATx", b"IDATy")), 0) == 0 and png_length(Blob(whole.replace(b"IHDR", b"IHDX")), 0) == 0


@pytest.mark.parametrize("piece", [b"GIF89aAAAAAAA!A", b"GIF89a" + b"\x01" * 20, b"RIFF\xff\xff\0\0WAVEfmt \0\0\0\0", b"RIFF\x08\0\0\0WEBP", b"OggS" + bytes(22) + b"\0", b"fLaC\0\0\0\x22" + bytes(34), b"%PDF-x", b"PK\x03\x04", b"BM12345678", b"\xff\xd8\xff\xe0\0\x02", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13))])
def test_time_grows_with_the_bytes(piece):
    def took(size):
        start = time.perf_counter()
        sniff(piece * (size // len(piece)))
        return time.perf_counter() - start

    took(10_000)
    small, large = took(500_000), took(4_000_000)
    assert large < 40 * max(0.02, small)
