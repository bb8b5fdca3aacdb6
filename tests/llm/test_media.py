import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from prose_audit.llm import media


def scalar_dc(blob):
    """A plain decoder, bit by bit: DC levels of all blocks in scan order."""
    out = []
    for image in media.parse(blob):
        codes = {k: {(length, code): s for s, code, length in media.canonical(list(v[0]), list(v[1]))} for k, v in image.huffman.items()}
        unit = [0] if len(image.scan) == 1 else [k for k, (p, _, _) in enumerate(image.scan) for _ in range(image.parts[p][1] * image.parts[p][2])]
        own = []
        for segment in media._segments(image.data):
            bits = "".join(f"{b:08b}" for b in segment)
            at, level, k = 0, [0] * 4, 0

            def symbol(table):
                nonlocal at
                for n in range(1, 17):
                    if (n, int(bits[at : at + n], 2)) in table:
                        at += n
                        return table[n, int(bits[at - n : at], 2)]
                raise ValueError

            def number(n):
                nonlocal at
                v = int(bits[at : at + n] or "0", 2) if n else 0
                at += n
                return v if not n or v >> (n - 1) else v - (1 << n) + 1

            while len(bits) - at >= 8 or "0" in bits[at:]:
                c = unit[k % len(unit)]
                level[c] += number(symbol(codes[image.scan[c][1]]))
                own.append(level[c])
                i = 1
                while i < 64:
                    s = symbol(codes[16 + image.scan[c][2]])
                    if s == 0:
                        break
                    number(s & 15)
                    i += (s >> 4) + 1
                k += 1
                if image.interval and k == image.interval * len(unit):
                    break
        out.append(own)
    return out


def colour_image(rng, across, down, interval):
    """A 4:2:0 image with random coefficients, its luminance DC levels in raster order."""
    dc = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
    symbols = [0, 1, 2, 3, 0x11, 0x21, 0xF0, 0x12]
    ac = ([0, 2, 1, 2, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0], symbols)
    code = [{s: (c, n) for s, c, n in media.canonical(*t)} for t in (dc, ac)]
    luma = np.zeros((2 * down, 2 * across), int)
    segments, bits, level = [], "", [0, 0, 0]

    def number(v):
        n = abs(v).bit_length()
        return n, f"{v if v >= 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    for m in range(across * down):
        for b, comp in enumerate([0, 0, 0, 0, 1, 2]):
            new = rng.randrange(-500, 500)
            n, tail = number(new - level[comp])
            level[comp] = new
            c, size = code[0][n]
            bits += f"{c:0{size}b}" + tail
            if b < 4:
                luma[2 * (m // across) + b // 2, 2 * (m % across) + b % 2] = new
            i = 1
            for _ in range(rng.randrange(6)):
                s = rng.choice(symbols[1:])
                if i + (s >> 4) + 1 > 63:
                    break
                c, size = code[1][s]
                bits += f"{c:0{size}b}" + (f"{rng.randrange(1 << (s & 15)):0{s & 15}b}" if s & 15 else "")
                i += (s >> 4) + 1
            c, size = code[1][0]
            bits += f"{c:0{size}b}"
        if m + 1 == across * down or interval and (m + 1) % interval == 0:
            bits += "1" * (-len(bits) % 8)
            segments.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
            bits, level = "", [0, 0, 0]
    body = b"".join(s + bytes([0xFF, 0xD0 + i % 8]) for i, s in enumerate(segments))[:-2]
    blob = b"\xff\xd8" + media._segment(0xE0, b"JFIF\0") + media._segment(0xDB, bytes([0] + [4] * 64))
    blob += media._segment(0xC4, bytes([0, *dc[0], *dc[1]])) + media._segment(0xC4, bytes([16, *ac[0], *ac[1]]))
    blob += media._segment(0xDD, struct.pack(">H", interval)) if interval else b""
    blob += media._segment(0xC0, struct.pack(">BHHB", 8, 16 * down - 3, 16 * across - 9, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    blob += media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + body + b"\xff\xd9"
    return blob, luma


@pytest.mark.parametrize("interval", [0, 2, 5])
def test_colour_images(interval):
    rng = random.Random(interval)
    made = [colour_image(rng, rng.randrange(1, 6), rng.randrange(1, 5), interval) for _ in range(6)]
    got = media.decode_dc([b for b, _ in made])
    for (blob, luma), [(image, plane)] in zip(made, got):
        want = np.clip((luma * 4 + 4) // 8 + 128, 0, 255)
        assert (plane == want[: plane.shape[0], : plane.shape[1]]).all()
        assert plane.shape == (-(-image.height // 8), -(-image.width // 8))


def test_payload_round_trip():
    rng = random.Random(7)
    data = [b"", b"a", bytes(range(256)) * 3, rng.randbytes(64), rng.randbytes(100_000), "été".encode() * 500, rng.randbytes(64 * 8191 + 640)]
    blobs = [media.encode_payload(media.pad(x)) for x in data]
    for x, blob, images in zip(data, blobs, media.decode_dc(blobs)):
        assert media.stored_payload(images) == media.pad(x)
    for x, blob in zip(data[:4], blobs):
        [levels] = scalar_dc(blob)
        assert bytes(v + 128 for v in levels) == media.pad(x)


def test_several_images(monkeypatch):
    monkeypatch.setattr(media, "MAX_ROWS", 3)
    monkeypatch.setattr(media, "MAX_WIDE", 2)
    data = random.Random(1).randbytes(64 * 15)
    [images] = media.decode_dc([media.encode_payload(data)])
    assert len(images) == 3 and media.stored_payload(images) == data


def test_damage():
    blob = media.encode_payload(media.pad(b"some text" * 30))
    with pytest.raises(ValueError):
        media.decode_dc([blob[: len(blob) // 2]])
    assert media.decode_dc([b""]) == [[]]


def test_media_table(spark):
    texts = [None, "", "a", "été" * 30, "x" * 64, "y" * 40_000, "a"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 1)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in media.media_table(df).collect()}
    assert len(rows) == len(texts) + 1
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(media.encode_payload(payload)).hexdigest()
    assert rows[2][1:] == rows[6][1:] == rows[None][1:] and rows[0][1:] == rows[1][1:]
    assert media.media_table(df.limit(0)).count() == 0
