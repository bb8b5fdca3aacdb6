"""Media columns: baseline JPEG, encoded and decoded in numpy.

``decode_dc`` parses markers, splits scans at restart markers, Huffman-decodes the entropy-coded segments
of many images side by side and rebuilds the luminance thumbnail of one sample per 8x8 block from the
DC coefficients. ``encode_payload`` stores bytes without loss in that form: every byte is a block of one
grey level, with DC quantiser 8, so the thumbnail is the payload. Each block takes 16 bits (Huffman code,
magnitude, end of block), rows of 64 blocks end with a restart marker.

Defined cases: a null text is the empty text, whose payload is 64 zero bytes; payloads longer than one
image holds (65,535 pixels a side) become several images one after the other; equal texts have equal media
and features; a blob without an image decodes to no planes, a damaged one raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored

ROW = 64
MAX_ROWS, MAX_WIDE = 8191, 127  # rows of blocks, and times 64 blocks a row, in 65,535 pixels

#: Huffman lengths of the DC categories 0 to 8: with the magnitude bits and a one-bit end of block, 16 bits.
DC_LENGTHS = {s: 15 - s for s in range(9)}


def canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table given as JPEG stores it."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


_BY_LENGTH = sorted(DC_LENGTHS, key=lambda s: DC_LENGTHS[s])
_DC_COUNTS = [sum(n == length for n in DC_LENGTHS.values()) for length in range(1, 17)]
_DC_CODES = {s: (code, length) for s, code, length in canonical(_DC_COUNTS, _BY_LENGTH)}


def _code_of_difference() -> np.ndarray:
    """The 16 bits of a block for DC differences -255 to 255, big-endian."""
    out = []
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = _DC_CODES[s][0] << s | (d if d >= 0 else d + (1 << s) - 1)
        out.append(code << 1)  # the end of block is one bit, zero
    return np.array(out, ">u2")


_CODES = _code_of_difference()


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


_TABLES = (
    _segment(0xDB, bytes([0]) + bytes([8]) * 64)
    + _segment(0xC4, bytes([0x00, *_DC_COUNTS, *_BY_LENGTH]))
    + _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))
    + _segment(0xDD, struct.pack(">H", ROW))
)
_SCAN = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % ROW if data else ROW)


def encode_payload(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as grey baseline JPEG, or several in a row."""
    out = []
    for at in range(0, len(payload), MAX_ROWS * MAX_WIDE * ROW):
        part = payload[at : at + MAX_ROWS * MAX_WIDE * ROW]
        rows = len(part) // ROW
        wide = -(-rows // MAX_ROWS)
        high = -(-rows // wide)
        samples = np.zeros((high * wide, ROW), np.int16)
        samples[:rows] = np.frombuffer(part, np.uint8).reshape(rows, ROW)
        samples -= 128
        samples[:, 1:] -= samples[:, :-1].copy()
        coded = np.empty((high * wide, 2 * ROW + 2), np.uint8)
        coded[:, : 2 * ROW] = _CODES[samples + 255].view(np.uint8).reshape(-1, 2 * ROW)
        coded[:, -2] = 0xFF
        coded[:, -1] = 0xD0 + np.arange(high * wide) % 8
        frame = struct.pack(">BHHBBBB", 8, 8 * high, 8 * ROW * wide, 1, 1, 0x11, 0)
        out.append(b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(part)) + _TABLES + _segment(0xC0, frame) + _SCAN + coded.tobytes()[:-2] + b"\xff\xd9")
    return b"".join(out)


class Image:
    """What the markers of one image say."""

    def __init__(self) -> None:
        self.width = self.height = self.interval = 0
        self.comment = b""
        self.parts: list[tuple[int, int, int, int]] = []  # id, horizontal, vertical factor, quantiser
        self.scan: list[tuple[int, int, int]] = []  # of a component: its place, DC table, AC table
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        self.data = b""


def parse(blob: bytes) -> list[Image]:
    """The baseline images that lie one after the other in a blob."""
    images: list[Image] = []
    at = 0
    while (at := blob.find(b"\xff\xd8", at)) >= 0:
        image, at = Image(), at + 2
        while True:
            while at < len(blob) and blob[at] == 0xFF and at + 1 < len(blob) and blob[at + 1] == 0xFF:
                at += 1
            if at + 4 > len(blob) or blob[at] != 0xFF:
                raise ValueError("no marker where one must be")
            kind = blob[at + 1]
            if kind == 0xD9:
                raise ValueError("an image without a scan")
            (size,) = struct.unpack_from(">H", blob, at + 2)
            body, at = blob[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1")
                    body = body[1 + n :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    image.huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xDD:
                (image.interval,) = struct.unpack(">H", body)
            elif kind == 0xFE:
                image.comment = body
            elif kind in (0xC0, 0xC1):
                depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("samples aren't of 8 bits")
                image.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif kind == 0xDA:
                ids = [p[0] for p in image.parts]
                image.scan = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                end = at
                while (end := blob.find(b"\xff", end)) >= 0 and end + 1 < len(blob) and (blob[end + 1] == 0 or 0xD0 <= blob[end + 1] <= 0xD7):
                    end += 2
                end = len(blob) if end < 0 else end
                image.data, at = blob[at:end], end
                break
        images.append(image)
    return images


def _segments(data: bytes) -> list[bytes]:
    """Entropy-coded segments between restart markers, without stuffed zeros."""
    raw = np.frombuffer(data, np.uint8)
    mark = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
    restarts = mark[(raw[mark + 1] >= 0xD0) & (raw[mark + 1] <= 0xD7)]
    bounds = zip([0, *(restarts + 2).tolist()], [*restarts.tolist(), len(data)])
    return [x.replace(b"\xff\x00", b"\xff") if b"\xff" in x else x for x in (data[a:b] for a, b in bounds)]


def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """By the next 16 bits: length << 8 | symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, code, length in canonical(list(table[0]), list(table[1])):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    half = np.where(size > 0, 1 << np.maximum(size - 1, 0), 0)
    return np.where(bits < half, bits - (1 << size) + 1, bits)


def _whole_blocks(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """By the next 16 bits, if they hold a whole block without AC coefficients: length << 16 | difference
    + 32768; otherwise 0."""
    code = np.arange(1 << 16)
    length, size = dc >> 8, dc & 255
    used = length + size
    fits = (length > 0) & (used < 16)
    size, shown = np.where(fits, size, 0), np.where(fits, used, 0)
    value = _extend((code >> (16 - shown)) & ((1 << size) - 1), size)
    rest = (code << shown) & 0xFFFF
    end = ac[rest]
    whole = fits & (end > 0) & (end & 255 == 0) & (shown + (end >> 8) <= 16)
    return np.where(whole, (shown + (end >> 8)) << 16 | (value + 32768), 0)


def decode_dc(blobs: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """For each blob its images with the luminance thumbnail, one unsigned byte per 8x8 block."""
    parsed = [parse(b) for b in blobs]
    tables: dict[tuple, int] = {}
    lanes: list[tuple[bytes, int, int, int]] = []  # bytes, layout, blocks, place of its blocks
    plans: list[tuple[Image, int, int]] = []
    layouts: dict[tuple, int] = {}
    total = 0
    for images in parsed:
        for image in images:
            scan = image.scan
            single = len(scan) == 1
            most_h, most_v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
            unit = [] if not single else [0]
            if not single:
                for k, (place, _, _) in enumerate(scan):
                    unit += [k] * (image.parts[place][1] * image.parts[place][2])
            pairs = []
            for _, d, a in scan:
                pair = (image.huffman[d], image.huffman[16 + a])
                pairs.append(tables.setdefault(pair, len(tables)))
            layout = layouts.setdefault((tuple(unit), tuple(pairs)), len(layouts))
            if single:
                place = scan[0][0]
                h, v = image.parts[place][1:3]
                across, down = -(-image.width * h // (8 * most_h)), -(-image.height * v // (8 * most_v))
            else:
                across, down = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
            units = across * down
            plans.append((image, total, across))
            step = image.interval or units
            segments = _segments(image.data)
            if len(segments) != -(-units // step):
                raise ValueError("restart markers are missing")
            for k, segment in enumerate(segments):
                n = min(step, units - k * step) * len(unit)
                lanes.append((segment, layout, n, total + k * step * len(unit)))
            total += units * len(unit)
    levels = _decode_lanes(lanes, list(layouts), list(tables), total)
    out, k = [], 0
    for images in parsed:
        own = []
        for image in images:
            image, at, across = plans[k]
            k += 1
            own.append((image, _plane(image, levels[at:], across)))
        out.append(own)
    return out


def _plane(image: Image, levels: np.ndarray, across: int) -> np.ndarray:
    """The luminance blocks in raster order, scaled to grey levels."""
    place = image.scan[0][0]
    h, v = (1, 1) if len(image.scan) == 1 else image.parts[place][1:3]
    per = 1 if len(image.scan) == 1 else sum(image.parts[p][1] * image.parts[p][2] for p, _, _ in image.scan)
    most_h, most_v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    wide, high = -(-image.width * image.parts[place][1] // (8 * most_h)), -(-image.height * image.parts[place][2] // (8 * most_v))
    down = -(-high // v)
    grid = levels[: across * down * per].reshape(down, across, per)[:, :, : h * v].reshape(down, across, v, h)
    grid = grid.transpose(0, 2, 1, 3).reshape(down * v, across * h)[:high, :wide]
    scale = int(image.quant[image.parts[place][3]][0])
    return np.clip(np.floor_divide(grid * scale + 4, 8) + 128, 0, 255).astype(np.uint8)


def _decode_lanes(lanes: list, layouts: list, tables: list, total: int) -> np.ndarray:
    """DC coefficients of all blocks. A lane is the bits between two restart markers; all lanes advance
    together, a whole block at a time where a lookup of 16 bits holds one, or else symbol by symbol."""
    out = np.zeros(total, np.int32)
    if not lanes:
        return out
    buffer = np.frombuffer(b"".join(x[0] + bytes(6) for x in lanes), np.uint8).astype(np.uint32)
    words = buffer[:-2] << np.uint32(16) | buffer[1:-1] << np.uint32(8) | buffer[2:]
    size = np.fromiter((len(x[0]) for x in lanes), np.int64, len(lanes))
    start = 8 * (np.cumsum(size + 6) - size - 6)
    pos, end = start.copy(), start + 8 * size
    layout = np.array([x[1] for x in lanes])
    left = np.array([x[2] for x in lanes])
    place = np.array([x[3] for x in lanes])
    dc = np.stack([_lookup(t[0]) for t in tables])
    ac = np.stack([_lookup(t[1]) for t in tables])
    whole = np.stack([_whole_blocks(d, a) for d, a in zip(dc, ac)])
    units = max(len(u) for u, _ in layouts)
    component = np.zeros((len(layouts), units), np.int64)
    table = np.zeros((len(layouts), units), np.int64)
    length = np.array([len(u) for u, _ in layouts])
    for k, (unit, pairs) in enumerate(layouts):
        component[k, : len(unit)] = unit
        table[k, : len(unit)] = [pairs[c] for c in unit]
    n = len(lanes)
    level = np.zeros((n, int(component.max()) + 1), np.int64)
    inside, coefficient = np.zeros(n, np.int64), np.zeros(n, np.int64)
    lane = np.flatnonzero(left > 0)
    simple = units == 1 and len(tables) == 1

    def peek(p: np.ndarray) -> np.ndarray:
        return (words[p >> 3] >> (8 - (p & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    if simple:  # one component and one pair of tables: most blocks are read whole
        at, p, prev = place[lane], pos[lane], np.zeros(len(lane), np.int64)
        todo = left[lane]
        alive = np.arange(len(lane))
        while len(alive):
            got = whole[0][peek(p[alive])]
            if not got.all():
                break  # go on symbol by symbol
            prev[alive] += (got & 0xFFFF) - 32768
            p[alive] += got >> 16
            out[at[alive]] = prev[alive]
            at[alive] += 1
            todo[alive] -= 1
            if (todo[alive] == 0).any():
                alive = alive[todo[alive] > 0]
        place[lane], pos[lane], level[lane, 0], left[lane] = at, p, prev, todo
        lane = lane[todo > 0]
    while len(lane):
        t = table[layout[lane], inside[lane]]
        code = peek(pos[lane])
        first = coefficient[lane] == 0
        got = np.where(first, dc[t, code], ac[t, code])
        if (got == 0).any():
            raise ValueError("bits that are no Huffman code")
        symbol = got & 255
        pos[lane] += got >> 8
        bits = np.where(first, symbol, symbol & 15)
        value = _extend((peek(pos[lane]) >> (16 - bits)) & ((1 << bits) - 1), bits)
        pos[lane] += bits
        if (pos[lane] > end[lane]).any():
            raise ValueError("a scan ends too early")
        c = component[layout[lane], inside[lane]]
        opened = lane[first]
        level[opened, c[first]] += value[first]
        out[place[opened]] = level[opened, c[first]]
        ends = ~first & (symbol == 0)
        coefficient[lane] = np.where(first, 1, np.where(ends, 64, coefficient[lane] + (symbol >> 4) + 1))
        done = lane[coefficient[lane] > 63]
        if len(done):
            coefficient[done] = 0
            place[done] += 1
            left[done] -= 1
            inside[done] = (inside[done] + 1) % length[layout[done]]
            lane = lane[left[lane] > 0]
    if (pos > end).any():
        raise ValueError("a scan ends too early")
    return out


def thumbnail_hash(plane: np.ndarray) -> str:
    """Average hash: which of 8x8 areas of the thumbnail are brighter than their mean."""
    if not plane.size:
        return "0" * 16
    rows, columns = (np.arange(8) * n // 8 for n in plane.shape)
    sums = np.add.reduceat(np.add.reduceat(plane.astype(np.int64), rows, axis=0), columns, axis=1)
    area = np.outer(*(np.maximum(np.diff([*x, n]), 1) for x, n in zip((rows, columns), plane.shape)))
    mean = sums / area
    return np.packbits((mean > mean.mean()).ravel()).tobytes().hex()


def stored_payload(images: list[tuple[Image, np.ndarray]]) -> bytes:
    """The payload that ``encode_payload`` put in a blob's images."""
    return b"".join(plane.tobytes()[: int(image.comment.split()[-1])] for image, plane in images)


def encode_media(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id, n_bytes, media."""

    def step(c: dict[str, list]) -> dict[str, list]:
        data = [(t or "").encode() for t in c["text"]]
        return {"doc_id": c["doc_id"], "n_bytes": [len(x) for x in data], "media": [encode_payload(pad(x)) for x in data]}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, n_bytes long, media binary", rows=500)


def media_features(media: DataFrame) -> DataFrame:
    """``media(doc_id, n_bytes, media)`` → digests of payload and stored form, and the feature
    ``width x height : thumbnail hash`` (of the first image, with the number of images if there are more)."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def step(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for blob, images in zip(c["media"], decode_dc(c["media"])):
            payload = stored_payload(images)
            image, plane = images[0]
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-ROW:]))
            out["media_bytes"].append(len(blob))
            out["media_sha256"].append(hashlib.sha256(blob).hexdigest())
            more = f"+{len(images) - 1}" if len(images) > 1 else ""
            out["feature"].append(f"{image.width}x{image.height}{more}:{thumbnail_hash(plane)}")
        return {"doc_id": c["doc_id"], "n_bytes": c["n_bytes"]} | out

    return map_arrow(media, step, schema, rows=500)


def media_table(docs: DataFrame) -> DataFrame:
    """The texts stored as a media column, read back, with the features of the stored images."""
    return media_features(stored(encode_media(docs), "media"))
