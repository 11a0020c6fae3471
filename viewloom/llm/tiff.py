"""Baseline TIFF, written and read: image directories, strips and tiles, PackBits, LZW and deflate, predictor 2."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values of the TIFF 6.0 format: tags, field types (size and struct letter), compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION = 256, 257, 258, 259, 262, 270
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i")}
CODECS = {"none": 1, "lzw": 5, "deflate": 8, "old_deflate": 32946, "packbits": 32773}
NAMES = {v: k for k, v in CODECS.items()}

#: The most bytes that a byte of a block can stand for.
EXPANSION = {"none": 1, "packbits": 64, "lzw": 3640, "deflate": 1032, "old_deflate": 1032}

CLEAR, EOI, FIRST = 256, 257, 258
RUN = re.compile(rb"(.)\1{2,127}", re.S)


class TiffError(ValueError):
    pass


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            piece = part[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in RUN.finditer(data):
        literal(data[at : m.start()])
        out.append(257 - len(m[0]))
        out.extend(m[1])
        at = m.end()
    literal(data[at:])
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _widths(places: np.ndarray) -> np.ndarray:
    """Bits of the codes that stand so many codes after a clear code: 9 to 12, one code early, as TIFF has it."""
    return 9 + (places >= 254).astype(np.int64) + (places >= 766) + (places >= 1790)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first."""
    codes, table, after = [CLEAR], {}, FIRST
    put, known = codes.append, table.get
    word = data[0] if data else None
    for byte in data[1:]:
        longer = word << 8 | byte
        code = known(longer)
        if code is not None:
            word = code
            continue
        put(word)
        table[longer] = after
        after += 1
        if after == 4094:
            put(CLEAR)
            table, after = {}, FIRST
            known = table.get
        word = byte
    if data:
        put(word)
    put(EOI)
    every = np.array(codes, np.uint16)
    clears = np.flatnonzero(every == CLEAR)
    steps = np.arange(len(every))
    widths = _widths(steps - clears[np.searchsorted(clears, steps) - 1] - 1)
    widths[0] = 9
    bits = np.unpackbits(every.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16) >= 16 - widths[:, None]]).tobytes()


#: Codes that are read at a time; no table is fuller.
RUN_CODES = 4096
_RUN_WIDTHS = _widths(np.arange(RUN_CODES))
_RUN_STARTS = np.concatenate(([0], np.cumsum(_RUN_WIDTHS)[:-1]))
_FRESH = [bytes([i]) for i in range(256)] + [b"", b""]


def unlzw(data: bytes, size: int) -> bytes:
    """Runs of codes up to the next clear code are cut out together; their widths follow from their places."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    raw = np.concatenate((raw, np.zeros(3, np.int64)))
    out, made, at, end = [], 0, 0, 8 * len(data)
    while made < size:
        starts = at + _RUN_STARTS
        n = int(np.searchsorted(starts + _RUN_WIDTHS, end, "right"))
        starts, widths = starts[:n], _RUN_WIDTHS[:n]
        byte = starts >> 3
        codes = ((raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (starts & 7) - widths)) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == EOI))
        stop = int(stops[0]) if len(stops) else n
        table, last = _FRESH.copy(), b""
        add, known = table.append, len(_FRESH)
        for code in codes[:stop].tolist():
            if code < known:
                word = table[code]
            elif code == known and last:
                word = last + last[:1]
            else:
                raise TiffError(f"LZW code {code} comes too early")
            if last:
                add(last + word[:1])
                known += 1
            out.append(word)
            last = word
        made += sum(map(len, out[-stop:])) if stop else 0
        if stop == n or codes[stop] == EOI:
            break
        at = int(starts[stop] + widths[stop])
    return b"".join(out)


def _squeeze(data: bytes, codec: str) -> bytes:
    if codec == "deflate":
        return zlib.compress(data, 1)
    return {"none": bytes, "lzw": lzw, "packbits": pack_bits}[codec](data)


def _expand(data: bytes, scheme: int, size: int) -> bytes:
    codec = NAMES.get(scheme)
    if codec is None:
        raise TiffError(f"compression {scheme} is not supported")
    if codec.endswith("deflate"):
        return zlib.decompressobj().decompress(data, size)
    if codec == "none":
        return data
    return (unlzw if codec == "lzw" else unpack_bits)(data, size)


def _difference(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def write_tiff(pages: list[np.ndarray], codec: str = "deflate", predictor: bool = True, tile: int = 0, rows: int = 64, description: str = "") -> bytes:
    """A little-endian file; `pages` are (height, width, samples) arrays of 8-bit or 16-bit samples; tile: side of square tiles, 0 for strips."""
    predictor = predictor and codec in ("lzw", "deflate")
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width, samples = page.shape
        page = page.astype(page.dtype.newbyteorder("<"), copy=False)
        blocks = []
        if tile:
            for top in range(0, height, tile):
                for left in range(0, width, tile):
                    block = np.zeros((tile, tile, samples), page.dtype)
                    part = page[top : top + tile, left : left + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[top : top + rows] for top in range(0, height, rows)]
        offsets, counts = [], []
        for block in blocks:
            data = _squeeze((_difference(block) if predictor else block).tobytes(), codec)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields: list[tuple[int, int, list[int] | bytes]] = [
            (WIDTH, 4, [width]),
            (HEIGHT, 4, [height]),
            (BITS, 3, [page.dtype.itemsize * 8] * samples),
            (COMPRESSION, 3, [CODECS[codec]]),
            (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]),
            (SAMPLES, 3, [samples]),
            (PLANAR, 3, [1]),
            (PREDICTOR, 3, [2 if predictor else 1]),
        ]
        if description:
            fields.append((DESCRIPTION, 2, description.encode("ascii") + b"\0"))
        if tile:
            fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            fields += [(ROWS_PER_STRIP, 4, [rows]), (STRIP_OFFSETS, 4, offsets), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(fields, key=lambda f: f[0]):
            data = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{TYPES[kind][1]}", *values)
            if len(data) > 4:
                where = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    number: int
    pixels: np.ndarray
    codec: str
    predictor: int
    layout: str
    description: str


#: A page may have so many bytes of pixels at most; larger ones are an error, as a task holds a page.
MOST_BYTES = 1 << 30


def read_tiff(data: bytes) -> Iterator[Page]:
    """The pages of a file, one at a time. TiffError says what is not valid or not supported."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise TiffError("no TIFF header")
    at, seen, number = struct.unpack(order + "I", data[4:8])[0], set(), 0
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("the chain of image directories is broken")
        seen.add(at)
        fields, at = _directory(data, order, at)
        yield _page(data, order, fields, number)
        number += 1


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple | bytes], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    fields: dict[int, tuple | bytes] = {}
    try:
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if kind not in TYPES:
                continue
            size, letter = TYPES[kind]
            where = entry + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            fields[tag] = data[where : where + count] if kind == 2 else struct.unpack_from(f"{order}{count}{letter}", data, where)
        return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error as e:
        raise TiffError("an image directory is cut off") from e


def _page(data: bytes, order: str, fields: dict, number: int) -> Page:
    one = lambda tag, default=None: fields[tag][0] if fields.get(tag) else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, scheme, predictor, planar = fields.get(BITS, (1,)), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if not all(isinstance(v, int) for v in (samples, scheme, predictor, planar)):
        raise TiffError(f"page {number}: a tag has a type that it may not have")
    if not isinstance(width, int) or not isinstance(height, int) or width < 1 or height < 1 or set(bits) - {8, 16} or len(set(bits)) != 1 or predictor not in (1, 2):
        raise TiffError(f"page {number}: {width} x {height} of {bits} bits with predictor {predictor} is not supported")
    dtype = np.dtype(f"{order}u{bits[0] // 8}")
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    tiled = TILE_OFFSETS in fields
    if tiled:
        block_w, block_h = one(TILE_WIDTH), one(TILE_HEIGHT)
        offsets, counts = fields[TILE_OFFSETS], fields.get(TILE_COUNTS, ())
    else:
        block_w, block_h = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = fields.get(STRIP_OFFSETS, ()), fields.get(STRIP_COUNTS, ())
    if not isinstance(block_w, int) or not isinstance(block_h, int) or block_w < 1 or block_h < 1 or not 1 <= samples <= 64 or scheme not in NAMES:
        raise TiffError(f"page {number}: blocks of {block_w} x {block_h} with {samples} samples in compression {scheme} are not supported")
    across, down = -(-width // block_w), -(-height // block_h)
    if len(offsets) != planes * across * down or len(counts) != len(offsets):
        raise TiffError(f"page {number}: {len(offsets)} blocks are there, {planes * across * down} are needed")
    held = sum(max(0, min(count, len(data) - offset)) for offset, count in zip(offsets, counts, strict=True))
    claimed = height * width * samples * dtype.itemsize
    if claimed > MOST_BYTES:
        raise TiffError(f"page {number}: {claimed} bytes of pixels are claimed, more than {MOST_BYTES}")
    if claimed > held * EXPANSION[NAMES[scheme]] or (tiled and block_w * block_h > 4 * max(width, 64) * max(height, 64)):
        raise TiffError(f"page {number}: {claimed} bytes of pixels are claimed, its blocks have {held}")
    pixels = np.zeros((height, width, samples), dtype)
    for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, cell = divmod(k, across * down)
        top, left = cell // across * block_h, cell % across * block_w
        tall = block_h if tiled else min(block_h, height - top)
        size = tall * block_w * depth * dtype.itemsize
        raw = _expand(data[offset : offset + count], scheme, size)
        if len(raw) < size:
            raise TiffError(f"page {number}: a block has {len(raw)} bytes, {size} are needed")
        block = np.frombuffer(raw[:size], dtype).reshape(tall, block_w, depth)
        if predictor == 2:
            block = np.add.accumulate(block, axis=1, dtype=dtype)
        part = block[: height - top, : width - left]
        where = slice(plane, plane + 1) if planar == 2 else slice(None)
        pixels[top : top + part.shape[0], left : left + part.shape[1], where] = part
    text = fields.get(DESCRIPTION, b"")
    return Page(number, pixels, NAMES[scheme], predictor, "tiles" if tiled else "strips", text.rstrip(b"\0").decode("latin-1") if isinstance(text, bytes) else "")
