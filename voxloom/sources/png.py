"""A small PNG codec: 8- and 16-bit grey, RGB and RGBA, without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """(H, W) or (H, W, C), uint8 or uint16; a damaged file is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], None
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("the PNG file has no header")
    width, height, depth, colour, _, _, interlace = head
    if depth not in (8, 16) or colour not in CHANNELS or interlace:
        raise ValueError("only 8- and 16-bit grey, RGB and RGBA without interlacing")
    pixel = CHANNELS[colour] * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != height * (1 + width * pixel):
        raise ValueError("the PNG file is cut short")
    rows = _unfilter(raw.reshape(height, 1 + width * pixel), pixel)
    values = rows.reshape(height, width, CHANNELS[colour], depth // 8)
    image = values[..., 0] if depth == 8 else (values[..., 0].astype(np.uint16) << 8) | values[..., 1]
    return image[..., 0] if CHANNELS[colour] == 1 else image


def _unfilter(rows: np.ndarray, pixel: int) -> np.ndarray:
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    above = np.zeros(rows.shape[1] - 1, np.uint8)
    for k, row in enumerate(rows):
        kind, line = row[0], row[1:].copy()
        if kind == 1:  # each byte adds the pixel before: a running sum by channel
            line = np.cumsum(line.reshape(-1, pixel), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            before, old, new = [0] * pixel, above.tolist(), line.tolist()
            for j in range(len(new)):
                left = new[j - pixel] if j >= pixel else before[j]
                if kind == 3:
                    guess = (left + old[j]) // 2
                else:
                    corner = old[j - pixel] if j >= pixel else 0
                    near = left + old[j] - corner
                    ways = ((abs(near - left), 0, left), (abs(near - old[j]), 1, old[j]), (abs(near - corner), 2, corner))
                    guess = min(ways)[2]
                new[j] = (new[j] + guess) & 255
            line = np.array(new, np.uint8)
        elif kind:
            raise ValueError("an unknown PNG filter")
        out[k] = above = line
    return out


def encode_png(image: np.ndarray) -> bytes:
    """The PNG of an array as ``decode_png`` returns."""
    if image.dtype not in (np.uint8, np.uint16):
        raise ValueError("an image is uint8 or uint16")
    channels = 1 if image.ndim == 2 else image.shape[2]
    colour = {n: c for c, n in CHANNELS.items()}[channels]
    height, width = image.shape[:2]
    rows = image.astype(">u2").view(np.uint8) if image.dtype == np.uint16 else image
    rows = np.ascontiguousarray(rows).reshape(height, -1)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows], 1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, image.dtype.itemsize * 8, colour, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def rgb_only(image: np.ndarray) -> np.ndarray:
    """Drops an alpha channel."""
    return image[:, :, :3] if image.ndim == 3 and image.shape[2] == 4 else image
