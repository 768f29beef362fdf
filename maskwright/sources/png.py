"""Images as RGBA arrays: reading and writing 8-bit RGB and RGBA PNG files that aren't interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"


def decode_png(raw: bytes) -> np.ndarray:
    """height x width x 4 array of bytes."""
    if raw[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    width, height, depth, colour, _, _, laced = head
    if depth != 8 or colour not in (2, 6) or laced:
        raise ValueError("only 8-bit RGB and RGBA without interlacing")
    bpp = 3 if colour == 2 else 4
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * bpp)
    out = np.zeros((height, width * bpp), np.uint8)
    above = np.zeros(width * bpp, np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, bpp)
    pixels = out.reshape(height, width, bpp)
    return pixels if bpp == 4 else np.dstack([pixels, np.full((height, width), 255, np.uint8)])


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, bpp).astype(np.int64), axis=0).astype(np.uint8).ravel()
    out = [0] * len(line)
    up = above.tolist()
    for i, v in enumerate(line.tolist()):
        a, b, c = (out[i - bpp] if i >= bpp else 0), up[i], (up[i - bpp] if i >= bpp else 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((a, b, c), key=lambda x: abs(p - x))
        out[i] = (v + guess) & 255
    return np.array(out, np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, bpp = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, width * bpp)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if bpp == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
