"""PNG and TIFF bytes from an array, in plain Python: results that a client downloads, not bulk output."""

from __future__ import annotations

import struct
import zlib

import numpy as np

NO_DATA = -9999.0


def stretch(values: np.ndarray) -> np.ndarray:
    """0..255 between the least and the largest value; missing ones are 0, and so is all if none is there."""
    ok = np.isfinite(values)
    out = np.zeros(values.shape, np.uint8)
    if ok.any():
        low, high = values[ok].min(), values[ok].max()
        span = max(float(high - low), float(np.finfo(np.float32).eps))
        out[ok] = np.clip(np.rint((values[ok] - low) / span * 255), 0, 255)
    return out


def png(gray: np.ndarray) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows, cols = gray.shape
    lines = b"".join(b"\0" + gray[r].tobytes() for r in range(rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def tiff(values: np.ndarray, transform: tuple[float, ...] = (0, 1, 0, 0, 0, -1), epsg: int = 4326) -> bytes:
    """A one-band float32 GeoTIFF, deflated, with -9999 for missing values."""
    data = np.where(np.isfinite(values), values, NO_DATA).astype("<f4")
    rows, cols = data.shape
    body = zlib.compress(data.tobytes())
    geographic = epsg == 4326
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]
    scale = struct.pack("<3d", abs(transform[1]), abs(transform[5]), 0)
    tie = struct.pack("<6d", 0, 0, 0, transform[0], transform[3], 0)
    tags = [
        (256, 4, 1, cols), (257, 4, 1, rows), (258, 3, 1, 32), (259, 3, 1, 8), (262, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, rows),
        (279, 4, 1, len(body)), (339, 3, 1, 3), (33550, 12, 3, scale), (33922, 12, 6, tie), (34735, 3, len(keys), struct.pack(f"<{len(keys)}H", *keys)),
        (42113, 2, 6, b"-9999\0"),
    ]
    at = 8 + len(body) + len(body) % 2
    extra_at, extra, entries = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, n, value in tags:
        if isinstance(value, bytes):
            entries += struct.pack("<HHII", tag, kind, n, extra_at + len(extra))
            extra += value
        else:
            entries += struct.pack("<HHII", tag, kind, n, value)
    return struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def is_tiff(data: bytes) -> bool:
    return len(data) >= 8 and data[:4] in (b"II*\0", b"MM\0*")
