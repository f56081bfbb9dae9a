"""Arrays of integers as compact bytes, for blobs that are shuffled."""

from __future__ import annotations

import numpy as np
import zstandard


def planes(v: np.ndarray) -> bytes:
    """Nonnegative integers as byte planes, as many as the greatest needs."""
    v = np.ascontiguousarray(v, "<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplaned(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8")[:, 0].astype(np.int64)


def framed(parts: list[bytes]) -> bytes:
    """Several byte strings as one, compressed."""
    sizes = np.array([len(parts), *map(len, parts)], "<u4")
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(parts))


def unframed(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))
    starts = np.concatenate(([4 * (n + 1)], ends[:-1]))
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
