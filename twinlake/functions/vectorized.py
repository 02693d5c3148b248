"""Kernels on binaries as Arrow UDFs: frames, hashes of frames and files, audio fingerprints, difference regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = 32


def _cosines() -> np.ndarray:
    """Rows of frequencies 1 to 8 of a 32-point DCT-II."""
    k, n = np.arange(1, 9)[:, None], np.arange(SIDE)[None]
    return np.cos((2 * n + 1) * k * np.pi / (2 * SIDE))


def frame_hash(gray: bytes) -> int:
    """64 bits of a 32x32 frame: which of the 8x8 lowest frequencies (without the constant one) are above their median."""
    c = _cosines()
    block = (c @ np.frombuffer(gray, np.uint8).reshape(SIDE, SIDE).astype(np.float64) @ c.T).ravel()
    ordered = np.sort(block)
    bits = np.packbits(block > (ordered[31] + ordered[32]) / 2, bitorder="little")
    return int(bits.view(np.int64)[0])


@F.pandas_udf(T.LongType())
def phash(gray: pd.Series) -> pd.Series:
    return pd.Series([frame_hash(g) if g is not None and len(g) == SIDE * SIDE else None for g in gray], dtype="Int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def filled_hashes(frames: pd.Series, hashes: pd.Series) -> pd.Series:
    """The hash of each 32x32 frame: the known one, else that of the frame's numbers."""
    def one(numbers, known):
        known = [] if known is None else list(known)
        known += [None] * (len(numbers) - len(known))
        return [int(h) if h is not None and h == h else frame_hash(np.asarray(f, np.uint8).tobytes()) for f, h in zip(numbers, known, strict=False)]

    return pd.Series([None if f is None else one(f, h) for f, h in zip(frames, hashes, strict=True)], dtype=object)


@F.pandas_udf(T.DoubleType())
def difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean absolute difference of two frames over 256; null if sizes differ."""
    def one(x, y):
        if x is None or y is None or len(x) != len(y) or not len(x):
            return None
        return float(np.abs(np.frombuffer(x, np.uint8).astype(np.int16) - np.frombuffer(y, np.uint8)).sum()) / len(x) / 256

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.BinaryType())
def flipped(gray: pd.Series) -> pd.Series:
    def one(g):
        side = int(len(g) ** 0.5) if g is not None else 0
        return np.frombuffer(g, np.uint8).reshape(side, side)[:, ::-1].tobytes() if side and side * side == len(g) else None

    return gray.map(one)


def content_hash(data: bytes, size: int | None = None) -> str | None:
    """Size plus the little-endian 64-bit words of the first and last 64 KiB, modulo 2 ** 64, as 16 hex digits."""
    if data is None or len(data) < 65536:
        return None
    ends = np.frombuffer(data[:65536], "<u8").sum(dtype=np.uint64) + np.frombuffer(data[-65536:], "<u8").sum(dtype=np.uint64)
    return f"{(int(ends) + (len(data) if size is None else size)) % (1 << 64):016x}"


@F.pandas_udf(T.StringType())
def os_hash(content: pd.Series) -> pd.Series:
    return content.map(content_hash)


def fingerprint(pcm: np.ndarray, rate: int = 11025) -> list[int]:
    """One 32-bit block a second of mono samples: chroma of overlapping frames, smoothed over five, normalised, 32 comparisons of
    neighbouring notes, and the majority of each bit within the second."""
    size, hop = 4096, 1365
    if len(pcm) < size:
        return []
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float64), size)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)) ** 2
    freq = np.fft.rfftfreq(size, 1 / rate)
    use = (freq >= 27.5) & (freq <= 3520)
    note = np.round(12 * np.log2(np.maximum(freq, 1) / 440)).astype(int) % 12
    chroma = np.stack([power[:, use & (note == n)].sum(1) for n in range(12)], 1)
    weights = np.array([0.25, 0.5, 1.0, 0.5, 0.25]) / 2.5
    if len(chroma) < 5:
        return []
    smooth = np.stack([np.convolve(chroma[:, n], weights, "valid") for n in range(12)], 1)
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    smooth = np.where(norm > 1e-10, smooth / np.maximum(norm, 1e-10), 0)
    pairs = [(i % 12, (i + 1 + i // 12) % 12) for i in range(32)]
    bits = np.stack([smooth[:, a] > smooth[:, b] for a, b in pairs], 1)
    second = (np.arange(len(bits)) * hop) // rate
    out = []
    for s in np.unique(second):
        rows = bits[second == s]
        out.append(int(((rows.sum(0) >= len(rows) // 2 + 1) * (1 << np.arange(32, dtype=np.int64))).sum()))
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def audio_fingerprint(pcm: pd.Series) -> pd.Series:
    """Of 16-bit mono samples; null stays null (not extracted), too little audio is empty."""
    return pcm.map(lambda b: None if b is None else fingerprint(np.frombuffer(b[: len(b) // 2 * 2], "<i2")))


def difference_regions(a: np.ndarray, b: np.ndarray, sensitivity: float = 0.5, most: int = 12) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of where two grey images differ, the largest first: normalise, blur, threshold, drop specks, join what is
    near, pad."""
    def plain(x):
        x = x.astype(np.float64)
        return (x - x.mean()) / (x.std() or 1)

    def blur(x):
        p = np.pad(x, 1, mode="edge")
        return sum(p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3)) / 9

    hot = blur(np.abs(blur(plain(a)) - blur(plain(b)))) > 1.8 - 1.55 * sensitivity
    p = np.pad(hot, 1).astype(int)
    near = sum(p[i : i + hot.shape[0], j : j + hot.shape[1]] for i in range(3) for j in range(3)) - hot
    hot &= near >= 2
    label, boxes = np.zeros(hot.shape, int), []
    for y, x in np.argwhere(hot):
        if label[y, x]:
            continue
        queue, cells = [(y, x)], []
        label[y, x] = len(boxes) + 1
        while queue:
            cy, cx = queue.pop()
            cells.append((cy, cx))
            for ny in range(max(0, cy - 1), min(hot.shape[0], cy + 2)):
                for nx in range(max(0, cx - 1), min(hot.shape[1], cx + 2)):
                    if hot[ny, nx] and not label[ny, nx]:
                        label[ny, nx] = label[y, x]
                        queue.append((ny, nx))
        ys, xs = zip(*cells, strict=True)
        boxes.append([min(xs), min(ys), max(xs), max(ys)])
    joined = True
    while joined:
        joined = False
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                p, q = boxes[i], boxes[j]
                if p[0] - 3 <= q[2] and q[0] - 3 <= p[2] and p[1] - 3 <= q[3] and q[1] - 3 <= p[3]:
                    boxes[i] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])]
                    del boxes[j]
                    joined = True
                    break
            if joined:
                break
    boxes.sort(key=lambda r: -(r[2] - r[0] + 1) * (r[3] - r[1] + 1))
    h, w = hot.shape
    return [(int(max(0, x0 - 2)), int(max(0, y0 - 2)), int(min(w - 1, x1 + 2) - max(0, x0 - 2) + 1), int(min(h - 1, y1 + 2) - max(0, y0 - 2) + 1)) for x0, y0, x1, y1 in boxes[:most]]


@F.pandas_udf(T.TimestampType())
def exif_date(content: pd.Series) -> pd.Series:
    """The first date that an image's EXIF block writes as "YYYY:MM:DD HH:MM:SS"."""
    import re

    def one(b):
        found = re.search(rb"(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d):(\d\d)", b[:131072]) if b else None
        return pd.to_datetime("{}-{}-{} {}:{}:{}".format(*(g.decode() for g in found.groups())), errors="coerce") if found else None

    return pd.to_datetime(content.map(one))


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    """Width and height from the header of a PNG, GIF, BMP or JPEG."""
    def one(b):
        if not b or len(b) < 26:
            return None, None
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
        if b[:3] == b"GIF":
            return int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little")
        if b[:2] == b"BM":
            return int.from_bytes(b[18:22], "little"), abs(int.from_bytes(b[22:26], "little", signed=True))
        i = 2
        while b[:2] == b"\xff\xd8" and i + 9 < len(b):
            if b[i] != 0xFF:
                break
            if 0xC0 <= b[i + 1] <= 0xCF and b[i + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[i + 7 : i + 9], "big"), int.from_bytes(b[i + 5 : i + 7], "big")
            i += 2 + int.from_bytes(b[i + 2 : i + 4], "big")
        return None, None

    return pd.DataFrame([one(b) for b in content], columns=["width", "height"]).astype("Int32")
