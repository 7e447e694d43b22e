"""Picture features from pixels: three 64-bit hashes of several cuts of a picture, and whether it says little.

Pictures are PNG (8 bits, not interlaced) or binary PGM and PPM.  Decoding and hashing run in
Arrow batches; what is compared later are whole numbers, in the JVM (``text.hash_similarity``).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sizes and thresholds of the features.
SIDE, WAVES, HASH = 256, 32, 8
CENTRE, TOLERANCE, LEAST_KEPT = 0.8, 18, 0.3
FLAT_DEVIATION, FEW_COLOURS, COLOUR_SHARE = 12.0, 3, 0.02
#: Pixels of a picture that is decoded.
MOST_PIXELS = 1 << 25

VARIANTS = T.MapType(T.StringType(), T.StructType([T.StructField(c, T.LongType()) for c in "pda"]))
FEATURES = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("variants", VARIANTS), T.StructField("low_complexity", T.BooleanType()), T.StructField("error", T.StringType())])
_LUMA = np.array([0.299, 0.587, 0.114])


class PictureError(ValueError):
    pass


# --- decoding


def decode(data: bytes) -> np.ndarray:
    """Height x width x 3 values of 0 to 255; what is transparent shows white."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] in (b"P5", b"P6"):
        return _pnm(data)
    raise PictureError("not a PNG, PGM or PPM picture")


def _sized(width: int, height: int) -> None:
    if not 0 < width * height <= MOST_PIXELS:
        raise PictureError(f"a picture of {width} x {height}")


def _png(data: bytes) -> np.ndarray:
    at, parts, packed = 8, {}, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IDAT":
            packed.append(body)
        else:
            parts.setdefault(kind, body)
        at += 12 + size
    try:
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
        _sized(width, height)
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        if depth != 8 or interlaced:
            raise PictureError("only PNG of 8 bits a channel that isn't interlaced")
        raw = zlib.decompressobj().decompress(b"".join(packed), height * (width * channels + 1))
        pixels = _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, width * channels + 1), channels).reshape(height, width, channels)
        if colour == 3:
            palette = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
            alpha = np.full(len(palette), 255, np.uint8)
            given = np.frombuffer(parts.get(b"tRNS", b""), np.uint8)[: len(palette)]
            alpha[: len(given)] = given
            pixels = np.concatenate([palette, alpha[:, None]], axis=1)[pixels[:, :, 0]]
    except (KeyError, ValueError, IndexError, struct.error, zlib.error) as e:
        raise PictureError(f"broken PNG: {type(e).__name__}: {e}") from e
    pixels = pixels.astype(float)
    if pixels.shape[2] in (2, 4):
        alpha = pixels[:, :, -1:] / 255
        pixels = pixels[:, :, :-1] * alpha + 255 * (1 - alpha)
    return np.broadcast_to(pixels, (*pixels.shape[:2], 3)) if pixels.shape[2] == 1 else pixels


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """The bytes of a picture's lines, whose first byte says how each was predicted."""
    above = np.zeros(lines.shape[1] - 1, np.uint8)
    out = np.empty((len(lines), lines.shape[1] - 1), np.uint8)
    for k, line in enumerate(lines):
        kind, own = int(line[0]), line[1:]
        if kind == 1:
            own = np.add.accumulate(own.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            own = own + above
        elif kind in (3, 4):
            own = np.array(_predicted(own.tolist(), above.tolist(), step, kind == 4), np.uint8)
        elif kind:
            raise PictureError(f"unknown filter {kind}")
        out[k] = above = own
    return out


def _predicted(own: list[int], above: list[int], step: int, paeth: bool) -> list[int]:
    """A line predicted by the mean of its left and upper neighbours, or by the one of three nearest to left + upper - corner."""
    out: list[int] = []
    for i, x in enumerate(own):
        left, corner = (out[i - step], above[i - step]) if i >= step else (0, 0)
        up = above[i]
        if paeth:
            guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
        else:
            guess = (left + up) // 2
        out.append((x + guess) & 255)
    return out


def _pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at)
            if at < 0:
                raise PictureError("broken header")
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise PictureError("broken header")
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    _sized(width, height)
    n = 1 if data[:2] == b"P5" else 3
    if most != 255 or len(data) < at + 1 + width * height * n:
        raise PictureError("a picture cut short, or not of 8 bits")
    pixels = np.frombuffer(data, np.uint8, width * height * n, at + 1).reshape(height, width, n).astype(float)
    return np.broadcast_to(pixels, (height, width, 3))


# --- features


@cache
def resizing(to: int, size: int) -> np.ndarray:
    """The ``to`` x ``size`` matrix that resizes a line: three lobes of the windowed sinc, as wide as a pixel of the smaller picture."""
    scale = max(1.0, size / to)
    centre = (np.arange(to) + 0.5) * size / to
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image of any number of channels, within 0 to 255."""
    rows = np.tensordot(resizing(height, img.shape[0]), img, (1, 0))
    out = np.moveaxis(np.tensordot(resizing(width, img.shape[1]), rows, (1, 1)), 0, 1)
    return np.clip(out, 0.0, 255.0)


@cache
def _cosines(n: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(n), 2 * np.arange(n) + 1) / (2 * n))


def _number(bits: np.ndarray) -> int:
    """64 bits, the first one highest, as a signed number."""
    n = int("".join("1" if b else "0" for b in bits.reshape(-1)), 2)
    return n - (1 << 64) if n >> 63 else n


def hashes(grey: np.ndarray, waves: int = WAVES) -> dict[str, int]:
    """p: low frequencies above their median; d: brighter than the left neighbour; a: above the mean."""
    c = _cosines(waves)
    low = (c @ resized(grey, waves, waves) @ c.T)[:HASH, :HASH]
    steps = resized(grey, HASH, HASH + 1)
    mean = resized(grey, HASH, HASH)
    return {"p": _number(low > np.median(low)), "d": _number(steps[:, 1:] > steps[:, :-1]), "a": _number(mean > mean.mean())}


def cut(img: np.ndarray, share: float, side: int) -> np.ndarray:
    """The middle square of a share of the shorter side, resized."""
    h, w = img.shape[:2]
    own = max(1, int(min(h, w) * share))
    top, left = (h - own) // 2, (w - own) // 2
    return resized(img[top : top + own, left : left + own], side, side)


def edges(grey: np.ndarray) -> np.ndarray:
    """What differs from its eight neighbours, stretched to 0 to 255; the rim stays as it is."""
    out = grey.copy()
    if min(grey.shape) > 2:
        around = sum(grey[1 + i : grey.shape[0] - 1 + i, 1 + j : grey.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1))
        out[1:-1, 1:-1] = np.clip(9 * grey[1:-1, 1:-1] - around, 0, 255)
    least, most = out.min(), out.max()
    return (out - least) * (255.0 / (most - least)) if most > least else out


def trimmed(img: np.ndarray) -> np.ndarray:
    """Without the border of the first pixel's colour, unless little would be left."""
    differs = np.abs(img - img[0, 0]) @ _LUMA > TOLERANCE
    rows, columns = np.flatnonzero(differs.any(1)), np.flatnonzero(differs.any(0))
    if not len(rows):
        return img
    out = img[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
    return out if out.shape[0] * out.shape[1] >= LEAST_KEPT * img.shape[0] * img.shape[1] else img


def says_little(img: np.ndarray) -> bool:
    """Nearly one brightness, or few colours (of eight levels a channel) of some share."""
    small = resized(img, 64, 64)
    if (small @ _LUMA).std() < FLAT_DEVIATION:
        return True
    levels = (small / 32).astype(int).clip(0, 7) @ np.array([64, 8, 1])
    return int((np.bincount(levels.reshape(-1), minlength=512) >= COLOUR_SHARE * levels.size).sum()) <= FEW_COLOURS


def variants(img: np.ndarray, side: int = SIDE, waves: int = WAVES) -> dict[str, dict[str, int]]:
    """The hashes of the whole, its centre, its outlines, and of what is left without a border."""
    grey = lambda x: x @ _LUMA
    centre = grey(cut(img, CENTRE, side))
    out = {"full": hashes(grey(cut(img, 1.0, side)), waves), "center": hashes(centre, waves), "subject": hashes(edges(centre), waves)}
    inner = trimmed(img)
    if inner.shape != img.shape:
        out |= {"trim": hashes(grey(cut(inner, 1.0, side)), waves), "trim_center": hashes(grey(cut(inner, CENTRE, side)), waves)}
    return out


def features(data: bytes | None) -> dict:
    """A picture's features; where it can't be decoded an error in their place."""
    if data is None:
        return {"sha256": None, "variants": None, "low_complexity": None, "error": "image not retrievable"}
    name = hashlib.sha256(data).hexdigest()
    try:
        img = decode(bytes(data))
    except PictureError as e:
        return {"sha256": name, "variants": None, "low_complexity": None, "error": f"image could not be decoded: {e}"}
    return {"sha256": name, "variants": variants(img), "low_complexity": says_little(cut(img, 1.0, SIDE)), "error": None}


@F.pandas_udf(FEATURES)
def _features(pictures: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in pictures:
        yield pd.DataFrame([features(x) for x in part], columns=["sha256", "variants", "low_complexity", "error"])


def picture_features(content: Column) -> Column:
    """Of a column of encoded pictures: struct(sha256, variants, low_complexity, error)."""
    return _features(content)


def image_table(pictures: DataFrame) -> DataFrame:
    """(url, sha256, low_complexity, variants, error) of (url, content): each different picture is hashed once, then joined back to its addresses.

    Null contents and pictures that can't be decoded have an error and no hashes.
    """
    named = pictures.select("url", F.sha2("content", 256).alias("name"), "content")
    once = named.groupBy("name").agg(F.first("content").alias("content")).select("name", picture_features(F.col("content")).alias("f"))
    out = named.select("url", "name").join(once, named["name"].eqNullSafe(once["name"]))
    return out.select("url", "f.sha256", "f.low_complexity", "f.variants", "f.error")


def grid_hashes(side: int, waves: int):
    """A function of columns of side * side grey values: the hashes of the whole and of the centre, both resized to side x side."""

    @F.pandas_udf(VARIANTS)
    def run(grids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in grids:
            told = []
            for grid in part:
                grey = np.clip(np.asarray(grid, float), 0, 255).reshape(side, side)
                told.append({"full": hashes(cut(grey, 1.0, side), waves), "center": hashes(cut(grey, CENTRE, side), waves)})
            yield pd.Series(told)

    return run
