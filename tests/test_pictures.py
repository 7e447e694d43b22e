"""Picture features: decoding, hashes against their definition, and what stays similar."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.functions import pictures as P
from kinlink.operators import signals


def png(a, colour, palette=None, alpha=None, only=None):
    """An encoded picture, each line predicted in another way."""
    h, w = a.shape[:2]
    lines, c = a.reshape(h, -1).astype(np.uint8), a.size // (h * w)
    out, above = [], np.zeros(w * c, int)
    for k, line in enumerate(lines.astype(int)):
        kind = k % 5 if only is None else only
        left, corner = (np.concatenate([np.zeros(c, int), x[:-c]]) for x in (line, above))
        near = left + above - corner
        pa, pb, pc = abs(near - left), abs(near - above), abs(near - corner)
        guess = [0, left, above, (left + above) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))][kind]
        out.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    more = (part(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b"") + (part(b"tRNS", alpha.astype(np.uint8).tobytes()) if alpha is not None else b"")
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + more + part(b"IDAT", zlib.compress(b"".join(out))) + part(b"IEND", b"")


def scene(seed, size=200):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:size, 0:size]
    img = np.full((size, size, 3), 90.0)
    for _ in range(12):
        cy, cx, r = rng.integers(0, size, 3)
        img[(y - cy) ** 2 + (x - cx) ** 2 < (r / 2 + 12) ** 2] = rng.integers(0, 256, 3)
    return img


def alike(a, b):
    best = 0.0
    for i, u in a.items():
        for j, v in b.items():
            if (i == "subject") == (j == "subject"):
                best = max(best, 1 - sum(w * ((u[k] ^ v[k]) & (2**64 - 1)).bit_count() for k, w in (("p", 0.5), ("d", 0.3), ("a", 0.2))) / 64)
    return best


def test_decoding():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (23, 17, 4))
    white = lambda x, alpha: x * (alpha / 255) + 255 * (1 - alpha / 255)
    assert (P.decode(png(a[:, :, :3], 2)) == a[:, :, :3]).all()
    assert (P.decode(png(a[:, :, :1], 0)) == a[:, :, :1]).all()
    assert np.allclose(P.decode(png(a, 6)), white(a[:, :, :3], a[:, :, 3:]))
    assert np.allclose(P.decode(png(a[:, :, :2], 4)), white(a[:, :, :1], a[:, :, 1:2]))
    palette, alpha = rng.integers(0, 256, (256, 3)), rng.integers(0, 256, 100)
    want = white(palette, np.concatenate([alpha, np.full(156, 255)])[:, None])[a[:, :, 0]]
    assert np.allclose(P.decode(png(a[:, :, :1], 3, palette, alpha)), want)
    assert (P.decode(b"P6 # a note\n17 23\n255\n" + a[:, :, :3].astype(np.uint8).tobytes()) == a[:, :, :3]).all()
    good = png(a, 6)
    for broken in (b"", b"GIF89a", good[:60], good[:33], b"P5 9", b"P5 9 9 255 ", b"P5 # no end", good[:16] + struct.pack(">I", 1 << 30) + good[20:], png(a, 6, only=0)[:-40]):
        with pytest.raises(P.PictureError):
            P.decode(broken)


def test_hashes_by_definition():
    rng = np.random.default_rng(4)
    g = rng.uniform(0, 255, (32, 32))
    h = P.hashes(g)
    x, u = np.arange(32), np.arange(8)
    low = [[sum(g[i, j] * np.cos(np.pi * (2 * i + 1) * a / 64) * np.cos(np.pi * (2 * j + 1) * b / 64) for i in x for j in x) for b in u] for a in u]
    middle = np.median(low)
    assert [c == "1" for c in f"{h['p'] & (2**64 - 1):064b}"] == [v > middle for row in low for v in row]
    ramp = np.tile(np.arange(64.0), (64, 1))
    assert P.hashes(ramp)["d"] == -1 and P.hashes(ramp[:, ::-1])["d"] == 0 and P.hashes(ramp)["a"] & 255 == 0b1111
    assert np.allclose(P.resizing(7, 7), np.eye(7)) and np.allclose(P.resizing(5, 200).sum(1), 1)


def test_what_stays_similar():
    base = scene(1)
    f = P.variants(base)
    framed = np.full((260, 260, 3), 255.0)
    framed[30:230, 30:230] = base
    recoloured = np.where((base == 90).all(2, keepdims=True), [20.0, 60.0, 200.0], base)
    for other in (framed, np.clip(base + np.random.default_rng(0).normal(0, 8, base.shape), 0, 255), P.resized(base, 77, 77), base[20:180, 20:180], recoloured):
        assert alike(f, P.variants(other)) >= 0.9
    assert {"trim", "trim_center"} <= set(P.variants(framed)) and "trim" not in P.variants(np.full((50, 50, 3), 7.0))
    assert all(alike(f, P.variants(scene(s))) < 0.75 for s in range(2, 12))
    lone = np.full((100, 100, 3), 255.0)
    lone[40:60, 40:60] = 0
    assert P.trimmed(lone).shape == lone.shape  # the subject is not cut out
    assert P.says_little(np.full((40, 40, 3), 128.0)) and P.says_little(lone) and not P.says_little(P.cut(base, 1.0, 256))
    assert P.variants(np.full((1, 1, 3), 9.0))["full"]["p"] is not None


def test_image_table(spark):
    a, b = png(scene(1, 90), 2), png(scene(2, 90), 2)
    flat = png(np.full((30, 30, 3), 200), 2)
    rows = [("u1", a), ("u2", a), ("u3", b), ("u4", b"not a picture"), ("u5", None), ("u6", flat), (None, a)]
    found = {r.url: r for r in P.image_table(spark.createDataFrame([(u, bytearray(c) if c else None, 1) for u, c in rows], "url string, content binary, name int").repartition(3)).collect()}
    assert len(found) == len(rows) and found["u1"].variants == found["u2"].variants == found[None].variants
    assert {k: {n: h for n, h in v.asDict().items()} for k, v in found["u3"].variants.items()} == P.variants(P.decode(b))
    assert found["u4"].variants is None and "decoded" in found["u4"].error and found["u5"].error == "image not retrievable"
    assert found["u6"].low_complexity and not found["u1"].low_complexity
    pairs = spark.createDataFrame([(found["u1"].variants, found["u3"].variants), (found["u1"].variants, found["u2"].variants)], "a map<string,struct<p:long,d:long,a:long>>, b map<string,struct<p:long,d:long,a:long>>")
    got = [r.s for r in pairs.select(signals.variants_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[1] == 1.0 and abs(got[0] - alike(P.variants(P.decode(a)), P.variants(P.decode(b)))) < 1e-12
    assert P.image_table(spark.createDataFrame([], "url string, content binary")).collect() == []
