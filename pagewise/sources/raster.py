"""Grey page images: decoding within limits, and the measures that straighten them, in numpy."""

from __future__ import annotations

import struct
import zlib
from typing import Protocol

import numpy as np

from ..limits import Limits

LUMA = (0.2126, 0.7152, 0.0722)
MAX_ANGLE, COARSE, FINE, GAIN, LEAST_SIDE, SIDEWAYS = 15, 1.0, 0.1, 1.05, 16, 1.3
FLATTEN_PART, FLATTEN_LEAST, FLATTEN_CELLS = 0.04, 8, 50_000_000
#: Brands of HEIC files: fixed values.
HEIC = ("heic", "heix", "heim", "heis", "hevc", "hevx", "hevm", "hevs")


class TooLarge(ValueError):
    pass


class Undecodable(ValueError):
    """The image is damaged."""


class Unsupported(Undecodable):
    """There is no decoder for it here; another one may have it."""


class DecodeImage(Protocol):
    """Another decoder, asked only for what this module has none for."""

    def handles(self, content: bytes) -> bool: ...

    def decode(self, content: bytes) -> np.ndarray: ...


def header_size(content: bytes) -> tuple[int, int] | None:
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return w, abs(h)
    return None


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """PNG row filters undone: sums along a row or column at once, the others pixel by pixel over all channels."""
    out = np.zeros((height + 1, stride), np.uint8)
    data = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    for y in range(height):
        kind, line, up = data[y, 0], data[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y + 1] = line + up
        else:
            out[y + 1] = _by_pixel(kind, line.tolist(), up.tolist(), step)
    return out[1:]


def _by_pixel(kind: int, line: list[int], up: list[int], step: int) -> list[int]:
    if kind == 3:
        for x in range(len(line)):
            line[x] = (line[x] + (((line[x - step] if x >= step else 0) + up[x]) >> 1)) & 255
        return line
    for x in range(len(line)):
        a, c = (line[x - step], up[x - step]) if x >= step else (0, 0)
        b = up[x]
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        line[x] = (line[x] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return line


def decode(content: bytes, limits: Limits | None = None) -> np.ndarray:
    """Grey pixels of a PNG (8 bits, not interlaced) or BMP (24 or 32 bits); the header is judged before any pixel."""
    limits = limits or Limits()
    size = header_size(content)
    if not size:
        raise Unsupported(f"{brand} images need a decoder of the platform" if (brand := heif_brand(content)) else "no decoder for this image")
    w, h = size
    if limits.pixels_per_page is not None and w * h > limits.pixels_per_page:
        raise TooLarge(f"image pixels is {w * h}, over the limit of {limits.pixels_per_page}")
    try:
        if content[:2] == b"BM":
            at, bits = struct.unpack("<I", content[10:14])[0], struct.unpack("<H", content[28:30])[0]
            stride = (w * bits // 8 + 3) // 4 * 4
            rows = np.frombuffer(content, np.uint8, stride * h, at).reshape(h, stride)[:, : w * bits // 8].reshape(h, w, bits // 8)
            rows = rows[::-1] if struct.unpack("<i", content[22:26])[0] > 0 else rows
            return grey(rows[:, :, 2::-1])
        depth, colour, _, _, interlaced = content[24:29]
        if depth != 8 or interlaced or colour not in (0, 2, 4, 6):
            raise Unsupported("this kind of PNG needs another decoder")
        channels, data, at = {0: 1, 2: 3, 4: 2, 6: 4}[colour], [], 8
        while at < len(content):
            n, kind = struct.unpack(">I4s", content[at : at + 8])
            if kind == b"IDAT":
                data.append(content[at + 8 : at + 8 + n])
            at += n + 12
        raw = zlib.decompressobj().decompress(b"".join(data), h * (w * channels + 1))
        px = _unfilter(raw, h, w * channels, channels).reshape(h, w, channels)
        return px[:, :, 0].copy() if channels < 3 else grey(px[:, :, :3])
    except (struct.error, zlib.error, ValueError, IndexError) as e:
        if isinstance(e, Undecodable):
            raise
        raise Undecodable("the image is damaged") from None


def decode_using(content: bytes, limits: Limits | None = None, decoder: DecodeImage | None = None) -> np.ndarray:
    """decode(), or what another decoder makes of an image that there is none for here; damaged ones
    aren't handed on, and its pixels are counted again."""
    limits = limits or Limits()
    try:
        return decode(content, limits)
    except Unsupported:
        if decoder is None or not decoder.handles(content):
            raise
    img = decoder.decode(content)
    if limits.pixels_per_page is not None and img.size > limits.pixels_per_page:
        raise TooLarge(f"image pixels is {img.size}, over the limit of {limits.pixels_per_page}")
    return img


def heif_brand(content: bytes) -> str | None:
    if content[4:8] != b"ftyp":
        return None
    brand = content[8:12].decode("latin-1")
    return "HEIC" if brand in HEIC else {"avif": "AVIF", "avis": "AVIF", "mif1": "HEIF", "msf1": "HEIF", "mif2": "HEIF"}.get(brand)


def grey(rgb: np.ndarray) -> np.ndarray:
    return (rgb @ np.array(LUMA)).astype(np.uint8)


def encode_png(img: np.ndarray) -> bytes:
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.pad(img, ((0, 0), (1, 0))).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def otsu_level(img: np.ndarray) -> int:
    n = np.bincount(img.ravel(), minlength=256).astype(float)
    if not n.sum():
        return 128
    wb, sb = np.cumsum(n), np.cumsum(n * np.arange(256))
    wf, sf = wb[-1] - wb, sb[-1] - sb
    with np.errstate(all="ignore"):
        v = np.nan_to_num(wb * wf * (sb / wb - sf / wf) ** 2)
    return int(v.argmax()) if v.max() > 0 else 0


def ink_mask(img: np.ndarray) -> np.ndarray:
    ink = img <= otsu_level(img)
    return ~ink if 2 * ink.sum() > ink.size else ink


def detect_orientation(img: np.ndarray) -> int:
    """0, or 90 when ink varies far more by column than by row."""
    if min(img.shape) < LEAST_SIDE:
        return 0
    ink = ink_mask(img)

    def spread(c: np.ndarray) -> float:
        return c.var() / c.mean() ** 2 if c.mean() else 0.0

    return 90 if spread(ink.sum(axis=0)) > SIDEWAYS * spread(ink.sum(axis=1)) else 0


def estimate_skew(img: np.ndarray) -> float:
    """The angle whose shear makes ink rows stand out most: coarse, then fine; 0 if nothing is gained or at the edge."""
    h, w = img.shape
    if min(h, w) < LEAST_SIDE:
        return 0.0
    y, x = np.nonzero(ink_mask(img))

    def score(angle: float) -> float:
        rows = np.floor(y + np.tan(np.radians(-angle)) * (x - w / 2)).astype(int)
        return np.bincount(rows[(rows >= 0) & (rows < h)], minlength=h).var()

    best = max((score(a), -k, a) for k, a in enumerate(np.arange(-MAX_ANGLE, MAX_ANGLE + COARSE / 2, COARSE)))[2]
    if abs(best) >= MAX_ANGLE - 0.5 or score(best) < GAIN * score(0.0):
        return 0.0
    return float(max((score(a), -k, a) for k, a in enumerate(np.arange(best - COARSE, best + COARSE + FINE / 2, FINE)))[2])


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """About the centre, bilinear, white where nothing was."""
    if abs(degrees) < 0.01:
        return img.copy()
    h, w = img.shape
    a, (cy, cx) = np.radians(degrees), (h / 2, w / 2)
    y, x = np.mgrid[:h, :w]
    sx = cx + (x - cx) * np.cos(a) + (y - cy) * np.sin(a)
    sy = cy - (x - cx) * np.sin(a) + (y - cy) * np.cos(a)
    ok = (sx >= 0) & (sy >= 0) & (sx < w - 1) & (sy < h - 1)
    out = np.full(img.shape, 255, np.uint8)
    out[ok] = bilinear(img, sx[ok], sy[ok]).astype(np.uint8)
    return out


def bilinear(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixels; every x and y must have a next pixel."""
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy, f = x - x0, y - y0, img.astype(float)
    return f[y0, x0] * (1 - fx) * (1 - fy) + f[y0, x0 + 1] * fx * (1 - fy) + f[y0 + 1, x0] * (1 - fx) * fy + f[y0 + 1, x0 + 1] * fx * fy


def turned(img: np.ndarray, rotation: int) -> np.ndarray:
    """By 90 (clockwise), 180 or 270 degrees; half a turn resamples about the centre, as any angle does."""
    return rotate(img, 180.0) if rotation == 180 else np.rot90(img, -rotation // 90) if rotation else img


def flatten(img: np.ndarray) -> np.ndarray:
    """Evens out lighting: pixels over their neighbourhood's mean, by a summed-area table."""
    h, w = img.shape
    if min(h, w) < FLATTEN_LEAST or (h + 1) * (w + 1) > FLATTEN_CELLS:
        return img.copy()
    r = int(max(FLATTEN_LEAST, FLATTEN_PART * max(h, w)))
    s = np.pad(img.astype(np.uint64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y0, y1 = np.clip(np.arange(h) - r, 0, h), np.clip(np.arange(h) + r + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - r, 0, w), np.clip(np.arange(w) + r + 1, 0, w)
    total = s[y1][:, x1] + s[y0][:, x0] - s[y0][:, x1] - s[y1][:, x0]
    mean = total // ((y1 - y0)[:, None] * (x1 - x0)[None, :]).astype(np.uint64)
    return np.minimum(255, img.astype(np.uint64) * np.uint64(255) // np.maximum(mean, 1)).astype(np.uint8)
