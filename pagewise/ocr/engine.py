"""The engine around a detector and a recogniser: straightens an image, reads its boxes, and reads again
where it isn't sure. What it gives are boxes and handwritten regions; lines are made of them by
`operators.layout`, over all pages at once."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np

from ..limits import Limits
from ..sources import raster
from .frame import content_bounds
from .human import Floors, Ink, judge, measure, page_reference

#: A quad: the corners (x, y) of a box, in the straightened image.
Quad = tuple[tuple[float, float], ...]


class Detector(Protocol):
    def detect(self, image: np.ndarray) -> Sequence[Quad]: ...


class Recognizer(Protocol):
    """recognize_batch may be faster than one crop at a time, but must say the same."""

    def recognize(self, crop: np.ndarray) -> tuple[str, float]: ...

    def recognize_batch(self, crops: Sequence[np.ndarray]) -> list[tuple[str, float]]:
        return [self.recognize(c) for c in crops]


class Backend(Protocol):
    def read_image(self, content: bytes) -> Scan: ...


class Rasterise(Protocol):
    """Renders PDF pages; none is bundled."""

    def page_count(self, pdf: bytes) -> int: ...

    def render_page(self, pdf: bytes, page: int, dpi: float) -> np.ndarray: ...

    def render_page_with_password(self, pdf: bytes, page: int, dpi: float, password: str | None) -> np.ndarray:
        return self.render_page(pdf, page, dpi)


@dataclass(frozen=True)
class ScanOptions:
    """The corrections to make; `turn` (0, 90, 180 or 270) is one that is known."""

    flatten_lighting: bool = True
    crop_to_content: bool = True
    fix_orientation: bool = True
    fix_skew: bool = True
    turn: int | None = None
    confidence_floor: float = 0.5
    retry_when_unsure: bool = True
    handwriting: Floors = field(default_factory=Floors)


PROFILES = {
    "photograph": ScanOptions(),
    "scanned_page": ScanOptions(crop_to_content=False),
    "rendered_page": ScanOptions(flatten_lighting=False, crop_to_content=False, fix_orientation=False, fix_skew=False, retry_when_unsure=False),
}


def profile(name: str) -> ScanOptions:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(PROFILES)}")
    return PROFILES[name]


@dataclass(frozen=True)
class Correction:
    """From the straightened image back to the cropped one, and to the whole. Sizes are (width, height)."""

    rotation: int
    skew: float
    original: tuple[int, int]
    turned: tuple[int, int]
    crop_origin: tuple[int, int] = (0, 0)

    def is_identity(self) -> bool:
        return self.rotation == 0 and abs(self.skew) < 0.01

    def to_original(self, x, y):
        if abs(self.skew) >= 0.01:
            a, cx, cy = np.radians(-self.skew), self.turned[0] / 2, self.turned[1] / 2
            x, y = np.cos(a) * (x - cx) + np.sin(a) * (y - cy) + cx, -np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy
        w, h = self.original
        return {0: (x, y), 90: (y, h - 1 - x), 180: (w - 1 - x, h - 1 - y), 270: (w - 1 - y, x)}[self.rotation]

    def to_frame(self, x, y):
        x, y = self.to_original(x, y)
        return x + self.crop_origin[0], y + self.crop_origin[1]


@dataclass(frozen=True)
class Prepared:
    """image: straightened, for the detector. original: cropped and otherwise as it was, for crops."""

    image: np.ndarray
    original: np.ndarray
    correction: Correction


def prepare(content: bytes, options: ScanOptions, limits: Limits | None = None, decoder: raster.DecodeImage | None = None) -> Prepared:
    img, origin = raster.decode_using(content, limits, decoder), (0, 0)
    if options.crop_to_content and (found := content_bounds(img)):
        x, y, w, h = found
        img, origin = img[y : y + h, x : x + w], (x, y)
    even = raster.flatten(img) if options.flatten_lighting else img
    rotation = options.turn if options.turn is not None else raster.detect_orientation(even) if options.fix_orientation else 0
    turned = raster.turned(even, rotation)
    skew = raster.estimate_skew(turned) if options.fix_skew else 0.0
    straight = raster.rotate(turned, -skew) if options.fix_skew else turned
    return Prepared(straight, img, Correction(rotation, skew, img.shape[::-1], turned.shape[::-1], origin))


def bounds(quad: Quad) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in quad], [p[1] for p in quad]
    return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)


def crop(prepared: Prepared, quad: Quad) -> np.ndarray:
    """A box's pixels, from the original ones by one resampling; white where there are none."""
    x, y, w, h = bounds(quad)
    if prepared.correction.is_identity():
        ih, iw = prepared.image.shape
        x0, y0, x1, y1 = int(max(0, x)), int(max(0, y)), min(iw, int(np.ceil(x + w))), min(ih, int(np.ceil(y + h)))
        return prepared.image[y0:y1, x0:x1] if x1 > x0 and y1 > y0 else np.zeros((1, 1), np.uint8)
    v, u = np.mgrid[: max(1, int(np.ceil(h))), : max(1, int(np.ceil(w)))]
    sx, sy = prepared.correction.to_original(x + u, y + v)
    oh, ow = prepared.original.shape
    ok = (sx >= 0) & (sy >= 0) & (sx < ow - 1) & (sy < oh - 1)
    out = np.full(u.shape, 255, np.uint8)
    if ok.any():
        out[ok] = np.clip(np.floor(raster.bilinear(prepared.original, sx[ok], sy[ok]) + 0.5), 0, 255).astype(np.uint8)
    return out


@dataclass(frozen=True)
class Box:
    text: str
    quad: Quad
    confidence: float


@dataclass(frozen=True)
class HumanRegion:
    """Handwriting: what a recogniser made of it isn't kept."""

    quad: Quad
    ink: Ink
    confidence: float
    page_confidence: float


@dataclass(frozen=True)
class Scan:
    boxes: list[Box]
    human: list[HumanRegion]
    width: int
    height: int
    rotation: int = 0
    skew: float = 0.0
    elapsed_ms: int = 0

    @property
    def confidence(self) -> float:
        return sum(b.confidence for b in self.boxes) / len(self.boxes) if self.boxes else 0.0

    @property
    def read_mass(self) -> float:
        return sum(b.confidence * len(b.text) for b in self.boxes)


@dataclass(frozen=True)
class Engine:
    detector: Detector
    recognizer: Recognizer
    options: ScanOptions = ScanOptions()
    limits: Limits = Limits()
    decoder: raster.DecodeImage | None = None

    def read_image(self, content: bytes) -> Scan:
        return self.scan_bytes(content)

    def scan_once(self, content: bytes, options: ScanOptions) -> Scan:
        began = time.monotonic()
        prepared = prepare(content, options, self.limits, self.decoder)
        quads = list(self.detector.detect(prepared.image))
        crops = [crop(prepared, q) for q in quads]
        said = self.recognizer.recognize_batch(crops)
        inks = [measure(c) for c in crops]
        page = page_reference([c for text, c in said if text.strip()])
        boxes, human = [], []
        for quad, (text, confidence), ink in zip(quads, said, inks, strict=True):
            if not text.strip():
                continue
            if judge(ink, options.handwriting):
                human.append(HumanRegion(quad, ink, confidence, page))
            else:
                boxes.append(Box(text, quad, confidence))
        h, w = prepared.image.shape
        return Scan(boxes, human, w, h, prepared.correction.rotation, prepared.correction.skew, int((time.monotonic() - began) * 1000))

    def scan_bytes(self, content: bytes) -> Scan:
        """One reading, and others while it isn't sure: without the corrections that were made, and
        turned to either side. The one that read most counts."""
        o = self.options
        best = self.scan_once(content, o)
        if not o.retry_when_unsure or best.confidence >= o.confidence_floor:
            return best
        others = []
        if best.rotation or abs(best.skew) >= 0.01:
            others += [replace(o, fix_orientation=False, turn=None), replace(o, fix_orientation=False, turn=None, fix_skew=False)]
        if o.fix_orientation:
            others += [replace(o, turn=90), replace(o, turn=270)]
        seen = {best.rotation}
        for other in others:
            if other.turn in seen:
                continue
            again = self.scan_once(content, other)
            seen.add(again.rotation)
            best = again if again.read_mass > best.read_mass else best
            if best.confidence >= o.confidence_floor:
                break
        return best
