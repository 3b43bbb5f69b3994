"""Handwriting measures of a cropped word: how much stroke width varies, and how its baseline drifts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..sources.raster import ink_mask

#: Least side of a crop, ridge samples and inked columns that a measure needs, and columns that slopes are taken between.
LEAST_SIDE, LEAST_SAMPLES, LEAST_COLUMNS, SLOPE_COLUMNS = 10, 40, 12, 120
FAR = 65535
MARK = "[handwritten]"


@dataclass(frozen=True)
class Ink:
    stroke_width: float
    stroke_variation: float
    baseline_drift: float
    coverage: float


@dataclass(frozen=True)
class Floors:
    """Both must be reached for ink to count as handwriting; `never` marks nothing."""

    variation: float = 0.80
    drift: float = 0.08

    @classmethod
    def never(cls) -> Floors:
        return cls(float("inf"), float("inf"))


def judge(ink: Ink | None, floors: Floors) -> bool:
    return ink is not None and ink.stroke_variation >= floors.variation and ink.baseline_drift >= floors.drift


def percentile(values: np.ndarray, q: float) -> float:
    """Nearest rank of sorted values; 0 of none."""
    return float(values[int(np.floor(q * (len(values) - 1) + 0.5))]) if len(values) else 0.0


def page_reference(confidences: list[float]) -> float:
    known = np.sort([c for c in confidences if np.isfinite(c)])
    return percentile(known, 0.5)


def chamfer(mask: np.ndarray) -> np.ndarray:
    """3-4 distance of each inked pixel to the nearest blank one: two sweeps, each row at once.

    Along a row, the least of (value + 3 a step) to one side is a running minimum of value - 3 x.
    """
    d = np.where(mask, FAR, 0).astype(np.int64)
    ramp = 3 * np.arange(mask.shape[1])
    for sweep in range(2):
        d = d[::-1, ::-1] if sweep else d
        for y in range(d.shape[0]):
            row = d[y]
            if y:
                above = np.pad(d[y - 1], 1, constant_values=FAR)
                row = np.minimum(row, np.minimum(above[1:-1] + 3, np.minimum(above[:-2], above[2:]) + 4))
            d[y] = np.minimum(np.minimum.accumulate(row - ramp) + ramp, FAR)
    return d[::-1, ::-1]


def stroke_samples(mask: np.ndarray) -> np.ndarray:
    """Stroke widths, in tenths of a pixel, where no neighbour is farther from blank."""
    d = chamfer(mask)
    around = np.pad(d, 1)
    h, w = d.shape
    most = np.max([around[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3) if (dy, dx) != (1, 1)], axis=0)
    return np.minimum(d[(d > 0) & (most <= d)] * 20, FAR) // 3


def theil_sen(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """Median slope between evenly spaced points, and the median intercept of all."""
    if len(x) < 2:
        return None
    at = np.arange(0, len(x), -(-len(x) // SLOPE_COLUMNS))
    i, j = np.triu_indices(len(at), 1)
    dx, dy = x[at[j]] - x[at[i]], y[at[j]] - y[at[i]]
    slopes = np.sort((dy[dx != 0] / dx[dx != 0]).astype(np.float32))
    if not len(slopes):
        return None
    slope = percentile(slopes, 0.5)
    return slope, percentile(np.sort((y - np.float32(slope) * x).astype(np.float32)), 0.5)


def baseline_drift(mask: np.ndarray) -> float | None:
    """How far the lowest ink of columns strays from a line, by the height of the ink."""
    x = np.flatnonzero(mask.any(axis=0))
    if len(x) < LEAST_COLUMNS:
        return None
    top = mask[:, x].argmax(axis=0)
    bottom = mask.shape[0] - 1 - mask[::-1, x].argmax(axis=0)
    line = theil_sen(x.astype(np.float32), bottom.astype(np.float32))
    if line is None:
        return None
    high = percentile(np.sort(bottom - top), 0.5)
    if high <= 0:
        return None
    return percentile(np.sort(np.abs(bottom - (line[0] * x + line[1]))), 0.5) / high


def measure(crop: np.ndarray) -> Ink | None:
    """None where a crop is too small, or has too little ink, to say."""
    if min(crop.shape) < LEAST_SIDE:
        return None
    mask = ink_mask(crop)
    widths = np.sort(stroke_samples(mask)) / 10.0
    if len(widths) < LEAST_SAMPLES:
        return None
    low, mid, high = (percentile(widths, q) for q in (0.25, 0.5, 0.75))
    drift = baseline_drift(mask) if mid > 0 else None
    return None if drift is None else Ink(mid, (high - low) / mid, drift, float(mask.mean()))
