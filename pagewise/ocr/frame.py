"""Where on a photograph the page is: the largest connected area with contrast."""

from __future__ import annotations

import numpy as np

#: Longest side worked on, side of a cell, contrast of an inked one, cells bridged, margin, and the part of the image that a page may be.
WORK_SIDE, CELL, CONTRAST, BRIDGE, MARGIN, LEAST, MOST = 800, 8, 40, 2, 0.02, 0.02, 0.92


def _weights(n: int, to: int) -> np.ndarray:
    """Rows of triangle weights that resample n values to `to`."""
    ratio = n / to
    reach = max(ratio, 1.0)
    centre = (np.arange(to) + 0.5) * ratio
    w = np.maximum(0.0, 1.0 - np.abs(np.arange(n)[None, :] + 0.5 - centre[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    if img.shape == (height, width):
        return img
    return np.clip(np.rint(_weights(img.shape[0], height) @ img @ _weights(img.shape[1], width).T), 0, 255).astype(np.uint8)


def largest_group(mask: np.ndarray) -> np.ndarray | None:
    """The largest 4-connected group of a mask; the first of equals, by rows."""
    rows, cols = mask.shape
    label, sizes = np.zeros(mask.shape, np.int64), [0]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if label[y, x]:
            continue
        sizes.append(0)
        stack = [(y, x)]
        label[y, x] = len(sizes) - 1
        while stack:
            cy, cx = stack.pop()
            sizes[-1] += 1
            for ny, nx in ((cy, cx - 1), (cy, cx + 1), (cy - 1, cx), (cy + 1, cx)):
                if 0 <= ny < rows and 0 <= nx < cols and mask[ny, nx] and not label[ny, nx]:
                    label[ny, nx] = len(sizes) - 1
                    stack.append((ny, nx))
    return label == int(np.argmax(sizes)) if len(sizes) > 1 else None


def content_bounds(img: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x, y, width, height) of the page, or None where there is nothing to crop."""
    h, w = img.shape
    if min(h, w) < 4 * CELL:
        return None
    scale = min(1.0, WORK_SIDE / max(h, w))
    small = resized(img, max(4 * CELL, int(h * scale)), max(4 * CELL, int(w * scale)))
    rows, cols = small.shape[0] // CELL, small.shape[1] // CELL
    cells = small[: rows * CELL, : cols * CELL].reshape(rows, CELL, cols, CELL)
    ink = cells.max(axis=(1, 3)).astype(int) - cells.min(axis=(1, 3)) >= CONTRAST
    around = np.pad(ink, BRIDGE)
    grown = np.any([around[dy : dy + rows, dx : dx + cols] for dy in range(2 * BRIDGE + 1) for dx in range(2 * BRIDGE + 1)], axis=0)
    group = largest_group(grown)
    if group is None or not (group & ink).any():
        return None
    y, x = np.nonzero(group & ink)
    pad = np.floor(max(h, w) * MARGIN + 0.5)
    x0, y0 = max(0.0, x.min() * CELL / scale - pad), max(0.0, y.min() * CELL / scale - pad)
    x1, y1 = min(float(w), (x.max() + 1) * CELL / scale + pad), min(float(h), (y.max() + 1) * CELL / scale + pad)
    width, height = int(x1 - x0), int(y1 - y0)
    if not width or not height or not LEAST <= width * height / (w * h) <= MOST:
        return None
    return int(x0), int(y0), width, height
