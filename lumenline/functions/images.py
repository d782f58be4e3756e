"""Image kernels over numpy arrays (height, width, channels): masks, text rows, signatures, crops.

They are pure functions for use inside ``mapInPandas``; decoding and recognition are callables that the user gives.
"""

from __future__ import annotations

import numpy as np


def white_mask(image: np.ndarray, least: int = 245) -> np.ndarray:
    """Pixels whose channels are all over ``least``."""
    return (image > least).all(axis=-1) if image.ndim == 3 else image > least


def box_any(mask: np.ndarray, size: int) -> np.ndarray:
    """Whether a true pixel stands in the ``size`` x ``size`` box around each pixel (dilation), by sums."""
    r = size // 2
    padded = np.pad(mask.astype(np.int32), ((r + 1, r), (r + 1, r)))
    s = padded.cumsum(0).cumsum(1)
    return s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size] > 0


def edge_white(image: np.ndarray, white: int = 200, dark: int = 90, near: int = 9) -> np.ndarray:
    """White pixels with a dark pixel near them: outlined text rather than bright areas."""
    low, high = (image.min(axis=-1), image.max(axis=-1)) if image.ndim == 3 else (image, image)
    return (low > white) & box_any(high < dark, near)


def row_runs(profile: np.ndarray, ratio: float, gap: int, least_height: int = 1, floor: int = 1, least_peak: int = 1) -> list[tuple[int, int]]:
    """[first, end) of runs of rows with at least ``ratio`` of the peak and ``floor``; runs at most ``gap`` rows apart are one.

    None where the peak is under ``least_peak``.
    """
    peak = int(profile.max(initial=0))
    if peak < least_peak:
        return []
    rows = np.nonzero(profile >= max(floor, int(peak * ratio)))[0]
    cuts = np.nonzero(np.diff(rows) > gap)[0]
    first, last = np.r_[rows[0], rows[cuts + 1]], np.r_[rows[cuts], rows[-1]]
    return [(int(a), int(b) + 1) for a, b in zip(first, last, strict=True) if b + 1 - a >= least_height]


def line_bands(
    image: np.ndarray, top: float, bottom: float, left: float = 0.0, right: float = 1920.0, white: int = 200, ratio: float = 0.12, gap: int = 4, most: float | None = None
) -> list[tuple[int, int, int]]:
    """(first, end, white pixels) of text lines; all places are those of an image of 1920 x 1080.

    Bands of which over ``most`` is white are left out: they are bright areas.
    """
    h, w = image.shape[:2]
    scale = 1080.0 / h
    a, b = max(0, int(top / scale)), min(h, int(bottom / scale))
    mask = white_mask(image[a:b, int(left * w / 1920) : int(right * w / 1920)], white)
    profile = mask.sum(axis=1)
    out = []
    for x, y in row_runs(profile, ratio, gap, floor=3, least_peak=5):
        fill = int(profile[x:y].sum())
        if most is None or fill <= most * max(1, (y - x) * mask.shape[1]):
            out.append((int((a + x) * scale), int(a * scale + y * scale), fill))
    return out


def text_rows(
    image: np.ndarray, top: float = 0.0, bottom: float = 1.0, ratio: float = 0.35, gap: int = 8, least_height: int = 14, pad: int = 6, left: float = 0.0, right: float = 1.0
) -> list[tuple[int, int]]:
    """Bands of outlined text between two relative heights and, for their profile, two relative widths; padded and clamped."""
    h, w = image.shape[:2]
    a, b = int(h * top), int(h * bottom)
    if b - a < least_height:
        return []
    # the mask needs the rows beyond the band that its boxes reach
    low = max(0, a - 18)
    edge = edge_white(image[low : min(h, b + 18)])[a - low : b - low, int(left * w) : int(right * w)]
    return [(max(0, a + x - pad), min(h, a + y + pad)) for x, y in row_runs(edge.sum(axis=1), ratio, gap, least_height, floor=4, least_peak=5)]


def components(mask: np.ndarray) -> np.ndarray:
    """The number of each true pixel's part, by all eight neighbours, 0 for false ones; parts count from 1 in reading order."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        # the least number around, then that of the pixel which has it, until nothing changes
        big = np.where(label > 0, label, h * w + 1)
        around = np.pad(big, 1, constant_values=h * w + 1)
        least = big.copy()
        for dy in range(3):
            for dx in range(3):
                np.minimum(least, around[dy : dy + h, dx : dx + w], out=least)
        least = np.where(label > 0, least, 0)
        flat = np.r_[0, least.ravel()]
        while True:
            up = flat[flat]
            if (up == flat).all():
                break
            flat = up
        new = flat[1:].reshape(h, w)
        if (new == label).all():
            return np.searchsorted(np.unique(label[label > 0]), label, side="left") * mask + mask.astype(int)
        label = new


def glyphs(image: np.ndarray, rows: tuple[int, int], pad: int = 12, white: int = 200, most_width: int = 220, most_height: int = 110, least_area: int = 120):
    """(first column, end, glyphs white on black) of the rows without parts that are too wide, too high or too small; None if none is left."""
    a, b = max(0, rows[0]), min(image.shape[0], rows[1])
    part = components(white_mask(image[a:b], white)) if b > a else np.zeros((0, 0), int)
    if not part.size or not part.max():
        return None
    ys, xs = np.nonzero(part)
    which = part[ys, xs]
    n = int(part.max()) + 1
    area = np.bincount(which, minlength=n)
    bounds = [np.full(n, -1), np.full(n, -1), np.full(n, 1 << 30), np.full(n, 1 << 30)]
    for f, to, at in ((np.maximum, bounds[0], xs), (np.maximum, bounds[1], ys), (np.minimum, bounds[2], xs), (np.minimum, bounds[3], ys)):
        f.at(to, which, at)
    good = (area >= least_area) & (bounds[0] - bounds[2] + 1 <= most_width) & (bounds[1] - bounds[3] + 1 <= most_height)
    good[0] = False
    kept = good[part]
    cols = np.nonzero(kept.any(axis=0))[0]
    if not len(cols):
        return None
    x0, x1 = max(0, int(cols[0]) - pad), min(image.shape[1], int(cols[-1]) + pad)
    return x0, x1, np.where(kept[:, x0:x1], 255, 0).astype(np.uint8)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size, by area means (nearest pixels where it grows)."""
    h, w = image.shape[:2]
    if height > h or width > w:
        image = image[np.arange(max(h, height)) * h // max(h, height)][:, np.arange(max(w, width)) * w // max(w, width)]
    planes = [block_mean(image[..., c], height, width) for c in range(image.shape[2])] if image.ndim == 3 else [block_mean(image, height, width)]
    out = np.rint(np.stack(planes, axis=-1)).astype(image.dtype)
    return out if image.ndim == 3 else out[..., 0]


def letterboxed(image: np.ndarray, height: int = 540, width: int = 960) -> np.ndarray:
    """The whole image within ``height`` x ``width``, its shape kept, in the middle of black."""
    h, w = image.shape[:2]
    scale = min(width / w, height / h)
    made = resized(image, int(h * scale), int(w * scale))
    out = np.zeros((height, width, *image.shape[2:]), image.dtype)
    y, x = (height - made.shape[0]) // 2, (width - made.shape[1]) // 2
    out[y : y + made.shape[0], x : x + made.shape[1]] = made
    return out


def at_most(image: np.ndarray, size: int = 2000) -> np.ndarray:
    """The image itself, or reduced so that neither side is over ``size``."""
    h, w = image.shape[:2]
    scale = min(size / h, size / w)
    return image if scale >= 1 else resized(image, round(h * scale), round(w * scale))


def tight_columns(mask: np.ndarray, pad: int = 12) -> tuple[int, int] | None:
    """[first, end) of the columns with a true pixel, padded and clamped."""
    cols = np.nonzero(mask.any(axis=0))[0]
    return (max(0, int(cols[0]) - pad), min(mask.shape[1], int(cols[-1]) + 1 + pad)) if len(cols) else None


def block_mean(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means over a grid of ``height`` x ``width`` cells."""
    ys = np.linspace(0, a.shape[0], height + 1).astype(int)
    xs = np.linspace(0, a.shape[1], width + 1).astype(int)
    s = np.pad(a.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    total = s[ys[1:]][:, xs[1:]] - s[ys[:-1]][:, xs[1:]] - s[ys[1:]][:, xs[:-1]] + s[ys[:-1]][:, xs[:-1]]
    return total / np.maximum(1, np.outer(np.diff(ys), np.diff(xs)))


def band_signature(image: np.ndarray, height: int = 24, width: int = 192, white: int = 235, least: float = 0.15) -> np.ndarray:
    """Cells of which over ``least`` is white."""
    return block_mean(white_mask(image, white), height, width) > least


def crop_binary(image: np.ndarray, rows: tuple[int, int], upscale: int = 2, white: int = 200) -> np.ndarray:
    """The rows, enlarged, black on white."""
    part = white_mask(image[rows[0] : rows[1]], white)
    return np.where(np.repeat(np.repeat(part, upscale, 0), upscale, 1), 0, 255).astype(np.uint8)


def crop_box(image: np.ndarray, box: tuple[int, int, int, int], margin: int = 10) -> np.ndarray:
    """The box (x0, y0, x1, y1) with a margin, clamped to the image."""
    x0, y0, x1, y1 = box
    h, w = image.shape[:2]
    return image[max(0, y0 - margin) : min(h, y1 + margin), max(0, x0 - margin) : min(w, x1 + margin)]
