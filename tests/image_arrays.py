"""Images as arrays: the plain forms that the tests compare with."""

import math

import numpy as np


def block_average(image: np.ndarray, size: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Means over size x size blocks; blocks cut at the edge are means of what they have."""
    h, w = image.shape
    wt = np.ones_like(image) if weight is None else weight
    pad = ((0, -h % size), (0, -w % size))
    fold = lambda a: np.pad(a, pad).reshape(-(-h // size), size, -(-w // size), size).sum((1, 3))
    total = fold(wt)
    return np.divide(fold(image * wt), total, out=np.zeros_like(total), where=total > 0)


def smooth(image: np.ndarray, sigma: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Separable Gaussian with weights; edges renormalise by the weight they see."""
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)

    def along(a, axis):
        padded = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(2)])
        return sum(k[i] * np.take(padded, range(i, i + a.shape[axis]), axis=axis) for i in range(2 * r + 1))

    wt = np.ones_like(image) if weight is None else weight
    norm = along(along(wt, 0), 1)
    return np.divide(along(along(image * wt, 0), 1), norm, out=np.zeros_like(norm), where=norm > 0)


def median_background(image: np.ndarray, half: int) -> np.ndarray:
    """Medians on a grid of half-width boxes, joined linearly."""
    h, w = image.shape
    ys, xs = (np.unique(np.r_[np.arange(0, n, max(1, half)), n - 1]) for n in (h, w))
    grid = np.array([[np.median(image[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1]) for x in xs] for y in ys])
    rows = np.array([np.interp(np.arange(w), xs, g) for g in grid])
    return np.array([np.interp(np.arange(h), ys, rows[:, x]) for x in range(w)]).T


def noise_sigma(image: np.ndarray, offset: int = 5) -> float:
    """Noise from differences of pixel pairs on a diagonal, sampled on a grid: 68th percentile over sqrt 2."""
    step = max(1, min(20, min(image.shape) // 4))
    a = image[: -offset or None : step, : -offset or None : step]
    b = image[offset::step, offset::step][: a.shape[0], : a.shape[1]]
    a = a[: b.shape[0], : b.shape[1]]
    return float(np.percentile(np.abs(a - b), 68.27) / math.sqrt(2)) if a.size else 0.0


def label_components(mask: np.ndarray) -> np.ndarray:
    """8-connected components numbered from 1 in reading order, by minimum propagation; 0 elsewhere."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        p = np.pad(np.where(label > 0, label, big), 1, constant_values=big)
        low = np.min([p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        new = np.where(mask, low, 0)
        new = np.where(mask, np.minimum(new, np.r_[0, np.where(mask, new, 0).ravel()][new]), 0)
        if (new == label).all():
            break
        label = new
    names, out = np.unique(label[mask], return_inverse=True)
    result = np.zeros(mask.shape, int)
    result[mask] = out + 1
    return result


def centroid3(patch: np.ndarray) -> tuple[float, float] | None:
    """Peak of parabolas through the middle row and column of a 3 x 3 patch; None where it falls outside."""
    out = []
    for a, b, c in (patch[1], patch[:, 1]):
        d = a - 2 * b + c
        if d >= 0:
            return None
        out.append(0.5 * (a - c) / d)
    return (out[0], out[1]) if max(map(abs, out)) <= 1 else None


def extract_sources(image: np.ndarray, psf: float = 1.0, limit: float = 8.0, half: int = 100, most: int = 10_000) -> list[tuple[float, float, float, float]]:
    """(x, y, flux, background), brightest first: background off, smoothed, peaks among significant pixels.

    At most ``most`` of an image are returned, the brightest. Every peak lies in the box around its own significant pixel, so boxes and their components are not needed to find it.
    """
    image = np.asarray(image, float)
    back = median_background(image, half)
    flat = image - back
    sigma = noise_sigma(flat)
    soft = smooth(flat, psf)
    significant = soft > limit * sigma / (2 * math.sqrt(math.pi) * psf)
    out = []
    edge = np.pad(soft, 1, constant_values=-np.inf)
    peak = np.all([soft >= edge[1 + dy : edge.shape[0] - 1 + dy, 1 + dx : edge.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0) & significant
    for y, x in zip(*np.nonzero(peak), strict=True):
        if 0 < y < image.shape[0] - 1 and 0 < x < image.shape[1] - 1:
            shift = centroid3(soft[y - 1 : y + 2, x - 1 : x + 2])
            if shift:
                fx, fy = x + shift[0], y + shift[1]
                ry, rx = (min(max(round(v), 0), n - 1) for v, n in ((fy, image.shape[0]), (fx, image.shape[1])))
                out.append((float(fx), float(fy), float(flat[ry, rx]), float(back[ry, rx])))
    return sorted(out, key=lambda s: (-s[2], s[0], s[1]))[:most]
