"""Small numpy helpers on one grey or colour image; scores are made of their results in Spark."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma of a BGR image, rounded to whole levels."""
    return np.rint(bgr[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.float64)


def hue_and_saturation(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue (0 to 179, two degrees a step) and saturation (0 to 255) of every pixel, as whole levels; grey has hue 0."""
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    most, least = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    spread = np.where(most > least, most - least, 1)
    degrees = np.where(most == r, 60 * (g - b) / spread, np.where(most == g, 120 + 60 * (b - r) / spread, 240 + 60 * (r - g) / spread))
    hue = np.where(most > least, np.rint(degrees % 360 / 2) % 180, 0)
    return hue, np.rint(255 * (most - least) / np.maximum(most, 1))


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box mean of the source area of every new pixel (nearest where the image is smaller)."""
    def edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.arange(m) * n // m
        return low, np.maximum(low + 1, (np.arange(m) + 1) * n // m)

    top, bottom = edges(image.shape[0], height)
    left, right = edges(image.shape[1], width)
    if (bottom - top).max() == 1 and (right - left).max() == 1:
        return np.ascontiguousarray(image[top][:, left], np.float64)
    table = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    table[1:, 1:] = image.cumsum(0).cumsum(1)
    sums = table[bottom][:, right] - table[top][:, right] - table[bottom][:, left] + table[top][:, left]
    return sums / ((bottom - top)[:, None] * (right - left)[None, :])


def laplacian(image: np.ndarray) -> np.ndarray:
    """Four-neighbour Laplacian; edges mirrored without repeating them."""
    p = np.pad(image, 1, mode="reflect")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * image


def dct_matrix(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def perceptual_coefficients(image: np.ndarray) -> np.ndarray:
    """The 64 lowest cosine coefficients of the image at 32 x 32, row by row."""
    c = dct_matrix(32)
    return (c @ resized(image, 32, 32) @ c.T)[:8, :8].ravel()


def blocks(image: np.ndarray, size: int, step: int = 1) -> np.ndarray:
    """(n, size, size): every `step`-th whole block in both directions."""
    h, w = image.shape[0] // size, image.shape[1] // size
    cut = image[: h * size, : w * size].reshape(h, size, w, size).swapaxes(1, 2)
    return cut[::step, ::step].reshape(-1, size, size)


def median_residual(image: np.ndarray) -> np.ndarray:
    """The image without its 3 x 3 median."""
    p = np.pad(image, 1, mode="edge")
    around = np.lib.stride_tricks.sliding_window_view(p, (3, 3)).reshape(*image.shape, 9)
    return image - np.median(around, axis=-1)


def spectrum(image: np.ndarray, hole: int) -> np.ndarray:
    """Magnitudes around the centre, a square of `hole` places on each side of it emptied."""
    f = np.abs(np.fft.fftshift(np.fft.fft2(image)))
    y, x = image.shape[0] // 2, image.shape[1] // 2
    f[y - hole : y + hole + 1, x - hole : x + hole + 1] = 0
    return f


@lru_cache(16)
def ring(shape: tuple[int, int], inner: float, outer: float) -> np.ndarray:
    y, x = np.indices(shape)
    r = np.hypot(y - shape[0] // 2, x - shape[1] // 2)
    inside = (r >= inner) & (r <= outer)
    inside.setflags(write=False)
    return inside


@lru_cache(4)
def _ring_places(side: int, inner: float, outer: float) -> np.ndarray:
    """Of every place of the ring around the centre of a square spectrum, the place in its half by columns that has its magnitude."""
    y, x = (v - side // 2 for v in np.nonzero(ring((side, side), inner, outer)))
    return np.where(x < 0, -x, x) * side + np.where(x < 0, -y, y) % side


def ring_magnitudes(image: np.ndarray, side: int, inner: float, outer: float) -> np.ndarray:
    """Magnitudes of the image, resized to a square, between two distances from the centre.

    Those of a real image are equal on opposite sides, so half of the columns, up
    to the outer distance, do; a line that resizing repeats is transformed once.
    """
    lines = min(image.shape[0], side)
    rows = np.fft.rfft(resized(image, lines, side))[:, : int(outer) + 1].T
    return np.abs(np.fft.fft(rows[:, np.arange(side) * lines // side])).ravel()[_ring_places(side, inner, outer)]


def local_patterns(image: np.ndarray) -> np.ndarray:
    """Local binary pattern of every inner pixel: a bit for each neighbour not darker than it."""
    c = image[1:-1, 1:-1]
    out = np.zeros(c.shape, np.int64)
    for bit, (dy, dx) in enumerate([(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]):
        out |= (image[dy : dy + c.shape[0], dx : dx + c.shape[1]] >= c).astype(np.int64) << bit
    return out


def weighed(image: np.ndarray, k: np.ndarray, mode: str) -> np.ndarray:
    """Both directions weighed by `k`, edges padded by `mode`."""
    reach, (h, w) = len(k) // 2, image.shape
    p = np.pad(image, reach, mode=mode)
    rows = sum(x * p[i : i + h] for i, x in enumerate(k))
    return sum(x * rows[:, i : i + w] for i, x in enumerate(k))


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, edges mirrored."""
    reach = max(1, int(3 * sigma + 0.5))
    k = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    return weighed(image, k / k.sum(), "symmetric")


def unsharp(image: np.ndarray, sigma: float, strength: float) -> np.ndarray:
    return np.clip(image * (1 + strength) - blurred(image, sigma) * strength, 0, 255)


def laplacian_sharpened(image: np.ndarray) -> np.ndarray:
    """The image less its Laplacian over the diagonal neighbours, which is held within 128 levels."""
    p = np.pad(image, 1, mode="reflect")
    diagonal = 2 * (p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]) - 8 * image
    return np.clip(image - np.clip(diagonal, -128, 128), 0, 255)


def high_passed(image: np.ndarray, sigma: float, share: float) -> np.ndarray:
    """The image and a share of what is brighter in it than in its blur."""
    return np.clip(image + share * np.maximum(0, image - blurred(image, sigma)), 0, 255)


def gamma(image: np.ndarray, g: float) -> np.ndarray:
    return 255 * (image / 255) ** (1 / g)


def otsu(image: np.ndarray) -> np.ndarray:
    """0 or 255 by the level that parts the histogram best."""
    share = np.bincount(np.clip(image, 0, 255).astype(np.int64).ravel(), minlength=256) / image.size
    below, mean = share.cumsum(), (share * np.arange(256)).cumsum()
    spread = (mean[-1] * below - mean) ** 2 / np.maximum(below * (1 - below), 1e-12)
    return np.where(image > spread.argmax(), 255.0, 0.0)


def wiener(image: np.ndarray, size: int, noise: float) -> np.ndarray:
    """Deconvolution of a box blur."""
    kernel = np.zeros(image.shape)
    kernel[:size, :size] = 1 / size**2
    h = np.fft.fft2(np.roll(kernel, (-(size // 2), -(size // 2)), (0, 1)))
    return np.clip(np.real(np.fft.ifft2(np.fft.fft2(image) * np.conj(h) / (np.abs(h) ** 2 + noise))), 0, 255)


def gaussian_wiener(image: np.ndarray, size: int, noise: float) -> np.ndarray:
    """Deconvolution of a Gaussian blur over `size` pixels."""
    line = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * (0.3 * ((size - 1) * 0.5 - 1) + 0.8) ** 2))
    kernel = np.zeros(image.shape)
    kernel[:size, :size] = np.outer(line, line) / line.sum() ** 2
    h = np.fft.fft2(np.roll(kernel, (-(size // 2), -(size // 2)), (0, 1)))
    return np.clip(np.abs(np.fft.ifft2(np.fft.fft2(image) * np.conj(h) / (np.abs(h) ** 2 + noise))), 0, 255)


def adaptive(image: np.ndarray, block: int, less: float) -> np.ndarray:
    """255 where a pixel is brighter than the Gaussian mean of its block, less a constant; else 0."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(block) - block // 2) ** 2) / (2 * sigma**2))
    return np.where(image > np.rint(weighed(image, k / k.sum(), "edge")) - less, 255.0, 0.0)


def stretched(image: np.ndarray, height: int, width: int, pick) -> np.ndarray:
    """Each pixel's greatest (np.max) or least (np.min) in a window that begins half a window before it."""
    pad = [((n - 1) // 2 if pick is np.min else n // 2, n // 2 if pick is np.min else (n - 1) // 2) for n in (height, width)]
    p = np.pad(image, pad, constant_values=255 if pick is np.min else 0)
    return pick(np.lib.stride_tricks.sliding_window_view(p, (height, width)), axis=(2, 3))


def opened(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return stretched(stretched(image, height, width, np.min), height, width, np.max)


def closed(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return stretched(stretched(image, height, width, np.max), height, width, np.min)


def equalised(image: np.ndarray, clip: float, tiles: int) -> np.ndarray:
    """Contrast by the clipped histograms of a grid of tiles, their levels interpolated between tile centres."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    levels = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric").astype(np.int64)
    maps = np.empty((tiles, tiles, 256))
    most = max(1, int(clip * th * tw / 256))
    for r in range(tiles):
        for c in range(tiles):
            n = np.bincount(levels[r * th : (r + 1) * th, c * tw : (c + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - most, 0).sum())
            n = np.minimum(n, most) + over // 256
            rest = over % 256
            if rest:
                n[:: max(1, 256 // rest)][:rest] += 1
            maps[r, c] = np.clip(np.rint(n.cumsum() * 255 / (th * tw)), 0, 255)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda r, c: maps[np.clip(r, 0, tiles - 1)[:, None], np.clip(c, 0, tiles - 1)[None, :], levels[:h, :w]]
    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.rint(top * (1 - fy) + low * fy)


def bilateral(image: np.ndarray, size: int, levels: float, places: float) -> np.ndarray:
    """Mean of the pixels in a disc, weighed by nearness in place and in level."""
    r = size // 2
    p = np.pad(image, r, mode="reflect")
    total, weight = np.zeros(image.shape), np.zeros(image.shape)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                v = p[r + dy : r + dy + image.shape[0], r + dx : r + dx + image.shape[1]]
                k = np.exp(-((v - image) ** 2) / (2 * levels**2) - (dy * dy + dx * dx) / (2 * places**2))
                total, weight = total + k * v, weight + k
    return total / weight


def enlarged(image: np.ndarray, times: int) -> np.ndarray:
    """Cubic interpolation (a = -0.75), edges repeated."""
    def weights(n: int) -> np.ndarray:
        at = (np.arange(n * times) + 0.5) / times - 0.5
        out = np.zeros((n * times, n))
        for k in range(-1, 3):
            place = np.floor(at).astype(int) + k
            d = np.abs(at - place)
            near, far = 1.25 * d**3 - 2.25 * d**2 + 1, -0.75 * (d**3 - 5 * d**2 + 8 * d - 4)
            np.add.at(out, (np.arange(n * times), np.clip(place, 0, n - 1)), np.where(d <= 1, near, np.where(d < 2, far, 0)))
        return out

    return np.clip(np.rint(weights(image.shape[0]) @ image @ weights(image.shape[1]).T), 0, 255)


def without_colours(bgr: np.ndarray, ranges) -> np.ndarray:
    """White where hue, saturation and brightness lie in one of the ranges (low, high hue, least saturation, least brightness), or within 4 pixels of there."""
    hue, saturation = hue_and_saturation(bgr)
    bright = bgr[..., :3].max(-1)
    held = np.any([(hue >= low) & (hue <= high) & (saturation >= s) & (bright >= v) for low, high, s, v in ranges], axis=0)
    return np.where(stretched(held.astype(np.float64), 9, 9, np.max)[..., None] > 0, 255, bgr).astype(np.uint8)


def recompression_error(image: np.ndarray, step: float = 8.0) -> np.ndarray:
    """What rounding the cosine coefficients of 8 x 8 blocks to coarse steps changes, pixel by pixel."""
    c = dct_matrix(8)
    b = blocks(image, 8)
    coarse = step * (1 + np.add.outer(np.arange(8), np.arange(8)) / 2)
    back = c.T @ (np.rint((c @ b @ c.T) / coarse) * coarse) @ c
    return np.abs(b - back)


def texture_cells(image: np.ndarray, cells: int = 4) -> np.ndarray:
    """Of a grid of cells of the image at 100 x 100: how many pixels are, and are not, brighter than their blur; of unit length each."""
    side = 100 // cells
    small, out = np.rint(resized(image, 100, 100)), []
    for y in range(0, cells * side, side):
        for x in range(0, cells * side, side):
            cell = small[y : y + side, x : x + side]
            above = int((cell > np.rint(weighed(cell, np.array([0.25, 0.5, 0.25]), "reflect"))).sum())
            pair = np.array([cell.size - above, above], np.float64)
            out.append(pair / np.linalg.norm(pair))
    return np.concatenate(out)


def distances_to_ground(ink: np.ndarray) -> np.ndarray:
    """Euclidean distance of every ink pixel to the nearest pixel without ink; infinite where there is none."""
    h, w = ink.shape
    up = np.full((h, w), np.inf)
    for y in range(h):
        up[y] = np.where(ink[y], (up[y - 1] + 1) if y else np.inf, 0)
    for y in range(h - 2, -1, -1):
        up[y] = np.minimum(up[y], up[y + 1] + 1)
    x = np.arange(w)
    return np.sqrt(np.array([((x[:, None] - x[None, :]) ** 2 + row[None, :] ** 2).min(1) for row in up]))[ink]


def gradients(image: np.ndarray) -> np.ndarray:
    """Sobel magnitudes, edges mirrored."""
    p = np.pad(image, 1, mode="reflect")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.hypot(gx, gy)
