"""Features of decoded images: numpy kernels behind Arrow-batched UDFs.

Input columns are those of `sources.readers.pixels`.  Every kernel works on a whole
image with array operations; an image that cannot be used gives nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def rgb(data: bytes, width: int, height: int, channels: int) -> np.ndarray | None:
    """Rows x columns x (r, g, b) as numbers from 0 to 255."""
    if not data or width <= 0 or height <= 0 or len(data) < width * height * channels:
        return None
    a = np.frombuffer(data, np.uint8, width * height * channels).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2).astype(np.float64) if channels == 1 else a[:, :, 2::-1].astype(np.float64)


def luma(a: np.ndarray) -> np.ndarray:
    return (a[:, :, 0] * 299 + a[:, :, 1] * 587 + a[:, :, 2] * 114) / 1000


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean over a grid of cells (area averaging); small images are repeated first."""
    h, w = a.shape[:2]
    a = np.repeat(a, -(-height // h), axis=0) if h < height else a
    a = np.repeat(a, -(-width // w), axis=1) if w < width else a
    rows, cols = np.linspace(0, a.shape[0], height + 1).astype(int), np.linspace(0, a.shape[1], width + 1).astype(int)
    s = np.add.reduceat(np.add.reduceat(a, rows[:-1], axis=0), cols[:-1], axis=1)
    area = np.diff(rows)[:, None] * np.diff(cols)[None, :]
    return s / (area[:, :, None] if a.ndim == 3 else area)


def _signed(bits: np.ndarray) -> int:
    """The bits, first one highest, as a signed 64-bit number."""
    v = int("".join("1" if b else "0" for b in bits.ravel()), 2)
    return v - (1 << 64) if v >= 1 << 63 else v


def dct(n: int) -> np.ndarray:
    """The DCT-II matrix of size n with orthogonal scaling."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def hashes(a: np.ndarray) -> dict:
    """dh, dh16, ph, ah, ch16, chh and the 16-bin histogram of one frame."""
    base = resized(a, 64, 64)
    gray = luma(base)
    small = lambda h, w: resized(gray, h, w)
    nine, five, eight = small(8, 9), small(4, 5), small(8, 8)
    m = dct(32)
    c = (m @ small(32, 32) @ m.T)[:8, :8]
    whole = base.astype(np.int64)
    bins = np.bincount(((whole[:, :, 0] ^ whole[:, :, 1] ^ whole[:, :, 2]) >> 4).ravel(), minlength=16)[:16]
    lum = resized(luma(base) // 1, 4, 5)
    return {
        "dh": _signed(nine[:, :-1] > nine[:, 1:]),
        "dh16": _signed(five[:, :-1] > five[:, 1:]),
        "ph": _signed(c > np.median(c.ravel()[1:])),
        "ah": _signed(eight > eight.mean()),
        "ch16": _signed(lum[:, :-1] > lum[:, 1:]),
        "chh": _signed(bins * 2 > bins.sum()),
        "hist": [int(b) for b in bins],
    }


def palette(a: np.ndarray, colours: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``colours`` mean colours with their counts by median cut of a thumbnail of at most 200 pixels a side."""
    h, w = a.shape[:2]
    scale = min(1.0, 200 / max(h, w))
    p = resized(a, max(1, int(h * scale)), max(1, int(w * scale))).reshape(-1, 3)
    boxes = [p]
    while len(boxes) < colours:
        spread = [np.ptp(b, axis=0).max() * (len(b) > 1) for b in boxes]
        k = int(np.argmax(spread))
        if spread[k] <= 0:
            break
        b = boxes.pop(k)
        dim = int(np.argmax(np.ptp(b, axis=0)))
        order = np.argsort(b[:, dim], kind="stable")
        half = len(b) // 2
        boxes += [b[order[:half]], b[order[half:]]]
    return np.array([b.mean(0) for b in boxes]), np.array([len(b) for b in boxes])


def hsv(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value in percent."""
    x = a / 255.0
    most, least = x.max(-1), x.min(-1)
    d = most - least
    safe = np.where(d == 0, 1, d)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    h = np.where(most == r, ((g - b) / safe) % 6, np.where(most == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60
    return np.where(d == 0, 0.0, h), np.where(most == 0, 0.0, d / np.where(most == 0, 1, most)) * 100, most * 100


def _convolve(g: np.ndarray, k: np.ndarray) -> np.ndarray:
    p = np.pad(g, 1, mode="edge")
    return sum(k[i, j] * p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3))


SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)


def quality(a: np.ndarray) -> dict:
    """Sharpness (variance of the Laplacian of at most 512 pixels a side), aesthetic score, noise, Tenengrad."""
    h, w = a.shape[:2]
    s = min(1.0, 512 / max(h, w))
    g = resized(luma(a), max(1, int(h * s)), max(1, int(w * s)))
    sharp = float(_convolve(g, LAPLACE).var())
    _, sat, _ = hsv(resized(a, min(h, 64), min(w, 64)))
    light, colour = float(g.mean() / 255), float(sat.mean() / 100)
    clip = lambda x: min(1.0, max(0.0, x))
    aesthetic = 0.35 * min(h * w / 8_294_400, 1) + 0.30 * min(sharp / 600, 1) + 0.20 * clip(1 - 1.6 * abs(light - 0.55)) + 0.15 * clip(1 - 1.5 * abs(colour - 0.30))
    noise = np.abs(_convolve(g, np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]], float))).mean() * np.sqrt(np.pi / 2) / 6
    gx, gy = _convolve(g, SOBEL), _convolve(g, SOBEL.T)
    return {"sharpness": sharp, "aesthetic": aesthetic, "noise_estimate": float(noise), "tenengrad": float(np.sqrt(gx * gx + gy * gy).mean()), "is_dark": float(resized(luma(a), 16, 16).mean() < 20)}


def texture(a: np.ndarray) -> dict:
    """Edges, entropy, local variance, co-occurrence and spectrum of a 128-pixel thumbnail."""
    g = resized(luma(a), 128, 128)
    gx, gy = _convolve(g, SOBEL), _convolve(g, SOBEL.T)
    mag = np.hypot(gx, gy)
    hist = np.bincount(np.clip(g, 0, 255).astype(int).ravel(), minlength=256) / g.size
    entropy = float(-(hist[hist > 0] * np.log2(hist[hist > 0])).sum())
    q = np.clip(g / 32, 0, 7).astype(int)
    glcm = np.bincount((q[:, :-1] * 8 + q[:, 1:]).ravel(), minlength=64).reshape(8, 8) / (q.size - len(q))
    i, j = np.indices((8, 8))
    f = np.abs(np.fft.fftshift(np.fft.fft2(g)))
    y, x = np.indices(f.shape)
    radius = np.hypot(y - 64, x - 64)
    low, high = f[radius <= 16].sum(), f[radius > 16].sum()
    auto = np.fft.ifft2(np.abs(np.fft.fft2(g - g.mean())) ** 2).real
    peak = auto[8:56, :].max() / auto[0, 0] if auto[0, 0] > 1e-9 else 0.0
    flips = lambda b: float(1 - np.abs(g - b).mean() / 255)
    return {
        "edge_density": float((mag > 100).mean()), "mean_edge_magnitude": float(mag.mean()), "entropy": entropy, "texture_entropy": float(-(glcm[glcm > 0] * np.log2(glcm[glcm > 0])).sum()),
        "glcm_contrast": float(((i - j) ** 2 * glcm).sum()), "texture_energy": float((glcm**2).sum()), "homogeneity": float((glcm / (1 + np.abs(i - j))).sum()), "local_variance": float(np.var(g)),
        "high_low_ratio": float(high / low) if low > 0 else 0.0, "periodicity_score": float(max(0.0, min(1.0, peak))), "h_symmetry": flips(g[:, ::-1]), "v_symmetry": flips(g[::-1]), "point_symmetry": flips(g[::-1, ::-1]),
        "main_diagonal_symmetry": flips(g.T), "overall_symmetry": max(flips(g[:, ::-1]), flips(g[::-1]), flips(g[::-1, ::-1])),
    }


def composition(a: np.ndarray) -> dict:
    """Otsu foreground, its place and contrast, colour moments, colourfulness."""
    t = resized(a, 96, 96)
    g = luma(t)
    hist = np.bincount(np.clip(g, 0, 255).astype(int).ravel(), minlength=256).astype(float)
    w, m = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w)))
    cut = int(np.argmax(between))
    fg = g > cut
    fg = ~fg if fg.mean() > 0.5 else fg
    y, x = np.nonzero(fg)
    cx, cy = (x.mean() / 95, y.mean() / 95) if len(x) else (0.5, 0.5)
    rg, yb = t[:, :, 0] - t[:, :, 1], (t[:, :, 0] + t[:, :, 1]) / 2 - t[:, :, 2]
    colourful = np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())
    h, s, v = hsv(t)
    thirds = min(np.hypot(cx - p, cy - q) for p in (1 / 3, 2 / 3) for q in (1 / 3, 2 / 3))
    return {
        "subject_area_ratio": float(fg.mean()), "centeredness": float(max(0.0, 1 - 2 * np.hypot(cx - 0.5, cy - 0.5))), "thirds_score": float(max(0.0, 1 - 3 * thirds)),
        "fg_bg_contrast": float(abs(g[fg].mean() - g[~fg].mean()) / 255) if fg.any() and not fg.all() else 0.0, "colorfulness": float(colourful), "hsv_S_mean": float(s.mean()), "hsv_V_mean": float(v.mean()),
        "skin_fraction": float(((h >= 5) & (h <= 38) & (s >= 15) & (s <= 65) & (v >= 35) & (v <= 92)).mean()), "unique_colors": float(min(256, len(np.unique((t // 8).reshape(-1, 3), axis=0)))),
    }


HASH_SCHEMA = "path string, dh bigint, dh16 bigint, ph bigint, ah bigint, ch16 bigint, chh bigint, hist array<int>"


def _rows(kernel: Callable[[np.ndarray], dict], names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, w, h, c, data in zip(b["path"], b["width"], b["height"], b["channels"], b["data"], strict=True):
                a = rgb(data, int(w), int(h), int(c))
                out.append({"path": path} | (kernel(a) if a is not None else dict.fromkeys(names)))
            yield pd.DataFrame(out, columns=["path", *names])

    return run


def image_hashes(images: DataFrame) -> DataFrame:
    """``path`` and all hashes of every image."""
    names = [f.split()[0] for f in HASH_SCHEMA.split(", ")[1:]]
    return images.mapInPandas(_rows(hashes, names), HASH_SCHEMA)


def image_features(images: DataFrame, families: tuple[Callable[[np.ndarray], dict], ...] = (quality, texture, composition)) -> DataFrame:
    """``path`` and the numbers of the chosen families; families that are not chosen cost nothing."""
    probe = np.zeros((8, 8, 3))
    names = [n for f in families for n in f(probe)]

    def kernel(a: np.ndarray) -> dict:
        out: dict = {}
        for f in families:
            out |= f(a)
        return out

    return images.mapInPandas(_rows(kernel, names), "path string, " + ", ".join(f"{n} double" for n in names))


def image_palettes(images: DataFrame) -> DataFrame:
    """``path, r, g, b, share``: the palette of every image, for the colour expressions of `functions.colour`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, w, h, c, data in zip(batch["path"], batch["width"], batch["height"], batch["channels"], batch["data"], strict=True):
                a = rgb(data, int(w), int(h), int(c))
                if a is not None:
                    colours, counts = palette(a)
                    out += [(path, *map(int, np.round(x)), n / counts.sum()) for x, n in zip(colours, counts, strict=True)]
            yield pd.DataFrame(out, columns=["path", "r", "g", "b", "share"])

    return images.mapInPandas(run, "path string, r int, g int, b int, share double")
