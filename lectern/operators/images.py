"""Stages of page-image clean-up on grey-scale arrays, as functions and as one Arrow operator over binary columns.

An image is 8-bit grey in binary PGM, which needs no decoder library; other formats are turned into it by any ``decode`` passed in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode_pgm(data: bytes) -> np.ndarray:
    m = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", data)
    if not m:
        raise ValueError("not a binary PGM image")
    w, h = int(m[1]), int(m[2])
    return np.frombuffer(data, np.uint8, w * h, m.end()).reshape(h, w)


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % image.shape[::-1] + image.astype(np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over windows of side 2r + 1, edges repeated."""
    p = np.pad(a.astype(float), r + 1, mode="edge").cumsum(0).cumsum(1)
    n = 2 * r + 1
    return (p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n])[: a.shape[0], : a.shape[1]] / n**2


def diagnose(a: np.ndarray) -> dict[str, float]:
    """Brightness, contrast, sharpness (variance of the Laplacian) and noise (mean distance from the 3 x 3 mean)."""
    f = a.astype(float)
    lap = -4 * f[1:-1, 1:-1] + f[:-2, 1:-1] + f[2:, 1:-1] + f[1:-1, :-2] + f[1:-1, 2:] if min(a.shape) > 2 else np.zeros(1)
    return {"brightness": float(f.mean()), "contrast": float(f.std()), "sharpness": float(lap.var()), "noise": float(np.abs(f - _box(a, 1)).mean())}


def normalise(a: np.ndarray) -> np.ndarray:
    """Dark pages inverted, dim ones lifted by gamma, the range stretched to the 1st and 99th percentile."""
    if a.mean() < 80:
        a = 255 - a
    f = a / 255.0
    if a.mean() < 100:
        f = f ** (1 / 1.8)
    low, high = np.percentile(f, [1, 99])
    return (np.clip((f - low) / max(high - low, 1e-6), 0, 1) * 255).astype(np.uint8)


def denoise(a: np.ndarray) -> np.ndarray:
    """Median of 3 x 3."""
    p = np.pad(a, 1, mode="edge")
    return np.median(np.stack([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def crop_border(a: np.ndarray, dark: int = 60) -> np.ndarray:
    """Without dark margins, if at least half of both sides is left."""
    rows, cols = np.nonzero(a.mean(1) > dark)[0], np.nonzero(a.mean(0) > dark)[0]
    if len(rows) < a.shape[0] / 2 or len(cols) < a.shape[1] / 2:
        return a
    return a[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]


def flatten_shadow(a: np.ndarray, radius: int = 25) -> np.ndarray:
    """Divided by its own local mean."""
    return np.clip(a / np.maximum(_box(a, radius), 1) * 235, 0, 255).astype(np.uint8)


def skew_angle(a: np.ndarray, most: float = 5.0, step: float = 0.25) -> float:
    """The angle, in degrees, at which the rows of ink are sharpest."""
    ink = (a < a.mean() - a.std() / 2).astype(float)
    y, x = np.nonzero(ink)
    if len(y) < 20:
        return 0.0
    best, found = -1.0, 0.0
    for angle in sorted(np.arange(-most, most + step / 2, step), key=abs):
        line = np.round(y - x * np.tan(np.radians(angle))).astype(int)
        sharp = float((np.diff(np.bincount(line - line.min())) ** 2).sum())
        if sharp > best:
            best, found = sharp, float(angle)
    return found


def deskew(a: np.ndarray, least: float = 0.3) -> np.ndarray:
    """Columns shifted by the skew angle, if it is at least ``least`` degrees; what comes in at the edges is white."""
    angle = skew_angle(a)
    if abs(angle) < least:
        return a
    rows = np.arange(a.shape[0])[:, None] + np.round(np.arange(a.shape[1]) * np.tan(np.radians(angle))).astype(int)[None, :]
    inside = (rows >= 0) & (rows < a.shape[0])
    return np.where(inside, np.take_along_axis(a, np.clip(rows, 0, a.shape[0] - 1), axis=0), 255).astype(a.dtype)


def whiten(a: np.ndarray, above: int = 190) -> np.ndarray:
    """Faint marks such as watermarks set to white."""
    return np.where(a >= above, 255, a).astype(np.uint8)


def sharpen(a: np.ndarray) -> np.ndarray:
    """Unsharp mask, stronger for blurred pages."""
    s = diagnose(a)["sharpness"]
    amount = 1.5 if s < 100 else 0.8 if s < 500 else 0.3
    return np.clip(a + amount * (a - _box(a, 1)), 0, 255).astype(np.uint8)


def otsu_threshold(a: np.ndarray) -> int:
    n = np.bincount(a.ravel(), minlength=256).astype(float)
    w = n.cumsum()
    m = (n * np.arange(256)).cumsum()
    between = (m[-1] * w - m * w[-1]) ** 2 / np.maximum(w * (w[-1] - w), 1)
    return int(between.argmax())


def binarise(a: np.ndarray) -> tuple[np.ndarray, str]:
    """The best of Otsu, local mean and Sauvola by how near the share of ink is to 12 %; ink is 0."""
    mean = _box(a, 12)
    dev = np.sqrt(np.maximum(_box(a.astype(float) ** 2, 12) - mean**2, 0))
    options = {"otsu": a > otsu_threshold(a), "mean": a > mean - 10, "sauvola": a > mean * (1 + 0.2 * (dev / 128 - 1))}
    name = max(options, key=lambda k: 1 - abs((~options[k]).mean() - 0.12) * 4)
    return np.where(options[name], 255, 0).astype(np.uint8), name


def clean_specks(b: np.ndarray, least: int = 3) -> np.ndarray:
    """Ink pixels with fewer than ``least`` ink pixels in their 3 x 3 window removed."""
    ink = (b == 0).astype(float)
    return np.where((b == 0) & (np.round(_box(ink, 1) * 9) < least), 255, b).astype(np.uint8)


def columns_of(b: np.ndarray, most_ink: float = 0.05, least_width: int = 8) -> list[tuple[int, int]]:
    """Text columns: stretches between valleys of the vertical projection."""
    profile = (b == 0).mean(0)
    full = profile > most_ink * max(profile.max(), 1e-9)
    out, start, gap = [], None, 0
    for x, f in enumerate([*full, *[False] * least_width]):
        if f:
            start, gap = (x if start is None else start), 0
        elif start is not None:
            gap += 1
            if gap == least_width:
                out.append((start, x - gap + 1))
                start = None
    return out


def prepare(a: np.ndarray) -> tuple[np.ndarray, dict]:
    """All stages in order, with what was found."""
    found = diagnose(a)
    a = crop_border(normalise(a))
    if found["noise"] > 6:
        a = denoise(a)
    angle = skew_angle(a)
    b, method = binarise(sharpen(whiten(deskew(flatten_shadow(a)))))
    b = clean_specks(b)
    return b, found | {"angle": angle, "method": method, "columns": len(columns_of(b)), "ink": float((b == 0).mean())}


def prepare_images(df: DataFrame, id_col: str, content: str, decode: Callable[[bytes], np.ndarray] = decode_pgm) -> DataFrame:
    """``id, image, brightness, contrast, sharpness, noise, angle, method, columns, ink, error`` of each image; one that cannot be read has an error."""
    names = ["brightness", "contrast", "sharpness", "noise", "angle", "method", "columns", "ink"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, data in zip(pdf["id"], pdf["content"]):
                try:
                    b, found = prepare(decode(bytes(data)))
                    rows.append((i, encode_pgm(b), *[found[n] for n in names], None))
                except Exception as e:  # noqa: BLE001
                    rows.append((i, None, *[None] * len(names), f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["id", "image", *names, "error"]).astype({"columns": "Int64"})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(content).alias("content")).mapInPandas(run, f"id {kind}, image binary, brightness double, contrast double, sharpness double, noise double, angle double, method string, columns int, ink double, error string")
