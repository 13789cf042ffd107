"""Measures of page images (grey, rows by columns of 0 to 255) that decide how an engine is run."""

from __future__ import annotations

import numpy as np


def otsu(grey: np.ndarray) -> int:
    """Threshold with the largest variance between the classes."""
    counts = np.bincount(grey.ravel(), minlength=256).astype(float)
    below = np.cumsum(counts)
    mass = np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.argmax(np.nan_to_num(between)))


def ink(grey: np.ndarray) -> np.ndarray:
    return grey <= otsu(grey)


def ink_fraction(grey: np.ndarray) -> float:
    return float(ink(grey).mean()) if grey.size else 0.0


def sideways_ratio(dark: np.ndarray) -> float:
    """How much more the columns vary than the rows: well above 1 on pages that lie on their side."""
    rows, columns = dark.mean(axis=1), dark.mean(axis=0)
    return float(columns.var() / max(rows.var(), 1e-12))


def skew_degrees(dark: np.ndarray, most: float = 3.0, step: float = 0.1) -> float:
    """The turn whose row sums vary most, by shearing columns."""
    if not dark.any():
        return 0.0
    y, x = np.nonzero(dark)
    x = x - dark.shape[1] / 2
    best, found = -1.0, 0.0
    for angle in sorted(np.arange(-most, most + step / 2, step), key=abs):
        moved = np.round(y - x * np.tan(np.radians(angle))).astype(int)
        score = float((np.bincount(moved - moved.min()).astype(float) ** 2).sum())
        if score > best * (1 + 1e-9):
            best, found = score, float(angle)
    return round(found, 3)


def runs(dark: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(row, first, end) of runs of dark pixels of a length or more, by differences of the padded rows."""
    edge = np.diff(np.pad(dark.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    starts, ends = np.argwhere(edge == 1), np.argwhere(edge == -1)
    long = ends[:, 1] - starts[:, 1] >= least
    return [(int(r), int(a), int(b)) for (r, a), b in zip(starts[long], ends[long][:, 1], strict=True)]


def rules(dark: np.ndarray, least: int) -> list[dict]:
    """Horizontal and vertical rulings: long runs, those in neighbouring rows merged."""
    out = []
    for kind, image in (("h", dark), ("v", dark.T)):
        merged: list[list[int]] = []
        for r, a, b in runs(image, least):
            near = next((m for m in merged if 0 <= r - m[1] <= 1 and min(b, m[3]) - max(a, m[2]) > 0.5 * min(b - a, m[3] - m[2])), None)
            if near:
                near[1], near[2], near[3] = r, min(near[2], a), max(near[3], b)
            else:
                merged.append([r, r, a, b])
        for top, bottom, a, b in merged:
            x0, y0, x1, y1 = (a, top, b, bottom + 1) if kind == "h" else (top, a, bottom + 1, b)
            out.append({"kind": kind, "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)})
    return sorted(out, key=lambda r: (r["kind"], r["y0"], r["x0"]))


def is_rule_word(box: tuple[float, float, float, float], found: list[dict], share: float = 0.8) -> bool:
    """Whether a word's box is a ruling that an engine took for a character."""
    x0, y0, x1, y1 = box
    area = max((x1 - x0) * (y1 - y0), 1e-9)
    return any(max(0.0, min(x1, r["x1"]) - max(x0, r["x0"])) * max(0.0, min(y1, r["y1"]) - max(y0, r["y0"])) >= share * area for r in found)
