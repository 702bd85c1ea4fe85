"""Page layout (own design; only its inputs and outputs are given): how askew a page stands, and where its text blocks are.

A page is a row: key, width, and its grey levels line by line. Pages are judged one by one inside the tasks, so work is spread as the
table is, and a task holds one page.

Skew: turned by the right angle, text lines and the gaps between them stand apart most, so the angle is the one whose profile
of dark pixels by line has the greatest sum of squared differences between neighbours; first in steps of a degree, then finer round the best.
Regions: cells that hold enough dark pixels, connected by touching (corners too), are one region; the ones with most ink come first.

Null pages, pages without width and ones with fewer than LEAST_INK dark pixels have no angle (null) and no regions; a last line that isn't
whole is left out.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Greatest angle looked for, in degrees, and the finest step.
MOST_TURN, STEP = 15.0, 0.125
#: Grey below which a pixel is dark; pixels that make a page worth a look.
DARK, LEAST_INK = 128, 200
#: Cells of regions, in pixels, the share of dark pixels that fills one, and cells of gap that a region may have.
CELL, FILLED, GAP = 8, 0.08, 1


def _ink(width: int | None, grey: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Columns and lines of dark pixels."""
    if grey is None or width is None or pd.isna(width) or width < 1:
        return None
    page = np.asarray(grey)[: len(grey) // int(width) * int(width)].reshape(-1, int(width))
    y, x = np.nonzero(page < DARK)
    return (x, y) if len(x) >= LEAST_INK else None


def angle_of(width: int | None, grey: np.ndarray | None) -> float | None:
    """Degrees by which lines fall to the right (negative: rise)."""
    ink = _ink(width, grey)
    if ink is None:
        return None
    x, y = ink[0] - ink[0].mean(), ink[1] - ink[1].mean()

    def sharpness(degrees: float) -> float:
        turned = y * np.cos(np.radians(degrees)) - x * np.sin(np.radians(degrees))
        profile = np.bincount(np.floor(turned - turned.min()).astype(np.int64))
        return float((np.diff(profile.astype(np.float64), prepend=0, append=0) ** 2).sum())

    best, step = 0.0, 1.0
    tried = np.arange(-MOST_TURN, MOST_TURN + step / 2, step)
    while True:
        best = max(tried.tolist(), key=lambda a: (sharpness(a), -abs(a)))
        if step <= STEP:
            return best
        tried = np.clip(best + np.arange(-step, step + step / 4, step / 2), -MOST_TURN, MOST_TURN)
        step /= 2


def regions_of(width: int | None, grey: np.ndarray | None) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, ink) of each region, most ink first, ties from the top left."""
    ink = _ink(width, grey)
    if ink is None:
        return []
    cells = np.zeros((ink[1].max() // CELL + 1, ink[0].max() // CELL + 1), np.int64)
    np.add.at(cells, (ink[1] // CELL, ink[0] // CELL), 1)
    left = {(int(r), int(c)) for r, c in zip(*np.nonzero(cells > FILLED * CELL * CELL), strict=True)}
    near = [(i, j) for i in range(-GAP - 1, GAP + 2) for j in range(-GAP - 1, GAP + 2) if i or j]
    out = []
    while left:
        part = [left.pop()]
        for r, c in part:  # grows while it is walked
            beside = [(r + i, c + j) for i, j in near if (r + i, c + j) in left]
            left.difference_update(beside)
            part += beside
        rows, columns = [r for r, _ in part], [c for _, c in part]
        out.append((min(columns) * CELL, min(rows) * CELL, (max(columns) + 1) * CELL, (max(rows) + 1) * CELL, int(sum(cells[r, c] for r, c in part))))
    return sorted(out, key=lambda b: (-b[4], b[1], b[0]))


def skew_angles(pages: DataFrame, key: str) -> DataFrame:
    """(key, degrees). ``pages``: key, width, grey."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [angle_of(w, g) for w, g in zip(rows["width"], rows["grey"], strict=True)]
            yield pd.DataFrame({key: rows[key], "degrees": pd.Series(found, dtype="float64")})

    return pages.select(key, "width", "grey").mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, degrees double")


def text_regions(pages: DataFrame, key: str, most: int = 2) -> DataFrame:
    """(key, rank, x0, y0, x1, y1, ink): the ``most`` regions with most ink."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(k, n, *r) for k, w, g in zip(rows[key], rows["width"], rows["grey"], strict=True) for n, r in enumerate(regions_of(w, g)[:most], 1)]
            yield pd.DataFrame(found, columns=[key, "rank", "x0", "y0", "x1", "y1", "ink"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "width", "grey").mapInPandas(run, f"{key} {kind}, rank int, x0 int, y0 int, x1 int, y1 int, ink long")
