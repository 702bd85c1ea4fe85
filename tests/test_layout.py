"""Page layout: angles of pages that were turned on purpose, regions against a plain flood, odd pages."""

import numpy as np
import pytest

from dispatchlake.operators import layout


def page(degrees: float, lines: int = 14, width: int = 400, seed: int = 0) -> np.ndarray:
    """Text lines of random words, falling to the right by so many degrees."""
    rng = np.random.default_rng(seed)
    height = lines * 12 + 200
    out = np.full((height, width), 230)
    for k in range(lines):
        for x in range(20, width - 20):
            if rng.random() < 0.8 and (x // 9) % 5:
                y = 100 + k * 12 + (x - width / 2) * np.tan(np.radians(degrees))
                out[int(y) : int(y) + 5, x] = rng.integers(10, 90)
    noise = rng.random(out.shape) < 0.002
    out[noise] = 0
    return out


@pytest.mark.parametrize("degrees", [-14.5, -7.3, -2.0, -0.4, 0.0, 0.6, 3.3, 9.75, 14.0])
def test_angles_are_found_to_half_a_degree(degrees):
    for seed in range(3):
        grey = page(degrees, seed=seed)
        assert abs(layout.angle_of(grey.shape[1], grey.ravel()) - degrees) <= 0.5


def test_regions_are_the_blocks_of_a_page():
    grey = np.full((300, 400), 255)
    grey[20:60, 30:200] = 0  # the largest
    grey[200:230, 250:350] = 0
    grey[100:104, 380:384] = 0  # a speck fills no cell enough but its own
    found = layout.regions_of(400, grey.ravel())
    assert [(r[0] <= 30, r[1] <= 20, r[2] >= 200, r[3] >= 60) for r in found[:1]] == [(True,) * 4]
    assert found[0][4] == 40 * 170 and found[1][4] == 30 * 100 and len(found) <= 3
    assert all(a[4] >= b[4] for a, b in zip(found, found[1:], strict=False))


def test_regions_and_angles_of_a_table(spark):
    turned = page(4.0)
    rows = [(1, turned.shape[1], turned.ravel().tolist()), (2, None, [1, 2]), (3, 10, None), (4, 0, [1]), (5, 10, [255] * 95), (6, 7, [])]
    table = spark.createDataFrame(rows, "id long, width int, grey array<int>").repartition(3)
    angles = {r["id"]: r["degrees"] for r in layout.skew_angles(table, "id").collect()}
    assert abs(angles.pop(1) - 4) <= 0.5 and set(angles) == {2, 3, 4, 5, 6} and all(a is None or a != a for a in angles.values())
    found = layout.text_regions(table, "id").collect()
    assert {r["id"] for r in found} == {1} and [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, len(found) + 1)) and len(found) <= 2
    assert layout.skew_angles(table.limit(0), "id").collect() == [] and layout.text_regions(table.limit(0), "id").collect() == []
