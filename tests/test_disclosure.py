"""Hidden cells do not follow from the margins and the cells shown."""

import random

import numpy as np
import pytest

from harmonia.operators.disclosure import NO_NAME, hide_small_cells


def records(spark, counts):
    rows = [(r, c) for (r, c), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "r string, c string")


def determined(hidden):
    """Hidden cells whose value every solution of the margins shares."""
    cells = sorted(hidden)
    sums = [[int(cell[side] == name) for cell in cells] for side in (0, 1) for name in sorted({cell[side] for cell in cells})]
    _, values, space = np.linalg.svd(np.array(sums, float))
    free = space[(values > 1e-9).sum():]
    return [cell for k, cell in enumerate(cells) if not len(free) or np.abs(free[:, k]).max() < 1e-9]


@pytest.mark.parametrize("seed", range(8))
def test_no_hidden_cell_follows_from_the_rest(spark, seed):
    rng = random.Random(seed)
    height, width = rng.randrange(2, 9), rng.randrange(2, 6)
    odds = rng.choice([0.05, 0.3, 0.9])
    counts = {(f"r{i}", f"c{j}"): rng.randrange(1, 5) if rng.random() < odds else rng.randrange(5, 30) for i in range(height) for j in range(width)}
    counts["r0", "c0"] = 2
    for key in list(counts)[1::7]:
        counts[key] = 0
    counts["r1", "c1"] = 9
    found = {(r.row_name, r.column_name): r for r in hide_small_cells(records(spark, counts), "r", "c", 5).collect()}
    shown = {key: n for key, n in counts.items() if key in found}
    hidden = {key for key, r in found.items() if r.suppressed}
    assert {key for key, n in shown.items() if 0 < n < 5} == {key for key, r in found.items() if r.reason == "small"} <= hidden
    assert all(r.n == shown.get(key, 0) for key, r in found.items() if not r.suppressed) and all(found[key].n is None for key in hidden)
    assert determined(hidden) == []


def test_edges(spark):
    whole = {("a", "x"): 9, ("a", "y"): 8, ("b", "x"): 7, (None, "y"): 6}
    found = hide_small_cells(records(spark, whole), "r", "c", 5).collect()
    assert not any(r.suppressed for r in found) and {r.row_name for r in found} == {"a", "b", NO_NAME} and len(found) == 6
    with pytest.raises(ValueError, match="two rows"):
        hide_small_cells(records(spark, {("a", "x"): 1, ("a", "y"): 9}), "r", "c", 5)
    assert hide_small_cells(records(spark, {}), "r", "c", 5).collect() == []
