"""Template search against a plain loop."""

import numpy as np
import pytest

from callatlas.operators.frames import best_match


def loop(frame, template, x0, y0, x1, y1, step):
    th, tw = template.shape
    error = lambda x, y: float(np.abs(frame[y : y + th, x : x + tw] - template.astype(np.int32)).mean())
    places = [(x, y) for y in range(y0, y1 + 1, step) for x in range(x0, x1 + 1, step)]
    best = min(((*p, error(*p)) for p in places), key=lambda p: p[2], default=(-1, -1, float("inf")))
    if step > 1 and best[0] >= 0:
        near = [(x, y) for y in range(max(y0, best[1] - step), min(y1, best[1] + step) + 1) for x in range(max(x0, best[0] - step), min(x1, best[0] + step) + 1)]
        best = min([best, *((*p, error(*p)) for p in near)], key=lambda p: p[2])
    return best


@pytest.mark.parametrize("step", [1, 2, 3])
def test_template_is_found_where_a_loop_finds_it(step):
    rng = np.random.default_rng(step)
    template = np.full((4, 3), 230, np.uint8)
    for k in range(60):
        frame = rng.integers(0, 4, (20, 24)).astype(np.int32) * 60  # few values, so many ties
        x0, y0, x1, y1 = (0, 0, 21, 16) if k % 2 else (3, 2, 3 + k % 12, 2 + k % 9)
        assert best_match(frame, template, x0, y0, x1, y1, step) == loop(frame, template, x0, y0, x1, y1, step)
    assert best_match(np.zeros((2, 2), np.int32), template, 0, 0, -1, -2, step) == (-1, -1, float("inf"))
