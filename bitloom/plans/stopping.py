"""When a fit ends, and line search. All state here is a few numbers on the driver."""

from __future__ import annotations

from collections.abc import Callable


def stop_reason(error=None, tol=None, n_iter=None, max_iter=None, diff=None, min_diff=None, n_factor=None, k=None) -> str | None:
    """Why to stop, or None. A pattern just added is kept whatever the reason."""
    if error is not None and tol is not None and error <= tol:
        return "error"
    if n_iter is not None and max_iter is not None and n_iter >= max_iter:
        return "iterations"
    if diff is not None and min_diff is not None and diff < min_diff:
        return "difference"
    if n_factor is not None and k is not None and n_factor >= k:
        return "factors"
    return None


def line_search(f: Callable, df: Callable, x: list[float], p: list[float], max_iter: int = 50, c1: float = 0.1, c2: float = 0.4, top: float = 10.0) -> tuple[float, float]:
    """A step alpha along p with enough decrease and curvature, and f there. Brackets (0, top): too little decrease lowers the
    upper end, too steep a slope raises the lower one, and beyond the bracket the step grows by a fifth."""

    def at(alpha):
        return [a + alpha * b for a, b in zip(x, p, strict=True)]

    start, slope = f(x), sum(a * b for a, b in zip(df(x), p, strict=True))
    low, high, alpha, value = 0.0, top, 2.0, start
    for _ in range(max_iter + 1):
        value = f(at(alpha))
        if value - start > alpha * c1 * slope:
            high = alpha
        elif sum(a * b for a, b in zip(df(at(alpha)), p, strict=True)) >= c2 * slope:
            break
        elif high < top:
            low = alpha
        else:
            alpha *= 1.2
            continue
        alpha = (low + high) / 2
    else:  # out of rounds: the last step is new and not evaluated yet
        value = f(at(alpha))
    return alpha, value


def limited(alpha: float, x: list[float], p: list[float], low: list[float], high: list[float]) -> float:
    """The largest part of the step that stays within the box."""
    for a, b, lo, hi in zip(x, p, low, high, strict=True):
        if b > 0:
            alpha = min(alpha, (hi - a) / b)
        elif b < 0:
            alpha = min(alpha, (lo - a) / b)
    return max(alpha, 0.0)
